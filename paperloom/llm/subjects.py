"""Subject areas of documents: complement naive Bayes on labelled documents, refined by expectation-maximisation over
all documents, with calibrated independent posteriors per sentence.

Features are word stems, hashed into a fixed number of buckets, so the model has one fixed size whatever the corpus. The weight of a feature for an area compares its count in the whole corpus with what its count
outside the area leads one to expect; general words weigh nothing for any area. Each sentence gets the posterior of each
area on its own, and a document has the areas that hold in a given share of its sentences.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, shared_dir, spread

BUCKETS = 1 << 17
#: Labelled documents used to start and to calibrate: the first by a hash of their id.
MOST_LABELLED = 20_000
#: Rounds at most, and the share of expected counts that may still move between areas.
ROUNDS, MOVED = 4, 0.02
#: Held-out sentences of an area from which it gets a curve of its own.
FEW = 50
SHARE = 0.25
SMOOTH = 0.2
#: Of a sentence's summed weights, of no area at all (beside 0 for an area without evidence), and of the shares of a document.
SHARPNESS, NOTHING, DOUBT = 2.0, 3.0, 0.1
#: Log odds by which another area must be better for it to take the words in common.
NEAR = 3.0

_HEADING = re.compile(r"(?m)^[ \t]*#.*$")
_QUOTE = re.compile(r"(?m)^[ \t]*>[ \t]?")
_BLOCK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[*|+-]|\d+[.)])\s?)|\n(?=[A-Z][\w ]{0,40}:)")
_END = re.compile(r"(?<=[.!?。])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+")
_LEAD = re.compile(r"^\s*(?:[*|+-]+|\d+[.)])?\s*(?:(?:Q|A|Summary)\s*:)?\s*")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: blocks are cut at blank lines, list items and labels, then at sentence ends.

    Wrapped lines of one block are joined, and line breaks written as an escape count as such. What has no sentence end
    and fewer than six words (headings, version lines) is no sentence.
    """
    found = []
    text = text or ""
    if "\\n" in text:  # records quoted as JSON strings
        text = text.replace('", "', "\n\n").replace('": "', "\n\n").replace("\\n", "\n")
    if "#" in text:
        text = _HEADING.sub("\n", text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    for block in _BLOCK.split(text):
        for s in _END.split(_LEAD.sub("", " ".join(block.split()))):
            s = s.strip()
            if s and (s[-1] in ".!?。" or len(s.split()) > 5):
                found.append(s)
    return found


class _Stems(dict):
    """word -> hashes of its stem and, for Hangul, of its beginnings (particles are written onto the word)."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        if "가" <= word[0] <= "힣":
            stems = [word[:n] for n in range(2, len(word) + 1)] or [word]
        else:
            stems = [word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word]
        h = self[word] = tuple(xxhash.xxh3_64_intdigest(s) for s in stems)
        return h


_STEMS = _Stems()


def features(texts: Sequence[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence of every feature, and the text of every sentence; sentences are numbered over all texts."""
    hashes: list[int] = []
    lengths: list[int] = []
    owner: list[int] = []
    stems, words = _STEMS.__getitem__, _WORD.findall
    for i, t in enumerate(texts):
        for s in sentences(t):
            n = len(hashes)
            hashes.extend(chain.from_iterable(map(stems, words(s.lower()))))
            lengths.append(len(hashes) - n)
            owner.append(i)
    h = np.fromiter(hashes, np.uint64, len(hashes))
    of = np.repeat(np.arange(len(lengths)), lengths)
    return (h % np.uint64(buckets)).astype(np.int64), of, np.array(owner, np.int64)


def featurize(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, sizes, bucket``: the features of each of ``documents(doc_id, text)``, sentence after sentence.

    ``sizes`` has the features of each sentence. Null and empty texts have no sentences. The table is written to the shared
    folder, since every round reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                bucket, where, owner = features(part.column("text").to_pylist(), buckets)
                per_doc = np.bincount(owner, minlength=part.num_rows) if len(owner) else np.zeros(part.num_rows, int)
                per_sentence = np.bincount(where, minlength=len(owner)) if len(where) else np.zeros(len(owner), int)
                held = np.bincount(owner[where], minlength=part.num_rows) if len(where) else np.zeros(part.num_rows, int)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), pa.array(v, pa.int32())) for k, v in ((per_doc, per_sentence), (held, bucket))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "sizes", "bucket"])

    spark = documents.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, sizes array<int>, bucket array<int>").write.parquet(at)
    return spark.read.parquet(at)


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`features`, from rows of :func:`featurize`."""
    sizes, held = batch.column("sizes"), batch.column("bucket")
    if isinstance(batch, pa.Table):
        sizes, held = sizes.combine_chunks(), held.combine_chunks()
    size = pc.list_flatten(sizes).to_numpy(zero_copy_only=False)
    return (
        pc.list_flatten(held).to_numpy(zero_copy_only=False).astype(np.int64),
        np.repeat(np.arange(len(size)), size),
        np.repeat(np.arange(batch.num_rows), pc.list_value_length(sizes).to_numpy(zero_copy_only=False)),
    )


def weights(inside: np.ndarray, total: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Complement weights, buckets by areas, from expected counts ``inside`` and counts ``total`` of all sentences.

    The complement of an area is everything outside it. Where no more of a feature is inside than the size of the area
    explains, the weight is about 0.
    """
    n, n_in = total.sum(), inside.sum(0)
    outside = np.maximum(total[:, None] - inside, 0)
    rate = n / np.maximum(n - n_in, 1.0)
    return np.log((total[:, None] + smooth) / (outside * rate + smooth)).astype(np.float32)


@dataclass
class Model:
    areas: list[str]
    w: np.ndarray
    slope: np.ndarray  # by area
    offset: np.ndarray

    def score(self, bucket: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        """Summed weights, sentences by areas."""
        out = np.zeros((n, self.w.shape[1]), np.float32)
        if len(bucket):
            start = np.flatnonzero(np.diff(where, prepend=-1))
            out[where[start]] = np.add.reduceat(self.w[bucket], start, axis=0)
        return out

    def mixture(self, score: np.ndarray, owner: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 4) -> np.ndarray:
        """Log of likelihood times share of its document, sentences by areas and nothing in particular (last).

        Every document is a mixture of areas and of nothing; its shares and the areas of its sentences are estimated in
        turn. ``owner`` is the document of each sentence, ``allowed`` the areas a document may have, if known.
        """
        n, k = score.shape
        like = np.clip(np.concatenate([SHARPNESS * score, np.full((n, 1), NOTHING)], 1), -30, 30).astype(float)
        if not n:
            return like
        docs = int(owner.max()) + 1
        size = np.maximum(np.bincount(owner, minlength=docs), 1)[:, None]
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        can = np.ones((docs, k + 1)) if allowed is None else np.concatenate([allowed[:docs], np.ones((docs, 1), bool)], 1).astype(float)
        prior = can / can.sum(1, keepdims=True)
        top = np.exp(like - like.max(1, keepdims=True))
        for _ in range(rounds):
            p = top * prior[owner]
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            prior = np.full((docs, k + 1), 1e-12)
            prior[owner[start]] = np.add.reduceat(p, start, axis=0)
            prior = can * (prior + DOUBT) / (size + DOUBT * (k + 1))
        return like + np.log(np.maximum(prior[owner], 1e-300))

    def expected(self, score: np.ndarray, owner: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Probability that a sentence is about each area, given its words and the areas of its document."""
        m = self.mixture(score, owner, allowed)
        p = np.exp(m - m.max(1, keepdims=True)) if len(m) else m
        return (p / p.sum(1, keepdims=True))[:, :-1] if len(m) else p[:, :-1]

    def margin(self, score: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Log odds of each area against nothing in particular, each on its own.

        Where another area explains the sentence better by more than ``NEAR``, the words in common are its.
        """
        m = self.mixture(score, owner)
        if m.shape[1] < 3 or not len(m):
            return m[:, :-1] - m[:, -1:]
        two = np.sort(m[:, :-1], axis=1)[:, -2:]
        other = np.where(m[:, :-1] == two[:, 1:], two[:, :1], two[:, 1:])
        return m[:, :-1] - np.logaddexp(m[:, -1:], other - NEAR)

    def posterior(self, score: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Calibrated posteriors of each area on its own: a sentence can be about two areas or none."""
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.margin(score, owner), -20, 20) + self.offset, -30, 30)))


def calibrate(margin: np.ndarray, truth: np.ndarray, steps: int = 100, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton steps that are halved until they help.

    Targets are smoothed as Platt proposed; the ridge keeps the curve finite where the classes do not overlap.
    """
    pos, neg = int(truth.sum()), int((~truth).sum())
    if not pos or not neg:
        return 1.0, -3.0
    t = np.where(truth, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.clip(margin, -20, 20)

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float((np.logaddexp(0, z) - t * z).sum() + ridge / 2 * v[0] ** 2)

    v = np.array([0.5, -1.0])
    now = loss(v)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -30, 30)))
        g = np.array([((p - t) * x).sum() + ridge * v[0], (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + ridge, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        while (after := loss(v - step)) > now and abs(step).max() > 1e-9:
            step = step / 2
        v, gain, now = v - step, now - after, after
        if gain < 1e-7 * abs(now):
            break
    return float(max(v[0], 1e-3)), float(v[1])


class Labelled:
    """The labelled documents: their features, areas and folds."""

    def __init__(self, sample: pa.Table, labels: Sequence[frozenset[str]], areas: Sequence[str], buckets: int):
        self.areas, self.buckets = sorted(areas), buckets
        self.y = np.array([[a in ls for a in self.areas] for ls in labels], bool).reshape(len(labels), len(self.areas))
        self.bucket, self.where, self.owner = _arrays(sample)
        self.fold = np.arange(len(labels)) % 2
        self.of = self.owner[self.where] if len(self.where) else self.owner[:0]

    def counts(self, use: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts inside each area and in total of the documents in ``use``; ``share`` by feature."""
        keep = use[self.of] if len(self.of) else np.zeros(0, bool)
        b = self.bucket[keep]
        inside = np.stack([np.bincount(b, share[keep, k], self.buckets) for k in range(len(self.areas))], 1) if self.areas else np.zeros((self.buckets, 0))
        return inside, np.bincount(b, minlength=self.buckets).astype(float)

    def even(self) -> np.ndarray:
        """Shares of the areas by label alone."""
        return (self.y / np.maximum(self.y.sum(1, keepdims=True), 1))[self.of]

    def clamped(self, model: Model) -> np.ndarray:
        """Shares under a model, with only the labelled areas and nothing open to each document."""
        return model.expected(model.score(self.bucket, self.where, len(self.owner)), self.owner, self.y)[self.where]

    def calibrated(self, inside: np.ndarray, total: np.ndarray, share: np.ndarray) -> Model:
        """The model of the counts, calibrated by area on documents it has not seen.

        ``inside`` and ``total`` hold the labelled documents with ``share``; for each fold their part is taken out, and the
        margins of its documents of one area are those held out. Areas with under ``FEW`` such sentences take the curve of
        all.
        """
        margins, truths = [], []
        for f in (0, 1):
            i, t = self.counts(self.fold == f, share)
            part = Model(self.areas, weights(np.maximum(inside - i, 0), total - t), np.ones(1), np.zeros(1))
            m = part.margin(part.score(self.bucket, self.where, len(self.owner)), self.owner)
            single = (self.fold[self.owner] == f) & (self.y[self.owner].sum(1) == 1) if len(self.owner) else np.zeros(0, bool)
            margins.append(m[single])
            truths.append(self.y[self.owner][single])
        m, t = np.concatenate(margins).astype(float), np.concatenate(truths)
        slope, offset = calibrate(m.ravel(), t.ravel())
        curves = [calibrate(m[:, k], t[:, k]) if t[:, k].sum() >= FEW else (slope, offset) for k in range(len(self.areas))]
        return Model(self.areas, weights(inside, total), np.array([a for a, _ in curves]), np.array([b for _, b in curves]))


def expect(model: Model, batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts inside each area and total counts of the features of a batch."""
    bucket, where, owner = _arrays(batch)
    p = model.expected(model.score(bucket, where, len(owner)), owner)
    inside = np.stack([np.bincount(bucket, p[where, k], buckets) for k in range(p.shape[1])], 1)
    return inside, np.bincount(bucket, minlength=buckets).astype(float)


def fit(features_: DataFrame, labels: DataFrame, areas: Sequence[str], rounds: int = ROUNDS, buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED, moved: float = MOVED) -> Model:
    """Fit on ``labels(doc_id, subject_code)``, then refine over all documents, given by :func:`featurize`.

    The start uses at most ``most_labelled`` labelled documents. Each round sums the expected counts of all other
    documents and adds those of the labelled ones, whose areas stay as labelled, so every document counts once. A task
    sums its own and gives one sparse vector, so the shuffle carries at most ``buckets`` rows per task, and what reaches
    the driver is the model, of fixed size. Rounds end when less than the share ``moved`` of the expected counts has moved
    between areas, or after ``rounds``. Labels of unknown areas or documents are ignored, repeated ones count once.
    Without labels every weight is 0 and no document gets an area.
    """
    spark = features_.sparkSession
    known = labels.where(F.col("subject_code").isin(list(areas))).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_code")).alias("codes"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    sample = features_.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()  # at most most_labelled rows
    codes = [frozenset(c) for c in sample.column("codes").to_pylist()]
    held = Labelled(sample, codes, areas, buckets)
    everyone = np.ones(len(codes), bool)
    share = held.even()
    base_in, base_all = held.counts(everyone, share)
    model = held.calibrated(base_in, base_all, share)
    if not codes:
        return model
    others = features_.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("sizes", "bucket")
    sums = ", ".join(f"c{k} double" for k in range(len(model.areas)))
    before = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, inside, total = shared.value, None, None
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    i, t = expect(m, batch.slice(lo, 1000), buckets)
                    inside, total = (i, t) if inside is None else (inside + i, total + t)
            if inside is not None:
                b = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"bucket": b, "total": total[b]} | {f"c{k}": inside[b, k] for k in range(inside.shape[1])})

        parts = others.mapInArrow(partial, f"bucket bigint, total double, {sums}")
        table = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["total", *[f"c{k}" for k in range(len(model.areas))]]]).toPandas()
        share = held.clamped(model)
        inside, total = held.counts(everyone, share)
        b = table["bucket"].to_numpy()
        total[b] += table["total"].to_numpy()
        for k in range(len(model.areas)):
            inside[b, k] += table[f"c{k}"].to_numpy()
        model = held.calibrated(inside, total, share)
        if before is not None and np.abs(inside - before).sum() < moved * max(inside.sum(), 1.0):
            break
        before = inside
    return model


SHARES = "doc_id bigint, subject_code string, n_about int, n_sentences int, posterior double"


def classify(features_: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """Areas of each document of :func:`featurize`: those held with posterior over one half by at least ``share`` of its
    sentences.

    One row per document and area, with both counts and the mean posterior. Null and empty texts, and texts none of
    whose areas reaches the share, have no row.
    """
    shared = features_.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                bucket, where, owner = _arrays(part)
                if not len(owner):
                    continue
                p = m.posterior(m.score(bucket, where, len(owner)), owner)
                size = np.bincount(owner, minlength=part.num_rows)
                about = np.stack([np.bincount(owner, p[:, k] > 0.5, part.num_rows) for k in range(p.shape[1])], 1)
                mean = np.stack([np.bincount(owner, p[:, k], part.num_rows) for k in range(p.shape[1])], 1) / np.maximum(size, 1)[:, None]
                i, k = np.nonzero((about >= share * size[:, None]) & (about > 0))
                columns = [part.column("doc_id").take(pa.array(i)), pa.array([m.areas[x] for x in k], pa.string()), pa.array(about[i, k].astype(np.int32)), pa.array(size[i].astype(np.int32)), pa.array(mean[i, k])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "subject_code", "n_about", "n_sentences", "posterior"])

    return features_.select("doc_id", "sizes", "bucket").mapInArrow(run, SHARES)


def composition(found: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """Documents and characters of each area and of none; a document of two areas counts for both."""
    size = documents.select("doc_id", F.length("text").alias("chars"))
    per = size.join(found.select("doc_id", "subject_code").distinct(), "doc_id", "left").groupBy("subject_code").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"))
    all_ = documents.agg(F.count(F.lit(1)).alias("all"))
    named = subjects.select("subject_code").distinct().unionByName(subjects.sparkSession.createDataFrame([(None,)], "subject_code string"))
    j = named.alias("s").join(per.alias("p"), F.expr("s.subject_code <=> p.subject_code"), "left").crossJoin(F.broadcast(all_))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(F.coalesce("s.subject_code", F.lit("(none)")).alias("subject_code"), zero(F.col("n_documents")).alias("n_documents"), zero(F.col("n_chars")).alias("n_chars"), F.coalesce(F.round(F.try_divide(zero(F.col("n_documents")), F.col("all")), 6), F.lit(0.0)).alias("share"))
