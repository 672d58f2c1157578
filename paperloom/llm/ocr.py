"""Noise of scanned pages: words divided at line ends, misread characters, running headers and page numbers.

Misread words are found in SQL over the vocabulary: a word's anagram value is the sum of the values of its characters, so
replacing one group of characters by a confusable group changes it by a fixed difference, wherever in the word and
whatever the rest. Rare words are joined on value minus difference with the words they could stand for; the replacement
is then checked in place, and candidates are ranked by frequency. Divided words are judged by evidence: whether the
joined form or the hyphenated one is in use.

Edge lines (headers, page numbers) are removed on evidence, not on their form: lines that stand by themselves are
collected from all texts, and a line is an edge line if it comes back in other surroundings in its paper or in several
papers and cuts sentences in two, or if it repeats its paper's title or author. Forms that printers use only add weight
to a line that cuts a sentence.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.lexical import if_small
from paperloom.session import cut, shared_dir, spread

#: What scanners confuse, right and wrong.
CONFUSIONS = (
    ("a", "à"), ("b", "6"), ("cl", "d"), ("d", "cl"), ("e", "c"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("g", "q"), ("h", "b"), ("i", "l"), ("i", "1"),
    ("l", "1"), ("m", "rn"), ("n", "ri"), ("o", "0"), ("rn", "m"), ("s", "5"), ("t", "f"), ("u", "ii"), ("w", "vv"), ("z", "2"),
)
#: A word is a misreading only of one at least so many times as frequent.
RARER = 20
#: An edge line known by repetition cuts a sentence in at least this share of its places.
CUTS = 0.25
#: Papers in which a line has to stand to be known as an edge line of the whole corpus.
PAPERS = 3
LONGEST = 120

HYPHENS = "-­‐‑¬"
_BREAK = re.compile(r"(?:^|(?<=[^\w-]))(?=\d*[^\W\d_])([^\W_]+)[" + HYPHENS + r"]$")
_NEXT = re.compile(r"(?=\d*[^\W\d_])[^\W_]+")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_INNER_CAPITAL = re.compile(r"[a-z].*[A-Z]")
_PARTS = re.compile(r"\s{2,}|\t|\s+\|\s+")
_PAGE = re.compile(r"(?:(?:[Pp]age|PAGE|pp?\.)\s+)?\d{1,6}(?:\s+of\s+\d{1,6})?|[-–—]\s*\d{1,6}\s*[-–—]|\[\d{1,6}\]")
_LABELLED = re.compile(r"[A-Z][^\W\d_]{0,11}\.?\s+\d{1,6}")
_MARKED = re.compile(r"[|#>*+•`]|[-–—]\s+(?!\d{1,6}\s*[-–—]$)|\d+[.)]\s|\[\d+\]\s")
_SENTENCE = re.compile(r"[.!?]\s")
#: Weak evidence: names alone with "et al.", a title and a name, notes on the state of a paper; titles in capitals.
_SIGNED = re.compile(r"(?:[A-Z][\w'’-]+(?:\s+(?:and|&)\s+[A-Z][\w'’-]+)?\s+et al\.(?:\s*/\s*\S.*)?|\S.*\s·\s.*\S|(?:Preprint|Manuscript)\.\s+[Uu]nder review\.?|Proceedings volume\s+\d+.*)$")
_CAPITALS = re.compile(r"[^a-z]*[A-Z]{2,}[^a-z]*\s[^a-z]*[A-Z]{2,}[^a-z]*$")
_DIGITS = re.compile(r"\d+")


def edge_parts(line: str) -> tuple[str | None, str | None, bool, int]:
    """What a line that could be an edge line says besides page numbers, the form of its numbers, whether that is one of
    a page, and its form: 2 signed, 1 in capitals, 0 plain. Neither text nor numbers for a line that is none.

    Texts are folded and their digits replaced, so the lines of many pages agree. Table rows, list items, headings and
    lines with a sentence end inside are none.
    """
    if not line or len(line) > LONGEST or not (line[0].isupper() or line[0].isdigit() or line[0] in "[-–—p") or _MARKED.match(line):
        return None, None, False, 0
    rest, numbers, page, form = [], [], False, 0
    for p in _PARTS.split(line):
        if _PAGE.fullmatch(p):
            numbers.append(p)
            page = True
        elif _LABELLED.fullmatch(p):
            numbers.append(p)
        elif p:
            rest.append(p)
    head = " ".join(rest) or None
    if head is not None:
        form = 2 if _SIGNED.match(head) else 1 if _CAPITALS.match(head) else 0
        if not head[0].isupper() or (form < 2 and (head[-1] in ",;." + HYPHENS or _SENTENCE.search(head))):
            return None, None, False, 0
        head = _DIGITS.sub("#", " ".join(head.casefold().split()))
    num = _DIGITS.sub("#", " | ".join(" ".join(p.split()) for p in numbers).casefold()) or None
    return head, num, page, form


def words_of(text: str) -> list[str]:
    """Words and hyphenated compounds, lower case; names with capitals inside are left out."""
    return [w.lower() for w in _WORD.findall(text) if w.islower() or not _INNER_CAPITAL.search(w)]


def scan(text: str) -> tuple[list[str], list[tuple[str, str, list[str]]], list[tuple]]:
    """Words of a text, the halves at each hyphen at a line end, and the lines that could be edge lines.

    Words come from all lines but the last kind, without the halves. A half is the last run of letters before the hyphen
    or the first of the next such line, with the possible edge lines between the two; words that already have a hyphen
    are not divided ones. A possible edge line comes as ``line, head, num, page, form, value, before, after, cuts, words``:
    hashes of its neighbours, and whether a sentence goes on across it.
    """
    filled = [s for line in text.split("\n") if (s := line.strip())]
    if len(filled) < 2:
        return words_of(filled[0]) if filled else [], [], []
    edge = {k: p for k, s in enumerate(filled) if (p := edge_parts(s))[0] or p[1]}
    body = [k for k in range(len(filled)) if k not in edge] if edge else range(len(filled))
    segments: list[str] = []
    halves: list[tuple[str, str, list[str]]] = []
    skip = 0
    for at, k in enumerate(body):
        s = filled[k]
        start, skip, end = skip, 0, len(s)
        if s[-1] in HYPHENS and at + 1 < len(body) and (m := _BREAK.search(s)) and (n := _NEXT.match(filled[body[at + 1]])):
            halves.append((m[1], n[0], filled[k + 1 : body[at + 1]]))
            end, skip = m.start(1), n.end()
        elif s[-1] in HYPHENS and k + 1 in edge and s.isupper() and (m := _BREAK.search(s)) and (n := _NEXT.match(filled[k + 1])) and n[0].isupper():
            halves.append((m[1], n[0], []))
            end = m.start(1)
        segments.append(s[min(start, end) : end])
    lines = []
    if edge:
        # Plain lines may well be text, so they are neighbours too.
        solid = [k not in edge or (edge[k][1] is None and edge[k][3] == 0) for k in range(len(filled))]
        before, prev = {}, None
        for k, s in enumerate(filled):
            if k in edge:
                before[k] = prev
            if solid[k]:
                prev = s
        follow, after = {}, None
        for k in range(len(filled) - 1, -1, -1):
            if k in edge:
                follow[k] = after
            if solid[k]:
                after = filled[k]
        for k, (head, num, page, form) in edge.items():
            s, prev, after = filled[k], before[k], follow[k]
            cuts = prev is not None and after is not None and (prev[-1] in HYPHENS or prev[-1] not in ".!?:;\"”)]") and (after[0].islower() or prev[-1] in HYPHENS + ",")
            value = int(s) if s.isdigit() and len(s) < 7 else None
            lines.append((s, head, num, page, form, value, _h(prev), _h(after), cuts, words_of(s)))
    return words_of("\n".join(segments)), halves, lines


def _h(s: str | None) -> int:
    return 0 if s is None else xxhash.xxh3_64_intdigest(s) >> 1


SCANNED = pa.schema(
    [
        ("kind", pa.string()), ("chunk_id", pa.string()), ("paper_id", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.string()), ("b", pa.string()), ("through", pa.list_(pa.string())),
        ("line", pa.string()), ("head", pa.string()), ("num", pa.string()), ("page", pa.bool_()), ("form", pa.int32()), ("value", pa.int32()), ("before", pa.int64()), ("after", pa.int64()), ("cuts", pa.bool_()),
        ("word", pa.string()), ("n", pa.int64()), ("n_joined", pa.int64()),
    ]
)
_SQL_SCHEMA = "kind string, chunk_id string, paper_id string, words array<string>, a string, b string, through array<string>, line string, head string, num string, page boolean, form int, value int, before bigint, after bigint, cuts boolean, word string, n bigint, n_joined bigint"
_MOST_COUNTED = 1_000_000


def scanned(texts: DataFrame) -> DataFrame:
    """One pass over ``texts(chunk_id, paper_id, text)``: rows of four kinds.

    `words`: the distinct words of a text, with the parts of its compounds; `break`: halves ``a, b`` at a line end;
    `line`: a possible edge line; `count`: how often a task met a ``word``, as one (``n``) or put together at a line end
    or as part of a compound (``n_joined``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            every = list({**seen, **other})
            return _batch({"kind": ["count"] * len(every), "word": every, "n": [seen[w] for w in every], "n_joined": [other[w] for w in every]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                w: dict[str, list] = {k: [] for k in ("chunk_id", "paper_id", "words")}
                rows: list[tuple] = []
                for cid, paper, text in zip(*(part.column(c).to_pylist() for c in ("chunk_id", "paper_id", "text")), strict=True):
                    words, halves, lines = scan(text)
                    seen.update(words)
                    distinct = set(words)
                    parts = [p for x in words if "-" in x for p in x.split("-")]
                    if parts:
                        other.update(parts)
                        distinct.update(parts)
                    for a, b, through in halves:
                        other[(a + b).lower()] += 1
                        rows.append(("break", cid, paper, None, a, b, through, *[None] * 9))
                    for line, head, num, page, form, value, before, after, cuts, inside in lines:
                        seen.update(inside)
                        rows.append(("line", cid, paper, inside, None, None, None, line, head, num, page, form, value, before, after, cuts))
                    w["chunk_id"].append(cid)
                    w["paper_id"].append(paper)
                    w["words"].append([x for x in distinct if len(x) > 1])
                yield _batch({"kind": ["words"] * len(w["words"])} | w)
                if rows:
                    yield _batch(dict(zip(SCANNED.names[:16], map(list, zip(*rows, strict=True)), strict=True)))
            if len(seen) + len(other) > _MOST_COUNTED:
                yield counts()
                seen.clear()
                other.clear()
        if seen or other:
            yield counts()

    return spread(texts.select("chunk_id", "paper_id", "text")).mapInArrow(run, _SQL_SCHEMA)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCANNED], schema=SCANNED)


def edge_lines(lines: DataFrame, papers: DataFrame | None = None, cuts: float = CUTS, least: int = PAPERS) -> DataFrame:
    """``chunk_id, line, header, number``: the possible edge lines that are some, and what is in them.

    What a line says besides numbers is a running header if

    * in its paper it stands in several chunks, between different lines, and cuts a sentence in some of them,
    * or it does so in at least ``least`` papers,
    * or it is made of the beginning of its paper's title or one of its authors' names (``papers(paper_id, title,
      authors)``),
    * or it cuts a sentence here and has a page number beside it or a printer's form,
    * or it is signed (names alone with "et al.", a title and a name) and stands at the edge of its text.

    The number beside a header is a page number. A number alone is one if it cuts a sentence, or if its form does so in at
    least ``least`` papers; one that could be a year must also lie near the other page numbers of its paper.
    """
    c = lines.select("chunk_id", "paper_id", "line", "head", "num", "page", "form", "value", "before", "after", "cuts").distinct()
    seen = [F.count(F.lit(1)).alias("n"), F.count_if("cuts").alias("k"), F.countDistinct("before").alias("b"), F.countDistinct("after").alias("a")]
    known = lambda n: (F.least("a", "b") >= n) & (F.col("k") >= F.greatest(F.lit(1), F.col("n") * cuts))
    heads = c.where(F.col("head").isNotNull())
    in_paper = heads.where(F.col("paper_id").isNotNull()).groupBy("paper_id", "head").agg(F.countDistinct("chunk_id").alias("chunks"), *seen).where((F.col("chunks") >= 2) & known(2)).select("paper_id", "head", F.lit(True).alias("again"))
    in_all = heads.groupBy("head").agg(F.countDistinct("paper_id").alias("papers"), *seen).where((F.col("papers") >= least) & known(least)).select("head", F.lit(True).alias("usual"))
    j = heads.join(if_small(cut(in_paper)), ["paper_id", "head"], "left").join(if_small(cut(in_all)), "head", "left")
    told = F.lit(False)
    if papers is not None:
        fold = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\d+", "#"), r"\s+", " ")
        who = papers.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.collect_set(F.coalesce(fold("title"), F.lit(""))).alias("titles"), F.flatten(F.collect_set(F.coalesce("authors", F.array().cast("array<string>")))).alias("names"))
        asked = if_small(cut(heads.select("paper_id").distinct()))
        who = who.join(asked, "paper_id", "left_semi")
        j = j.join(who, "paper_id", "left")
        # A header has few pieces: a title or its beginning, an author's name with "et al.", a volume.
        pieces = F.transform(F.split("head", r"\s+[/·|]\s+|,\s+"), lambda p: F.regexp_replace(p, r"\s+et al\.$|[ :]+$", ""))
        names = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.concat(F.lit(" "), F.lower(F.regexp_replace(x, r"[.,;*]", " ")), F.lit(" ")))
        title = lambda p: (F.size(F.split(p, " ")) >= 2) & F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.rlike(F.substr(F.concat(t, F.lit(" ")), F.length(p) + 1), F.lit(r"^[ :]")) & F.startswith(t, p))
        author = lambda p: (F.length(p) >= 3) & F.exists(names, lambda x: F.contains(x, F.concat(F.lit(" "), p, F.lit(" "))))
        told = F.exists(pieces, lambda p: title(p) | author(p)) & F.forall(pieces, lambda p: title(p) | author(p) | (F.size(F.split(p, " ")) <= 3))
    header = F.coalesce("again", F.lit(False)) | F.coalesce("usual", F.lit(False)) | told | (F.col("cuts") & (F.col("num").isNotNull() | (F.col("form") > 0))) | ((F.col("form") == 2) & ((F.col("before") == 0) | (F.col("after") == 0)))
    found = j.where(header).select("chunk_id", "line", F.lit(True).alias("header"), F.col("num").isNotNull().alias("number"))
    alone = c.where(F.col("head").isNull())
    forms = alone.groupBy("num").agg(F.countDistinct("paper_id").alias("papers"), *seen).where((F.col("papers") >= least) & known(least)).select("num", F.lit(True).alias("usual"))
    year = F.coalesce(F.col("value").between(1900, 2099), F.lit(False))
    n = alone.join(if_small(cut(forms)), "num", "left").where(F.coalesce("usual", F.lit(False)) | (F.col("cuts") & F.col("page"))).withColumn("year", year)
    pages = n.where(~F.col("year")).select("paper_id", F.regexp_extract("line", r"\d+", 0).cast("int").alias("p")).groupBy("paper_id").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    near = n.where("year").join(pages, "paper_id").where(F.col("value").between(F.col("low") - 300, F.col("high") + 300))
    numbers = n.where(~F.col("year")).select("chunk_id", "line").unionByName(near.select("chunk_id", "line"))
    return found.unionByName(numbers.select("chunk_id", "line", F.lit(False).alias("header"), F.lit(True).alias("number"))).distinct()


def _value(c: Column) -> Column:
    """Anagram value: the sum of the characters' values, each under 2^40."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), lambda acc, x: acc + F.pmod(F.xxhash64(x), F.lit(1 << 40)))


def corrections(words: DataFrame, rarer: int = RARER) -> DataFrame:
    """``word, right``: the best ranked word each rare word is a misreading of; words without one are left out.

    ``words(word, n, n_joined)`` is a vocabulary. The right word has at least three letters and nothing else, and is at
    least ``rarer`` times as frequent; among several the most frequent wins, then the smaller.
    """
    spark = words.sparkSession
    rules = spark.createDataFrame([(a, b) for a, b in CONFUSIONS], "good string, bad string").withColumn("delta", _value(F.col("bad")) - _value(F.col("good")))
    plain = words.where(~F.col("word").contains("-") & (F.length("word") >= 2))
    often = F.greatest(F.col("n") + F.col("n_joined"), F.lit(1))
    rare = plain.withColumn("often", often).where(F.col("word").rlike(r"\p{L}")).crossJoin(F.broadcast(rules)).where(F.contains("word", "bad"))  # a fixed list
    rare = rare.withColumn("value", _value(F.col("word")) - F.col("delta"))
    common = plain.where((F.col("n") >= rarer) & F.col("word").rlike(r"^\p{L}{3,}$")).select(F.col("word").alias("right"), F.col("n").alias("m"), _value(F.col("word")).alias("value"))
    at = F.sequence(F.lit(1), F.length("word") - F.length("bad") + 1)
    placed = F.exists(at, lambda i: (F.substr("word", i, F.length("bad")) == F.col("bad")) & (F.concat(F.substr("word", F.lit(1), i - 1), F.col("good"), F.substr("word", i + F.length("bad"))) == F.col("right")))
    found = rare.join(common, "value").where((F.col("m") >= F.col("often") * rarer) & placed)
    best = found.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))
    return best


class ScanNoise:
    """Damage in ``texts(chunk_id, text)`` and what repairs it.

    ``texts`` may have a ``paper_id``, which edge lines are compared by; ``papers(paper_id, title, authors)`` adds what
    headers repeat. ``damage``: ``chunk_id, damage`` with ``hyphen_break``, ``misread_char``, ``running_header``,
    ``page_number``, one row per chunk and kind. Repeated rows count once; an id with several texts has the damage of all
    of them. Rows with a null id or text are left out; empty texts have no damage. What the one pass over the texts finds
    is written to the shared folder.
    """

    def __init__(self, texts: DataFrame, papers: DataFrame | None = None, rarer: int = RARER):
        spark = texts.sparkSession
        paper = F.col("paper_id") if "paper_id" in texts.columns else F.lit(None).cast("string").alias("paper_id")
        self.texts = texts.select("chunk_id", paper, "text").where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
        self.rarer = rarer
        at = f"{shared_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"
        scanned(self.texts).write.partitionBy("kind").parquet(at)
        self.rows = spark.read.schema(_SQL_SCHEMA).parquet(at)
        kind = lambda k: self.rows.where(F.col("kind") == k)
        self.words = cut(kind("count").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_joined").alias("n_joined")))
        self.fixes = cut(corrections(self.words, rarer))
        self.edges = cut(edge_lines(kind("line"), papers))
        self.breaks = self._breaks(kind("break"))

    def _breaks(self, rows: DataFrame) -> DataFrame:
        """``chunk_id, a, b, joined, divided, open``: halves, and whether they are one word without a hyphen.

        They are if the joined word is at least as frequent as the hyphenated one, or if neither is in use and the second
        half is neither the second part of compounds in use nor a common word. A common word after the hyphen leaves it
        ``open``, as in a pair that shares its second part. Halves with lines between them that are no edge lines are
        none.
        """
        b = rows.select("chunk_id", "a", "b", "through").distinct()
        gone = self.edges.select("chunk_id", F.col("line").alias("between"), F.lit(True).alias("edge")).distinct()
        far = b.where(F.size("through") > 0).select("chunk_id", "a", "b", "through", F.explode("through").alias("between")).join(gone, ["chunk_id", "between"], "left")
        far = far.groupBy("chunk_id", "a", "b", "through").agg(F.every(F.coalesce("edge", F.lit(False))).alias("ok")).where("ok")
        b = b.where(F.size("through") == 0).select("chunk_id", "a", "b").unionByName(far.select("chunk_id", "a", "b")).distinct()
        b = b.select("chunk_id", "a", "b", F.lower(F.concat("a", "b")).alias("joined"), F.lower(F.concat("a", F.lit("-"), "b")).alias("compound"), F.lower("b").alias("tail"))
        one = self.words.where(~F.col("word").contains("-") & (F.col("n") > 0))
        two = self.words.where(F.col("word").rlike("^[^-]+-[^-]+$"))
        tails = two.groupBy(F.substring_index("word", "-", -1).alias("tail")).agg(F.sum("n").alias("n_tail")).where(F.col("n_tail") >= 2)
        j = b.join(one.select(F.col("word").alias("joined"), F.col("n").alias("n_one")), "joined", "left").join(two.select(F.col("word").alias("compound"), F.col("n").alias("n_two")), "compound", "left").join(tails, "tail", "left")
        j = j.join(one.select(F.col("word").alias("tail"), F.col("n").alias("n_word")), "tail", "left")
        n1, n2 = F.coalesce("n_one", F.lit(0)), F.coalesce("n_two", F.lit(0))
        unknown = (n1 == 0) & (n2 == 0)
        common = (F.coalesce("n_word", F.lit(0)) >= self.rarer) & (F.col("b") == F.col("tail"))
        return j.select("chunk_id", "a", "b", "joined", F.when(unknown, F.col("n_tail").isNull() & ~common).otherwise(n1 >= n2).alias("divided"), (unknown & F.col("n_tail").isNull() & common).alias("open"))

    @property
    def damage(self) -> DataFrame:
        header = self.edges.where("header").select("chunk_id", F.lit("running_header").alias("damage"))
        number = self.edges.where("number").select("chunk_id", F.lit("page_number").alias("damage"))
        broken = self.breaks.where("divided").select("chunk_id", F.lit("hyphen_break").alias("damage"))
        return header.unionByName(number).unionByName(broken).unionByName(self.misread.select("chunk_id", F.lit("misread_char").alias("damage"))).distinct()

    @property
    def misread(self) -> DataFrame:
        """``chunk_id, word, right`` of every misread word, also those put together from two lines."""
        fixes = if_small(self.fixes)
        words = self.rows.where(F.col("kind") == "words").select("chunk_id", F.explode("words").alias("word")).join(fixes, "word")
        kept = self.rows.where(F.col("kind") == "line").select("chunk_id", "line", "words").join(self.edges, ["chunk_id", "line"], "left_anti").select("chunk_id", F.explode("words").alias("word"))
        together = self.breaks.where("divided").select("chunk_id", F.col("joined").alias("word"))
        apart = self.breaks.where(~F.col("divided")).select("chunk_id", F.explode(F.array(F.lower("a"), F.lower("b"))).alias("word"))
        others = kept.unionByName(together).unionByName(apart).join(fixes, "word")
        return words.unionByName(others).select("chunk_id", "word", "right").distinct()

    @property
    def repaired(self) -> DataFrame:
        """``chunk_id, text``: the damaged chunks as continuous paragraphs, repaired."""
        fixes = self.misread.groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fixes"))
        keep = self.breaks.where(~F.col("divided")).groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("joined", F.when(F.col("open"), "- ").otherwise("-")))).alias("compounds"))
        gone = self.edges.groupBy("chunk_id").agg(F.collect_set("line").alias("edges"))  # lines of one text
        hurt = self.damage.select("chunk_id").distinct()
        rows = self.texts.dropDuplicates(["chunk_id", "text"]).join(hurt, "chunk_id", "left_semi")
        rows = rows.join(fixes, "chunk_id", "left").join(keep, "chunk_id", "left").join(gone, "chunk_id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = {x: batch.column(x).to_pylist() for x in batch.schema.names}
                text = [repair(t, dict(f or ()), dict(k or ()), set(e or ())) for t, f, k, e in zip(c["text"], c["fixes"], c["compounds"], c["edges"], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(text, pa.string())], ["chunk_id", "text"])

        return rows.select("chunk_id", "text", "fixes", "compounds", "edges").mapInArrow(run, "chunk_id string, text string")


_ITEM = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|\||#|>|```|\[\d+\]\s)")


def repair(text: str, fixes: dict[str, str], compounds: dict[str, str] | None = None, edges: set[str] | frozenset[str] = frozenset()) -> str:
    """Continuous paragraphs: edge lines out, divided words and wrapped lines joined, misread words corrected.

    ``edges`` are the lines to take out, no other is. ``compounds`` maps joined forms that keep their hyphen to how: `-`,
    or `- ` before a word of its own. A blank line ends a paragraph unless edge lines stood there or the paragraph breaks
    off inside a word; list items, table rows and headings keep lines of their own.
    """
    paragraphs: list[str] = []
    now, gap, noise = "", False, False
    for line in text.split("\n"):
        s = line.strip()
        if s and s in edges:
            noise = True
            continue
        if not s:
            gap = True
            continue
        m = _BREAK.search(now) if now and now[-1] in HYPHENS else None
        head = _NEXT.match(s)
        if m and head:
            now = now[:-1] + (compounds or {}).get((m[1] + head[0]).lower(), "") + s
        elif not now:
            now = s
        elif _ITEM.match(line) or _ITEM.match(now):
            paragraphs.append(now)
            now = s if not gap else "\n" + s
        elif gap and not (noise and now[-1] not in ".!?:"):
            paragraphs.append(now)
            now = "\n" + s
        else:
            now += " " + s
        gap = noise = False
    if now:
        paragraphs.append(now)
    joined = "\n".join(paragraphs)
    return _NAME.sub(lambda w: _cased(w[0], fixes), joined) if fixes else joined


_NAME = re.compile(r"[^\W_]+")


def _cased(word: str, fixes: dict[str, str]) -> str:
    right = fixes.get(word.lower())
    if right is None or _INNER_CAPITAL.search(word):
        return word
    return right.upper() if word.isupper() and len(word) > 1 else right.capitalize() if word[0].isupper() else right
