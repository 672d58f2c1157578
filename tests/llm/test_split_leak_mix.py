import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import leak, mix, split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,;", max_size=900), st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limits(text, limit, overlap):
    spans = split.split_balanced(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in spans)
    for (s, e), (t, f) in zip(spans, spans[1:], strict=False):
        assert s < t <= e < f and e - t <= overlap
    assert "".join([text[slice(*spans[0])], *[text[max(e, t) : f] for (_, e), (t, f) in zip(spans, spans[1:], strict=False)]]) == text


def test_cuts_fall_on_natural_boundaries():
    text = " ".join("This is a sentence of some length." for _ in range(100))
    spans = split.split_balanced(text)
    assert all(text[:e].rstrip().endswith(".") for _, e in spans)
    sizes = [e - s for s, e in spans]
    assert max(sizes[:-1]) - min(sizes) < 300
    assert [e - s for s, e in split.split_balanced("x" * 2500)] and all(e - s <= 1200 for s, e in split.split_balanced("x" * 2500))


def test_sections_over_the_limit(spark, rows):
    p = spark.createDataFrame([("p", "intro\n\n# A\n" + "word. " * 300 + "\n# B\nshort"), ("q", None), ("r", ""), ("p2", "가" * 1201)], "paper_id string, text string").withColumn("section", F.lit("clash"))
    pieces = split.split_sections(p)
    assert rows(split.oversized(pieces)) == [("p", 1), ("p2", 0)]
    got = pieces.where("paper_id = 'p'").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and all(r["n_chars"] == len(r["text"]) <= 1200 and r["overlap"] <= 150 for r in got)
    assert split.split_sections(p.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_balanced("x", 10, 10)


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu".split()) for _ in range(n))


def test_block_max_wand_loses_nothing():
    r = random.Random(5)
    texts = [words(r, 40) for _ in range(120)]
    index = leak.build_index(list(range(120)), texts, run=2)
    for _ in range(40):
        q = words(r, 60) + " " + " ".join(texts[r.randrange(120)].split()[5:30])
        runs, _ = leak.distinct_runs([q], 2)
        import numpy as np

        terms = np.flatnonzero(np.isin(index.terms, runs)).tolist()
        want = {i for i, s in leak.documents_scored(index, q, 2).items() if s >= 1 - 1e-9}
        assert {i for i, _ in leak.wand(index, terms)} == want


def brute(docs, items):
    runs = lambda t: {tuple(w[i : i + 4]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 3)}
    return sorted((d, i) for d, t in docs for i, s in items if s and runs(s) and 3 * len(runs(s) & runs(t)) >= len(runs(s)))


@pytest.mark.parametrize("most", [10, 10**6])
def test_leaks_equal_brute_force(spark, rows, most):
    r = random.Random(7)
    items = [(i, words(r, r.choice([2, 6, 15, 40]))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        t = words(r, r.choice([0, 5, 80]))
        if d % 3 == 0:
            w = items[d % 30][1].split()
            t += " XX " + " ".join(w[: max(4, len(w) // 2)]).upper() + "\n" + t
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, " ".join(x for _, x in items if x))]
    found = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id bigint, text string"), most_postings=most)
    assert sorted((x["doc_id"], x["item_id"]) for x in found.collect()) == brute(docs, items)


def test_leak_report_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "question", "test", "a b c d e")], "item_id bigint, item_kind string, split_name string, text string")
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c d e")], "doc_id bigint, text string")
    r = leak.leak_report(leak.leaks(docs, items), items).collect()
    assert [tuple(x) for x in r] == [(1, "question", "test", 2, 1.0)]
    assert leak.leaks(docs.limit(0), items).count() == 0 and leak.leaks(docs, items.limit(0)).count() == 0


def test_water_filling():
    sizes = {"a": 100, "b": 10, "c": 50}
    got = mix.water_fill(sizes, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 3), "d": (0.3, 2)}, 100)
    assert got["b"] == 20 and got["d"] == 0 and got["a"] == pytest.approx(80 * 5 / 6) and sum(got.values()) == pytest.approx(100)
    assert mix.water_fill(sizes, {"a": (0.5, 1), "b": (0.5, 1)}, 10_000) == {"a": 100.0, "b": 10.0}
    assert mix.water_fill({}, {"a": (1.0, 1)}) == {"a": 0.0}


def test_mix_reaches_its_shares(spark):
    r = random.Random(3)
    rows_ = [(i, "big" if i % 3 else "small", r.randint(1, 40)) for i in range(3000)] + [(9001, None, 50), (9002, "other", 50), (9003, "big", 0)]
    t = spark.createDataFrame(rows_, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.7, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    for buckets in (4, 4096):
        m = mix.mix_sources(t, targets, buckets=buckets)
        assert m.groupBy("doc_id").count().where("count > 1").count() == 0 and m.agg(F.max("copies")).first()[0] <= 2
        sums = {x["source"]: x["s"] for x in m.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("s")).collect()}
        plan = mix.water_fill({"big": sum(n for _, s, n in rows_ if s == "big"), "small": sum(n for _, s, n in rows_ if s == "small")}, {"big": (0.3, 2), "small": (0.7, 2), "none": (0.1, 2)})
        assert all(0 <= plan[s] - sums[s] <= 40 for s in sums) and set(sums) == {"big", "small"}
    shares = {x["source"]: x for x in mix.mix_shares(m, t, targets).collect()}
    assert set(shares) == {"big", "small", "none", "other", None} and sum(x["actual_share"] for x in shares.values()) == pytest.approx(1, abs=1e-5)
    assert shares["other"]["mix_tokens"] == 0 and shares["none"]["n_documents"] == 0
    assert sorted(map(tuple, mix.mix_sources(t, targets).collect())) == sorted(map(tuple, mix.mix_sources(t.repartition(5), targets).collect()))


def test_token_counts_round_trip(spark):
    enc = mix._encoding(f"{mix.TOKENIZERS}/{mix.VOCABULARY}")
    texts = ["Hello world, it's 2024!", "", None, "형태소 분석기 <|endoftext|>"]
    got = {x["doc_id"]: x["n_tokens"] for x in mix.count_tokens(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")).collect()}
    assert got[1] == got[2] == 0 and all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t) and got[0] == len(enc.encode_ordinary(texts[0]))
    e = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix.mix_sources(e, t).count() == 0 and mix.mix_shares(mix.mix_sources(e, t), e, t).count() == 1
