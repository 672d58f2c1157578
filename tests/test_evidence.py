import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import STOPWORDS
from paperloom.operators import evidence as E

SCHEMA = "chunk_id string, paper_id string, chunk_index int, text string"


def tokens(t):
    import re

    return list(dict.fromkeys(x for x in re.findall("[a-z0-9]+|[가-힣]+", t) if len(x) > 1 and x not in STOPWORDS))


def by_hand(evidence, chunks, least=0.75):
    """Every evidence text against every chunk."""
    key = lambda t: " ".join((t or "").split()).lower()
    out = []
    for i, want, text in evidence:
        e, best = key(text), None
        if not e or e.startswith("float selected"):
            continue
        for cid, paper, index, body in chunks:
            c = key(body)
            if not c:
                continue
            here, score, tier = want is None or want == paper, 1.0, None
            et, ct = tokens(e), set(tokens(c))
            share = round(sum(t in ct for t in et) / len(et), 6) if et else 0.0
            if e == c:
                tier = 1
            elif here and e in c:
                tier = 2
            elif here and c in e:
                tier = 3
            elif here and share >= least:
                tier, score = 4, share
            if tier and (best is None or (tier, -score, paper, index, cid) < best):
                best = (tier, -score, paper, index, cid)
        if best:
            out.append((i, best[4], best[0], -best[1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = ["graph", "neural", "of", "the", "a", "x", "그래프", "model2", "retrieval", "sparse", "b-c", "index", "(deep)", "tree"]
    chunks = [(f"c{i:02}", f"p{i % 4}", i // 4, "  ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 8, 20])))) for i in range(60)]
    chunks += [("n", "p1", 0, None), ("e", "p1", 1, ""), ("l", "p2", 99, "graph " * 20_000)]
    ev = []
    for i in range(50):
        body = r.choice(chunks)[3] or ""
        a = r.randrange(len(body[:200]) + 1)
        text = r.choice([body, body[a : a + r.randint(1, 60)].upper(), " ".join(r.choice(vocab) for _ in range(r.randint(1, 9))), "so " + body[:100] + " it", ""])
        ev.append((f"e{i:02}", r.choice([None, "p0", "p1", "p2", "gone"]), text))
    ev += [("f", None, "FLOAT SELECTED: x"), ("z", None, None)]
    df = spark.createDataFrame(ev, "evidence_id string, paper_id string, text string").withColumns({"t": F.lit("clash"), "c": F.lit(1)})
    got = E.match_evidence(df, spark.createDataFrame(chunks, SCHEMA).repartition(3).withColumn("t", F.lit("clash")))
    assert sorted(map(tuple, got.collect())) == by_hand(ev, chunks)


def test_empty_sides(spark):
    ev = spark.createDataFrame([("a", None, "graph")], "evidence_id string, paper_id string, text string")
    c = spark.createDataFrame([], SCHEMA)
    assert E.match_evidence(ev, c).count() == 0 and E.match_evidence(ev.limit(0), c).count() == 0
    assert E.conversion_report(ev.limit(0), E.match_evidence(ev.limit(0), c)).first()["match_rate"] == 1.0


def test_only_what_is_asked_is_written(spark, monkeypatch):
    written = []
    cut = E.cut
    monkeypatch.setattr(E, "cut", lambda df: written.append(made := cut(df)) or made)
    body = " ".join(f"word{i} model{i}" for i in range(200))
    ev = spark.createDataFrame([("a", None, body + " end"), ("b", None, body)], "evidence_id string, paper_id string, text string")
    c = spark.createDataFrame([("c", "p", 0, body), ("d", "p", 1, "x " + body)], SCHEMA)
    assert sorted(map(tuple, E.match_evidence(ev, c).collect())) == [("a", "c", 3, 1.0), ("b", "c", 1, 1.0)]
    assert max(df.count() for df in written) < 1000
