import uuid

from pyspark.sql import functions as F

from paperloom.functions import ids, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).collect()[0][0]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.col("t")), t="The Graph of X in 2024: 그래프 와 이") == ["graph", "2024", "그래프"]
    assert one(spark, text.tokenize(F.col("t")), t="") == []


def test_keys(spark):
    assert one(spark, text.evidence_key(F.col("t")), t="  A  b\n C ") == "a b c"
    assert one(spark, text.triple_key(F.col("t")), t=" Uses_Method  X ") == "uses method x"
    assert one(spark, text.name_key(F.col("t")), t="  Straße\tＡ ") == "strasse a"


def test_headings_and_markdown(spark):
    assert one(spark, text.clean_heading(F.col("t")), t="**1  Intro** `x`") == "1 Intro x"
    assert one(spark, text.clean_heading(F.col("t")), t="**") == "Front Matter"
    for t, yes in (("7 References", True), ("Preference study", False), ("A long heading on reference sets", False), ("참고문헌", True), ("", False)):
        assert one(spark, text.is_references_heading(F.col("t")), t=t) is yes
    assert one(spark, text.clean_markdown(F.col("t")), t=" ![a](b)[c](d)\n\n\n\ne ") == "c\n\ne"


def test_arxiv_ids(spark):
    t = "arXiv: 1706.03762v5, https://arxiv.org/abs/2001.00001, abs/9999.99999, arxiv.org/pdf/cs.LG/0301001 arxiv:1706.03762"
    assert one(spark, text.arxiv_ids(F.col("t"), F.lit("arxiv:2001.00001v2")), t=t) == ["1706.03762", "cs.lg/0301001"]


def test_sentences_and_terms(spark):
    assert one(spark, text.first_sentence(F.col("t")), t="One two. Three.") == "One two."
    assert one(spark, text.first_sentence(F.col("t")), t="") is None
    assert one(spark, text.first_sentences(F.col("t"), 2), t="A! B? C.") == "A! B?"
    assert one(spark, text.join_terms(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, text.join_terms(F.array().cast("array<string>"))) == "this topic"


def test_bodies(spark):
    long = "x" * 600
    assert one(spark, text.body_problem(F.col("t"), F.lit(200), F.lit("text/plain")), t="URL: y\nMarkdown Content:\n" + long) is None
    assert one(spark, text.body_problem(F.col("t"), F.lit(200), F.lit("text/plain")), t="<!DOCTYPE html>" + long) == "markup"
    assert one(spark, text.body_problem(F.col("t"), F.lit(404), F.lit("")), t=long) == "status"
    assert one(spark, text.body_problem(F.col("t"), F.lit(200), F.lit("")), t="short") == "short"


def test_ids(spark):
    got = [one(spark, ids.paper_id(F.lit(a), F.lit(r))) for a, r in ((None, "1706.03762"), (None, "community-paper"), (None, "hf:x"), ("1706.03762", "z"))]
    assert got == ["arxiv:1706.03762", "hf:community-paper", "hf:x", "arxiv:1706.03762"]
    assert one(spark, ids.uuid5(F.lit("a chunk"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a chunk"))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    e = vectors.TermHashing(64)
    assert e.embed("graph Graph retrieval") == e.embed("retrieval graph GRAPH")
    assert abs(sum(x * x for x in e.embed("graph")) - 1) < 1e-6
    assert not any(e.embed(None))
