import json
import urllib.error

import pytest

from paperloom.sources import benchmarks, feeds


def test_get_json_retries_only_what_may_pass():
    calls, waits = [], []

    class Body:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b'{"a": 1}'

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "x", None, None)
        return Body()

    assert feeds.get_json("u", flaky, sleep=waits.append) == {"a": 1} and waits == [1.0, 2.0]

    def gone(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "x", None, None)

    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        feeds.get_json("u", gone, sleep=waits.append)
    assert len(calls) == 1


def test_pages_go_on_while_there_is_a_next_one():
    pages = {0: ([{}] * 50, True), 1: ([{}] * 3, True), 2: ([{}] * 4, False)}
    page = lambda u: int(u.split("p=")[1].split("&")[0])
    assert len(feeds.list_day("2024-01-01", lambda u: pages[page(u)], "b")) == 57
    assert len(feeds.list_day("2024-01-01", lambda u: ([{}] if page(u) < 2 else [], True), "b")) == 2
    with pytest.warns(UserWarning, match="more than 3 pages"):
        assert len(feeds.list_day("2024-01-01", lambda u: ([{}], True), "b", pages=3)) == 3
    with pytest.raises(feeds.FeedError):
        feeds.list_day("2024-01-01", lambda u: ({}, False), "b")


def test_single_papers(spark):
    def get(url):
        return {"id": "2401.00001", "title": "T"} if url.endswith("2401.00001") else []

    raw = feeds.get_papers(spark.createDataFrame([("2401.00001",), ("x",)], "paper_id string"), get, "b")
    assert sorted((r["error"] or "") for r in raw.collect()) == ["", "FeedError: the paper x is no object"]
    assert [r["title"] for r in feeds.flatten_feed(raw).collect()] == ["T"]


def test_a_body_that_is_no_json_fails_at_once():
    class Body:
        headers = {"link": '<b?p=1>; rel="next"'}

        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return self.body

    with pytest.raises(feeds.FeedError):
        feeds.get_json("u", lambda u: Body(b"<html>"), sleep=lambda s: None)
    assert feeds.get_page("u", lambda u: Body(b"[1]")) == ([1], True)


def test_feed(spark):
    def _day(day):
        if day == "2024-01-02":
            raise OSError("down")
        return [{"paper": {"id": "2401.00001", "title": "T", "authors": [{"name": "A"}, {"name": None}, {}], "publishedAt": "2024-01-01T10:00:00Z"}}, {"id": "community", "title": "C", "summary": "S"}, {"title": "no id"}]

    raw = feeds.feed_days(spark, "2024-01-01", "2024-01-03", _day)
    assert raw.where("error IS NOT NULL").select("day").collect()[0][0] == "2024-01-02"
    p = {r["raw_id"]: r for r in feeds.flatten_feed(raw).where("day = '2024-01-01'").collect()}
    assert p["2401.00001"]["authors"] == ["A"] and p["2401.00001"]["arxiv_id"] == "2401.00001" and p["2401.00001"]["published_at"] is not None
    assert p["community"]["abstract"] == "S" and p["community"]["arxiv_id"] is None and len(p) == 2
    with pytest.raises(ValueError):
        feeds.feed_days(spark, "2024-01-03", "2024-01-01", _day)


@pytest.mark.parametrize("body", ['[{"a": 1}, {"a": 2}]', '{"a": 1}\n{"a": 2}\n', '{"rows": [{"a": 1}, {"a": 2}]}', '\n{"data": [{"a": 1, "z": 3}, {"a": 2}]}'])
def test_envelopes(spark, rows, tmp_path, body):
    (tmp_path / "f.json").write_text(body)
    assert rows(feeds.read_envelope(spark, str(tmp_path / "f.json"), "a int")) == [(1,), (2,)]


def test_one_object_is_an_envelope_too(spark, rows, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 7}')
    assert rows(feeds.read_envelope(spark, str(tmp_path / "f.json"), "a int")) == [(7,)]


def test_cases(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('// note\n\n{"case_id": "b", "question": "q"}\n{"case_id": "a", "question": "q", "grades": {"x": 2}}\n')
    assert [r["case_id"] for r in feeds.load_cases(spark, str(f)).collect()].sort() == ["a", "b"].sort()
    assert feeds.load_cases(spark, str(f), 1).collect()[0]["case_id"] == "a"
    for bad, match in (('{"case_id": "a"\n', "no evaluation case"), ('{"case_id": "a"}\n{"case_id": "a"}\n', "repeated"), ("\n", "no cases")):
        f.write_text(bad)
        with pytest.raises(ValueError, match=match):
            feeds.load_cases(spark, str(f))


def test_baseline_and_config(spark, rows, tmp_path):
    assert feeds.read_baseline(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"aggregate": {"x": 1}}))
    assert rows(feeds.read_baseline(spark, str(tmp_path / "b.json"))) == [("x", 1.0)]
    assert feeds.expand({"a": ["${X:-d}/${Y}"], "b": 1}, {"Y": "y"}) == {"a": ["d/y"], "b": 1}


def test_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in feeds.read_pdfs(spark, str(tmp_path), lambda b: "text").collect()}
    assert got["a.pdf"] == ("text", None) and "not a PDF" in got["b.pdf"][1]


def test_event_stream(spark, rows):
    df = spark.createDataFrame([('data: {"t": 1}',), ("data: [DONE]",), (": ping",), ("",)], "value string")
    assert rows(feeds.sse_events(df)) == [('{"t": 1}',)]


def test_qasper(spark):
    para = "Kernel methods estimate densities very well in practice."
    row = {"id": "1234.5678", "title": "T", "abstract": "An abstract that is certainly longer than forty characters.", "full_text": {"section_name": ["S"], "paragraphs": [[para, "short"]]}, "qas": {"question": ["Q?", "U?"], "question_id": ["1", "2"], "answers": [{"answer": [{"unanswerable": False, "evidence": [para], "free_form_answer": "", "extractive_spans": ["a", "b"]}]}, {"answer": [{"unanswerable": True, "evidence": [], "free_form_answer": "", "extractive_spans": []}]}]}}
    df = spark.createDataFrame([row], benchmarks.QASPER)
    chunks, cases = benchmarks.qasper(df)
    assert [r["section"] for r in chunks.orderBy("chunk_index").collect()] == ["Abstract", "S"]
    c = cases.collect()
    assert len(c) == 1 and c[0]["gold_answer"] == "a; b" and len(c[0]["gold_chunk_ids"]) == 1 and c[0]["expected_scope"] == "selected"


def test_multihop(spark):
    body = "First fact about kernels is stated here plainly. " * 2
    corpus = spark.createDataFrame([("A", "http://x/a/", "c", body), ("B", None, "c", "Second fact about graphs is stated here plainly too, at length."), ("C", "u", "c", None)], benchmarks.HOP_CORPUS)
    q = {"query": "Which?", "question_type": "t", "answer": "yes", "evidence_list": [{"fact": "first fact about kernels", "url": "http://x/a", "title": "?"}, {"fact": "second fact about graphs", "url": None, "title": "b"}]}
    chunks, cases = benchmarks.multihop(corpus, spark.createDataFrame([q], benchmarks.HOP_QUERIES))
    c = cases.collect()
    assert chunks.count() == 2 and len(c) == 1 and len(c[0]["gold_paper_ids"]) == 2 and c[0]["expected_scope"] == "global"


def test_graph_bench_and_imports(spark):
    body = "Kernel fact number one is stated right here in full. " * 2
    corpus = spark.createDataFrame([("A", None, "", body, None, None), (None, None, None, None, None, None)], benchmarks.GRAPH_CORPUS)
    q = spark.createDataFrame([("1", "Which?", "one", "t", ["kernel fact number one"]), ("2", "No?", None, "t", ["absent words only"]), ("3", "", "x", "t", None)], benchmarks.GRAPH_QUESTIONS)
    chunks, cases = benchmarks.graph_bench(corpus, q)
    c = cases.collect()
    assert len(c) == 1 and c[0]["expected_scope"] == "selected" and chunks.count() == 1
    none, answers = benchmarks.graph_bench(None, q)
    assert none.count() == 0 and [r["expected_scope"] for r in answers.collect()] == ["unknown"]
    rows_ = spark.createDataFrame([("U?", "r", ["kernel fact number one is"]), ("V?", "r", ["nothing of it"])], "user_input string, reference string, reference_contexts array<string>")
    assert [r["tags"] for r in benchmarks.imported_cases(rows_, chunks).collect()] == [["single-hop", "local"]]


def test_imported_conversion_writes_no_texts(spark, monkeypatch):
    from paperloom.plans import records as plans

    written = []
    cut = plans.cut
    monkeypatch.setattr(plans, "cut", lambda df: written.append(df.columns) or cut(df))
    assert plans.imported_conversion(spark, "/root/testdata/sf0.001").columns == ["case_id", "question", "gold_chunk_ids", "gold_paper_ids", "expected_scope", "tags"]
    assert not [c for c in written if "text" in c]
