"""Evaluation queries: a baseline run, its metrics, gates, evidence matching and test generation.

The run scored here answers each case with the first chunks of its paper: rank by index, answer from the first sentences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import first_sentence
from paperloom.functions.vectors import TermHashing
from paperloom.operators import evidence, graph, metrics, targets, testgen
from paperloom.plans.network import _G, _cites
from paperloom.plans.search import _BM25, CASES, CHUNKS, asked, cases, corpus, current_among, current_chunks, tok
from paperloom.session import cut, spread
from paperloom.sources.tables import table


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with the response of the baseline: at most ten chunks of the case's paper, three citations."""
    first = graph.first_chunks(current_chunks(spark, sf, "paper_id", "chunk_index", "is_references", "text").where(~F.col("is_references")), 10)
    per = first.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))).alias("hits"))  # at most ten rows
    j = cases(spark, sf).join(per, "paper_id", "left")
    said = F.array_compact(F.transform(F.slice("hits", 1, 2), lambda h: first_sentence(h["text"])))
    ids = F.transform("hits", lambda h: h["chunk_id"])
    return j.select(
        "case_id", "question", "gold_chunk_ids", "gold_paper_ids", "grades", "expected_scope", "gold_answer", "must_include", "gold_triples", "tags",
        ids.alias("ranked"), F.transform("hits", lambda h: F.col("paper_id")).alias("papers"), F.transform("hits", lambda h: h["text"]).alias("evidence"),
        F.array_join(said, " ").alias("answer"), F.slice(ids, 1, 3).alias("citations"), F.when(F.col("hits").isNotNull(), "selected").otherwise("global").alias("scope"),
    )


def _ir(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.retrieval_metrics(responses(spark, sf))


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounded(_ir(spark, sf))


def gen_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounded(metrics.generation_metrics(responses(spark, sf)))


def triple_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Gold triples against predictions in which every other predicate is wrong."""
    g = cases(spark, sf).select("case_id", F.posexplode("gold_triples").alias("i", "t")).select("case_id", "i", "t.*")
    p = g.where(F.col("i") < 3).withColumn("predicate", F.when(F.col("i") % 2 == 1, "RELATES_TO").otherwise(F.col("predicate")))
    return metrics.rounded(metrics.triple_metrics(p, g))


def macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_mean(_ir(spark, sf))


def metrics_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    tags = cases(spark, sf).select("case_id", F.explode("tags").alias("tag"))
    return metrics.by_tag(_ir(spark, sf), tags)


def operational_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", "error").alias("error"))
    return metrics.operational(e)


RULES = (("recall@5", 0.05, None, 0.03), ("ndcg@10", None, None, 0.001), ("mrr", 0.9, None, None), ("routing.accuracy", 0.1, 0.99, None), ("no_such_metric", 0.5, None, None))


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The run over the cases of the first half of the alphabet of ids."""
    return metrics.macro_mean(_ir(spark, sf).where(F.col("case_id") < "gen-sh"))


def gate_eval(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "metric string, least double, most double, max_regression double")
    return metrics.gates(rules, macro_mean(spark, sf), _baseline(spark, sf))


def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.deltas(macro_mean(spark, sf), _baseline(spark, sf))


def worst_cases(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounded(metrics.worst_cases(_ir(spark, sf), "recall@10"))


def _evidence(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """Gold answers of the asked or of all cases, and the texts of their gold chunks cut in half."""
    a = cases(spark, sf)
    a = a if every else a.where(F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint") % 50 == 0)
    said = a.where(F.length("gold_answer") > 0).select(F.concat("case_id", F.lit("/answer")).alias("evidence_id"), "paper_id", F.col("gold_answer").alias("text"))
    gold = a.select("case_id", "paper_id", F.explode("gold_chunk_ids").alias("chunk_id"))
    gold = gold.join(current_among(spark, sf, gold, "text"), "chunk_id")
    half = gold.select(F.concat("case_id", F.lit("/"), "chunk_id").alias("evidence_id"), F.lit(None).cast("string").alias("paper_id"), F.expr("left(text, length(text) div 2)").alias("text"))
    return said.unionByName(half.distinct())


def _matches(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    """Matches of evidence among the current chunks, whose texts stay where they are."""
    version = F.xxhash64("paper_id", "chunk_index", "text").alias("version")
    every = spread(table(spark, sf, "chunks").select("chunk_id", version, "paper_id", "chunk_index", "text"))
    return evidence.match_evidence(e, every, live=current_chunks(spark, sf, version))


def evidence_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, _evidence(spark, sf))


def conversion_report(spark: SparkSession, sf: str) -> DataFrame:
    e = cut(_evidence(spark, sf, every=True))
    return evidence.conversion_report(e, _matches(spark, sf, e))


def run_lexical(spark: SparkSession, sf: str, all_cases: bool = False) -> targets.Run:
    """Retrieval and answers of BM25 for the asked or for all cases, scored."""
    every, live = corpus(spark, sf)
    number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint")
    told = cases(spark, sf) if all_cases else cases(spark, sf).where(number % 50 == 0)
    run = targets.run_suite(targets.LexicalTarget(every, live), told, "retrieval")
    run.values = run.values.unionByName(targets.score(told.join(run.responses, "case_id"), "generation"))
    return run


def run_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounded(run_lexical(spark, sf).values)


def run_bm25_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounded(run_lexical(spark, sf).aggregate(), "mean")


def run_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The same for vectors of hashed terms joined with citation expansion."""
    e = TermHashing(256)
    c = current_chunks(spark, sf, "paper_id", "is_references", "text").where(~F.col("is_references"))
    points = cut(c.select(F.col("chunk_id").alias("id"), e.udf()("text").alias("embedding"), F.col("paper_id").alias("grp"), F.lit(True).alias("is_global")))
    near = graph.both_ways(_cites(spark, sf)).select(F.col("paper_id").alias("grp"), "related")
    number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint")
    t = targets.HybridTarget(points, near, c.select(F.col("chunk_id").alias("id"), "text"), e.udf())
    return metrics.rounded(targets.run_suite(t, cases(spark, sf).where(number % 50 == 0), "full").values)


def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """One row: gates, failed ones, and whether all passed."""
    return metrics.verdict(gate_eval(spark, sf))


def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return testgen.key_terms(current_chunks(spark, sf, "text")).select("chunk_id", F.array_join("terms", ",").alias("terms"))


def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return testgen.round_robin(current_chunks(spark, sf, "paper_id"), 40).select("chunk_id", "paper_id", "turn")


def _shown(made: DataFrame) -> DataFrame:
    """Generated cases with lists as text."""
    listed = {c: F.array_join(c, ",") for c in ("gold_chunk_ids", "gold_paper_ids", "tags")}
    return made.withColumns(listed | {"grades": F.array_join(F.map_values("grades"), ",")})


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return current_chunks(spark, sf, "paper_id", "text", "section")


def _first_links(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """The first citation links between chunks, in order of ids: of 2 n, n are left when either direction of a pair goes."""
    edges = graph.first_cites_chunk_edges(current_chunks(spark, sf, "paper_id"), _cites(spark, sf), 2 * n)
    return edges.select("source", "target", F.lit("cites").alias("type"), F.lit(None).cast("double").alias("score"))


def testgen_single_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(testgen.single_hop(_sources(spark, sf), 20))


def testgen_multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(testgen.multi_hop(_first_links(spark, sf, 20), _sources(spark, sf), 20))


def testgen_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A set of 30 cases, a third of them of one chunk."""
    return _shown(testgen.generate(_first_links(spark, sf, 20), _sources(spark, sf), 30, 1 / 3))


QUERIES = {f.__name__: f for f in (ir_metrics, gen_metrics, triple_metrics, macro_mean, metrics_by_tag, operational_summary, gate_eval, baseline_delta, worst_cases, evidence_match, conversion_report, key_terms, round_robin_sample, testgen_single_hop, testgen_multi_hop, testgen_cases, run_bm25, run_bm25_summary, run_hybrid, gate_verdict)}

#: Metrics of rows r: cases with ranked ids R, texts E, papers ps and scope sc.
_IR = """
 g AS (SELECT case_id, chunk_id, max(grade) grade FROM (SELECT case_id, unnest(map_keys(grades)) chunk_id, unnest(map_values(grades)) grade FROM r UNION ALL SELECT case_id, x, coalesce(grades[x], 1) FROM (SELECT case_id, grades, unnest(gold_chunk_ids) x FROM r)) GROUP BY 1, 2),
 gold AS (SELECT DISTINCT case_id, chunk_id FROM (SELECT case_id, unnest(gold_chunk_ids) chunk_id FROM r UNION ALL SELECT case_id, chunk_id FROM g WHERE grade > 0)),
 ng AS (SELECT case_id, count(*) n FROM gold GROUP BY 1),
 rk AS (SELECT case_id, unnest(R) chunk_id, generate_subscripts(R, 1) rank FROM r),
 h AS (SELECT rk.*, gold.chunk_id IS NOT NULL hit, coalesce(g.grade, 0) grade FROM rk LEFT JOIN gold USING (case_id, chunk_id) LEFT JOIN g USING (case_id, chunk_id)),
 ks AS (SELECT unnest([1, 3, 5, 10]) k),
 hk AS (SELECT r.case_id, k, count(*) FILTER (h.hit AND h.rank <= k) hits, coalesce(sum((pow(2, h.grade) - 1) / log2(h.rank + 1)) FILTER (h.rank <= k), 0) dcg FROM r CROSS JOIN ks LEFT JOIN h USING (case_id) GROUP BY 1, 2),
 idl AS (SELECT case_id, k, sum((pow(2, grade) - 1) / log2(rr + 1)) FILTER (rr <= k) i FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC) rr FROM g WHERE grade > 0) CROSS JOIN ks GROUP BY 1, 2),
 ir AS (
  SELECT case_id, 'recall@' || k AS metric, hits / n AS value FROM hk JOIN ng USING (case_id)
  UNION ALL SELECT case_id, 'precision@' || k, hits / k FROM hk
  UNION ALL SELECT case_id, 'hit@' || k, CAST(hits > 0 AS INTEGER) FROM hk JOIN ng USING (case_id)
  UNION ALL SELECT case_id, 'ndcg@' || k, dcg / i FROM hk JOIN idl USING (case_id, k)
  UNION ALL SELECT case_id, 'mrr', coalesce(1.0 / min(rank) FILTER (hit), 0) FROM ng LEFT JOIN h USING (case_id) GROUP BY case_id
  UNION ALL SELECT case_id, 'ap', coalesce(sum(cum / rank) FILTER (hit), 0) / any_value(n) FROM ng LEFT JOIN (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY case_id ORDER BY rank) cum FROM h) USING (case_id) GROUP BY case_id
  UNION ALL SELECT case_id, 'paper_hit@5', CAST(len(list_intersect(ps[1:5], gold_paper_ids)) > 0 AS INTEGER) FROM r WHERE len(gold_paper_ids) > 0
  UNION ALL SELECT case_id, 'routing.accuracy', CAST(expected_scope = sc AS INTEGER) FROM r WHERE expected_scope <> 'unknown'),
 m AS (SELECT case_id, metric, CAST(value AS DOUBLE) AS value FROM ir WHERE value IS NOT NULL),
 agg AS (SELECT metric, round(avg(value), 6) AS mean, count(*) AS n_cases FROM m GROUP BY metric),
 base AS (SELECT metric, round(avg(value), 6) AS mean FROM m WHERE case_id < 'gen-sh' GROUP BY metric)
"""
_R = f"""
WITH {CHUNKS}, {CASES},
 f AS (SELECT * FROM (SELECT paper_id, chunk_id, text, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id) pos FROM cur_chunks WHERE NOT is_references) WHERE pos <= 10),
 per AS (SELECT paper_id, list(chunk_id ORDER BY pos) ranked, list(text ORDER BY pos) evidence FROM f GROUP BY paper_id),
 r AS (SELECT c.*, coalesce(ranked, []) R, coalesce(evidence, []) E, CASE WHEN ranked IS NULL THEN 'global' ELSE 'selected' END AS sc, list_transform(coalesce(ranked, []), lambda x: c.paper_id) ps FROM cur_cases c LEFT JOIN per USING (paper_id)),
""" + _IR
_GEN = f"""
 x AS (SELECT case_id, gold_answer, coalesce(must_include, []) M, array_to_string(list_filter(list_transform(E[1:2], lambda t: CASE WHEN trim(split_part(t, '. ', 1)) <> '' THEN regexp_replace(trim(split_part(t, '. ', 1)), '\\.+$', '') || '.' END), lambda t: t IS NOT NULL), ' ') ans, array_to_string(E, chr(10)) ev, R[1:3] C, R, coalesce(gold_chunk_ids, []) G, question FROM r),
 y AS (SELECT case_id, gold_answer, M, ans, C, R, G, {tok('ans')} A, {tok('ev')} V, {tok("coalesce(gold_answer, '')")} T, list_distinct({tok("coalesce(question, '')")}) U FROM x),
 z AS (SELECT *, list_sum(list_transform(list_distinct(A), lambda zt: least(len(list_filter(A, lambda zq: zq = zt)), len(list_filter(T, lambda zq: zq = zt))))) same, len(list_filter(A, lambda zt: list_contains(V, zt))) / nullif(len(A), 0) gr FROM y),
 o AS (
  SELECT case_id, 'groundedness_lexical' metric, gr AS value FROM z
  UNION ALL SELECT case_id, 'answer_token_f1', CASE WHEN same = 0 THEN 0 ELSE 2.0 * same / (len(A) + len(T)) END FROM z WHERE len(gold_answer) > 0 AND len(A) > 0 AND len(T) > 0
  UNION ALL SELECT case_id, 'citation_validity', len(list_filter(C, lambda zc: list_contains(R, zc))) / len(C) FROM z WHERE len(C) > 0
  UNION ALL SELECT case_id, 'citation_precision', len(list_filter(C, lambda zc: list_contains(G, zc))) / len(C) FROM z WHERE len(C) > 0
  UNION ALL SELECT case_id, 'citation_recall', len(list_intersect(G, C)) / len(list_distinct(G)) FROM z WHERE len(G) > 0
  UNION ALL SELECT case_id, 'has_citation', CAST(len(C) > 0 AS INTEGER) FROM z
  UNION ALL SELECT case_id, 'must_include', len(list_filter(M, lambda zp: contains(lower(ans), lower(zp)))) / len(M) FROM z WHERE len(M) > 0
  UNION ALL SELECT case_id, 'judge.faithfulness', CASE WHEN trim(ans) = '' THEN 0 ELSE gr END FROM z
  UNION ALL SELECT case_id, 'judge.relevance', CASE WHEN trim(ans) = '' THEN 0 WHEN len(U) > 0 THEN least(1.5 * len(list_intersect(U, A)) / len(U), 1.0) END FROM z)
"""
SQL = {
    "ir_metrics": _R + "SELECT case_id, metric, round(value, 6) AS value FROM m",
    "macro_mean": _R + "SELECT * FROM agg",
    "metrics_by_tag": _R + "SELECT tag, metric, round(avg(value), 6) AS mean, count(*) AS n_cases FROM m JOIN (SELECT DISTINCT case_id, unnest(tags) tag FROM cur_cases) USING (case_id) GROUP BY tag, metric",
    "operational_summary": """WITH e AS (SELECT value v, event_type = 'error' err FROM events), s AS (SELECT CAST(count(*) AS DOUBLE) case_count, avg(CAST(err AS INTEGER)) error_rate, avg(v) FILTER (NOT err) latency_mean, quantile_cont(v, 0.5) FILTER (NOT err) latency_p50, quantile_cont(v, 0.95) FILTER (NOT err) latency_p95, max(v) FILTER (NOT err) latency_max FROM e)
 SELECT measure, round(value, 6) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME measure VALUE value)""",
    "gate_eval": _R
    + """, rules AS (SELECT * FROM (VALUES ('recall@5', 0.05, NULL, 0.03), ('ndcg@10', NULL, NULL, 0.001), ('mrr', 0.9, NULL, NULL), ('routing.accuracy', 0.1, 0.99, NULL), ('no_such_metric', 0.5, NULL, NULL)) v(metric, least, most, reg))
 , o AS (SELECT rules.metric, agg.mean AS value, base.mean AS base, CASE WHEN agg.mean IS NULL THEN 'missing' WHEN agg.mean < least THEN 'below minimum' WHEN agg.mean > most THEN 'above maximum' WHEN round(base.mean - agg.mean, 6) > reg THEN 'regression' ELSE 'ok' END AS reason FROM rules LEFT JOIN agg USING (metric) LEFT JOIN base ON base.metric = rules.metric)
 SELECT metric, value, base, reason = 'ok' AS passed, reason FROM o""",
    "baseline_delta": _R + "SELECT agg.metric, agg.mean AS value, base.mean AS base, round(agg.mean - base.mean, 6) AS delta FROM agg LEFT JOIN base USING (metric)",
    "worst_cases": _R + "SELECT case_id, metric, round(value, 6) AS value FROM m WHERE metric = 'recall@10' ORDER BY value, case_id LIMIT 5",
    "gen_metrics": f"{_R}, {_GEN} SELECT case_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM o WHERE value IS NOT NULL",
    "triple_metrics": f"""WITH {CASES}, gg AS (SELECT case_id, unnest(gold_triples) t, generate_subscripts(gold_triples, 1) - 1 i FROM cur_cases),
 k AS (SELECT case_id, i, lower(regexp_replace(trim(replace(t.subject, '_', ' ')), '\\s+', ' ', 'g')) s, lower(regexp_replace(trim(replace(t.predicate, '_', ' ')), '\\s+', ' ', 'g')) p, lower(regexp_replace(trim(replace(t.object, '_', ' ')), '\\s+', ' ', 'g')) o, t.chunk_id c FROM gg),
 pr AS (SELECT case_id, s, CASE WHEN i % 2 = 1 THEN 'relates to' ELSE p END p, o, c FROM k WHERE i < 3),
 cs AS (SELECT case_id, s || '|' || p || '|' || o key, 'triple' n, 1 np, 0 ng FROM pr UNION ALL SELECT case_id, s || '|' || p || '|' || o, 'triple', 0, 1 FROM k UNION ALL SELECT case_id, s || '|' || o, 'relaxed', 1, 0 FROM pr UNION ALL SELECT case_id, s || '|' || o, 'relaxed', 0, 1 FROM k),
 c1 AS (SELECT case_id, n, sum(least(np, ng)) hit, sum(np) np, sum(ng) ng FROM (SELECT case_id, n, key, sum(np) np, sum(ng) ng FROM cs GROUP BY ALL) GROUP BY ALL),
 ge AS (SELECT DISTINCT case_id, e FROM (SELECT case_id, s e FROM k UNION ALL SELECT case_id, o FROM k)), pe AS (SELECT DISTINCT case_id, e FROM (SELECT case_id, s e FROM pr UNION ALL SELECT case_id, o FROM pr)),
 u AS (SELECT case_id, n || '_precision' metric, hit / np AS value FROM c1 WHERE np > 0 UNION ALL SELECT case_id, n || '_recall', hit / ng FROM c1 WHERE ng > 0
  UNION ALL SELECT case_id, n || '_f1', CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / np) * (hit / ng) / (hit / np + hit / ng) END FROM c1 WHERE np > 0 AND ng > 0
  UNION ALL SELECT ge.case_id, 'entity_coverage', count(pe.e) / count(*) FROM ge LEFT JOIN pe ON ge.case_id = pe.case_id AND ge.e = pe.e GROUP BY 1
  UNION ALL SELECT case_id, 'evidence_attachment', avg(CASE WHEN length(c) > 0 THEN 1 ELSE 0 END) FROM pr GROUP BY 1)
 SELECT case_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM u""",
    "round_robin_sample": f"WITH {CHUNKS} SELECT chunk_id, paper_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) turn, min(chunk_id) OVER (PARTITION BY paper_id) first FROM cur_chunks) ORDER BY turn, first LIMIT 40",
}
_ASKED = " WHERE CAST(regexp_extract(case_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0"
_EV = f"""{_G},
 a AS (SELECT * FROM cur_cases{_ASKED}),
 ev AS (SELECT case_id || '/answer' evidence_id, paper_id, gold_answer t FROM a WHERE length(gold_answer) > 0
  UNION ALL SELECT DISTINCT case_id || '/' || chunk_id, CAST(NULL AS VARCHAR), left(c.text, length(c.text) // 2) FROM (SELECT case_id, unnest(gold_chunk_ids) chunk_id FROM a) JOIN cur_chunks c USING (chunk_id)),
 e2 AS (SELECT evidence_id, paper_id want, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) e, list_distinct({tok('t')}) et FROM ev),
 c2 AS (SELECT chunk_id, paper_id, chunk_index, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) c, list_distinct({tok('text')}) ct FROM cur_chunks),
 sc AS (SELECT *, want IS NULL OR want = paper_id here, round(len(list_intersect(et, ct)) / nullif(len(et), 0), 6) share FROM e2, c2 WHERE e <> '' AND c <> '' AND NOT starts_with(e, 'float selected')),
 ti AS (SELECT *, CASE WHEN e = c THEN 1 WHEN here AND contains(c, e) THEN 2 WHEN here AND contains(e, c) THEN 3 WHEN here AND share >= 0.75 THEN 4 END tier FROM sc),
 mt AS (SELECT * FROM (SELECT evidence_id, chunk_id, CAST(tier AS INTEGER) AS tier, CASE WHEN tier = 4 THEN share ELSE 1.0 END AS score, row_number() OVER (PARTITION BY evidence_id ORDER BY tier, CASE WHEN tier = 4 THEN -share ELSE -1.0 END, paper_id, chunk_index, chunk_id) rn FROM ti WHERE tier IS NOT NULL) WHERE rn = 1)
"""
SQL |= {
    "evidence_match": _EV + "SELECT evidence_id, chunk_id, tier, score FROM mt",
    "conversion_report": _EV.replace(_ASKED, "") + "SELECT n_evidence, n_matched, round(coalesce(n_matched / nullif(n_evidence, 0), 1.0), 6) AS match_rate, round(coalesce(n_matched / nullif(n_evidence, 0), 1.0), 6) < 0.8 AS warning FROM (SELECT count(*) n_evidence FROM ev), (SELECT count(*) n_matched FROM mt)",
}
_KT = f"""{_G},
 tt AS (SELECT chunk_id, term, count(*) tf FROM (SELECT chunk_id, unnest({tok('text')}) term FROM cur_chunks) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tt GROUP BY term), nn AS (SELECT count(*) n FROM cur_chunks),
 ww AS (SELECT chunk_id, term, df, round(tf * ln(1 + n / (df + 0.5)), 6) w, length(term) >= 5 AND NOT list_contains([{", ".join(f"'{w}'" for w in testgen.FUNCTION_WORDS)}], term) topic FROM tt JOIN df USING (term), nn),
 pl AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, pool ORDER BY w DESC, term) r, count(*) OVER (PARTITION BY chunk_id, pool) size FROM (SELECT chunk_id, term, w, 1 pool FROM ww WHERE topic AND df >= 2 UNION ALL SELECT chunk_id, term, w, 2 FROM ww WHERE topic UNION ALL SELECT chunk_id, term, w, 3 FROM ww)),
 kt AS (SELECT chunk_id, list(term ORDER BY r) terms FROM pl JOIN (SELECT chunk_id, min(pool) pool FROM pl WHERE size >= 3 GROUP BY 1) USING (chunk_id, pool) WHERE r IN (2, 3) GROUP BY chunk_id)"""


def _filled(templates: Sequence[str], key: str, a: str, b: str | None = None, section: str | None = None) -> str:
    joined = lambda t: f"coalesce(array_to_string({t}, ' and '), 'this topic')"
    q = f"[{', '.join(f"'{t}'" for t in templates)}][1 + CAST('0x' || substr(md5('7:' || {key}), 1, 8) AS BIGINT) % {len(templates)}]"
    q = f"replace({q}, '{{a}}', {joined(a)})"
    q = q if b is None else f"replace({q}, '{{b}}', {joined(b)})"
    return q if section is None else f"replace({q}, '{{s}}', {section})"


def _said(c: str, n: int) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda zs: regexp_replace(zs, '^\\s+|\\s+$', '', 'g')), lambda zs: zs <> '')[1:{n}], ' ')"


_SH = f""",
 sh AS (SELECT c.*, terms, row_number() OVER (ORDER BY turn, first) - 1 number FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) turn, min(chunk_id) OVER (PARTITION BY paper_id) first FROM cur_chunks) c LEFT JOIN kt USING (chunk_id))"""
_MH = f""",
 lk AS (SELECT DISTINCT a.chunk_id source, b.chunk_id target, a.paper_id pa, b.paper_id pb, {_said('a.text', 1)} sa, {_said('b.text', 1)} sb FROM (FROM cites ORDER BY src, dst) JOIN cur_chunks a ON a.paper_id = src JOIN cur_chunks b ON b.paper_id = dst WHERE a.chunk_id IN (SELECT chunk_id FROM cur_chunks WHERE paper_id IN (SELECT src FROM pairs) ORDER BY chunk_id LIMIT 40)),
 fl AS (SELECT * FROM lk x WHERE source < target OR NOT EXISTS (FROM cites WHERE src = pb AND dst = pa) ORDER BY source, target LIMIT 20),
 mh AS (SELECT fl.*, ka.terms ta, kb.terms tb, row_number() OVER (ORDER BY source, target) - 1 number FROM fl LEFT JOIN kt ka ON ka.chunk_id = source LEFT JOIN kt kb ON kb.chunk_id = target)"""
_SHOW_SH = f"""SELECT format('gen-sh-{{:04d}}', number + BEGIN) AS case_id, {_filled(testgen.SINGLE, 'chunk_id', 'terms', section="coalesce(nullif(section, ''), 'main')")} AS question, paper_id, chunk_id AS gold_chunk_ids, paper_id AS gold_paper_ids, '3' AS grades, 'selected' AS expected_scope,
 coalesce({_said('text', 2)}, '') AS gold_answer, 'generated,offline-template,single-hop,local,extractive-reference' AS tags FROM sh WHERE number < SIZE"""
_SHOW_MH = f"""SELECT format('gen-mh-{{:04d}}', number) AS case_id, {_filled(testgen.MULTI['cites'], "source || '|' || target", 'ta', 'tb')} AS question, pa AS paper_id, source || ',' || target AS gold_chunk_ids, least(pa, pb) || ',' || greatest(pa, pb) AS gold_paper_ids, '3,3' AS grades, 'global' AS expected_scope,
 trim(concat_ws(' ', sa, sb)) AS gold_answer, 'generated,offline-template,multi-hop,global,link:cites,extractive-reference' AS tags FROM mh"""
_BM = f"""{_BM25},
 hh AS (SELECT s.query_id, s.doc_id, d.text, d.paper_id, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.doc_id) pos FROM scores s JOIN d USING (doc_id) JOIN routes r ON r.query_id = s.query_id JOIN asked a ON a.query_id = s.query_id WHERE r.scope = 'global' OR a.paper_id IS NULL OR d.paper_id = a.paper_id),
 per AS (SELECT query_id case_id, list(doc_id ORDER BY pos) ranked, list(text ORDER BY pos) evidence, list(paper_id ORDER BY pos) papers FROM hh WHERE pos <= 10 GROUP BY query_id),
 r AS (SELECT c.*, coalesce(ranked, []) R, coalesce(evidence, []) E, routes.scope sc, coalesce(papers, []) ps FROM cur_cases c JOIN routes ON routes.query_id = c.case_id LEFT JOIN per USING (case_id)),
{_IR}, {_GEN}"""
SQL |= {
    "run_bm25": _BM + "SELECT case_id, metric, round(value, 6) AS value FROM m UNION ALL SELECT case_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM o WHERE value IS NOT NULL",
    "run_bm25_summary": _BM + "SELECT metric, round(avg(value), 6) AS mean FROM (FROM m UNION ALL SELECT case_id, metric, CAST(value AS DOUBLE) FROM o WHERE value IS NOT NULL) GROUP BY metric UNION ALL SELECT 'operational.case_count', CAST(count(*) AS DOUBLE) FROM r UNION ALL SELECT 'operational.error_rate', 0.0",
    "gate_verdict": SQL["gate_eval"].replace("SELECT metric, value, base, reason = 'ok' AS passed, reason FROM o", "SELECT count(*) AS n_gates, count(*) FILTER (reason <> 'ok') AS n_failed, bool_and(reason = 'ok') AS passed FROM o"),
    "key_terms": _KT + "SELECT chunk_id, array_to_string(terms, ',') AS terms FROM kt",
    "testgen_single_hop": _KT + _SH + _SHOW_SH.replace("BEGIN", "0").replace("SIZE", "20"),
    "testgen_multi_hop": _KT + _MH + _SHOW_MH,
    "testgen_cases": _KT + _SH + _MH + _SHOW_MH + " UNION ALL " + _SHOW_SH.replace("BEGIN", "20").replace("SIZE", "10"),
}
