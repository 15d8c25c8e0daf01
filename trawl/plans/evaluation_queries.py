"""Multi-query fusion, evidence and evaluation queries (H, I5-I26), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import evaluation as ev
from trawl.operators import extensions, research
from trawl.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_D = t.sql("documents")

# --- H: runs of eight tasks over documents -----------------------------------------------------------------

_TASK = ["concat('r', g % 5) AS run_id", "concat('t', g) AS task_id", "g AS task_no", "CASE WHEN g % 9 = 4 THEN 'timeout' END AS error"]
_CAND = ["concat('t', doc_id % 40) AS task_id", "concat('kb', doc_id * 13 % 2) AS kb_id", "'v2' AS index_version", "concat('c', doc_id * 13 % 90) AS chunk_id", "concat('Text  no ', doc_id * 13 % 90 % 60) AS content", "document_id", "CAST(floor(doc_id / 40) AS INT) AS pos"]
_TASKS = f"(SELECT {', '.join(_TASK)}, CASE WHEN g % 3 = 0 THEN ['a', 'b'] ELSE [concat('x', g % 4)] END AS aspect_ids FROM (SELECT DISTINCT doc_id % 40 AS g FROM {_D}))"
_ONCE = f"(SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id, kb_id, chunk_id ORDER BY pos) AS n FROM (SELECT {', '.join(_CAND)} FROM {_D})) WHERE n = 1)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return t.frame(spark, d, "documents").selectExpr("doc_id % 40 AS g").distinct().selectExpr(*_TASK, "CASE WHEN g % 3 = 0 THEN array('a', 'b') ELSE array(concat('x', g % 4)) END AS aspect_ids")


def task_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = t.frame(spark, d, "documents").selectExpr(*_CAND).withColumn("source", F.lit("vector"))
    none = rows.limit(0).withColumns({"relation": F.lit("next"), "place": F.lit(1)})
    return research.task_candidates(rows, none, rows.limit(0))


@query("h1_task_candidates", f"SELECT task_id, kb_id, chunk_id, rank FROM {_ONCE}")
def h1(spark, d):
    return task_rows(spark, d).select("task_id", "kb_id", "chunk_id", "rank")


_KEYED = f"""(SELECT *, first_value(chunk_id) OVER (PARTITION BY run_id, kb_id, norm ORDER BY task_no, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS key FROM (
  SELECT c.*, t.run_id, t.task_no, t.aspect_ids, lower(replace(content, '  ', ' ')) AS norm FROM {_ONCE} c JOIN {_TASKS} t ON t.task_id = c.task_id WHERE error IS NULL))"""
_PER = f"(SELECT run_id, kb_id, key, task_id, task_no, min(rank) AS rank, any_value(aspect_ids) AS aspect_ids FROM {_KEYED} GROUP BY run_id, kb_id, key, task_id, task_no)"
_MERGED = f"(SELECT run_id, kb_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank, count(*) AS tasks, arg_min(rank, task_no) AS first_rank, min(task_no) AS first_task, len(list_distinct(flatten(list(aspect_ids)))) AS aspects FROM {_PER} GROUP BY ALL)"


@query("h2_merge_tasks", f"SELECT run_id, kb_id, key AS chunk_id, round(score, 9) AS score, best_rank, tasks, aspects FROM {_MERGED}")
def h2(spark, d):
    found = research.merge_tasks(tasks(spark, d), task_rows(spark, d))
    return found.select("run_id", "kb_id", "chunk_id", F.round("score", 9).alias("score"), "best_rank", F.size("task_ids").cast("long").alias("tasks"), F.size("aspect_ids").cast("long").alias("aspects"))


@query("h3_select_candidates", f"""WITH k AS (SELECT run_id, kb_id, key, task_no, rank, unnest(aspect_ids) AS aspect, generate_subscripts(aspect_ids, 1) AS no FROM {_KEYED}),
a AS (SELECT run_id, aspect, min([task_no, rank, no]) AS seen FROM k GROUP BY ALL),
s AS (SELECT k.*, row_number() OVER (PARTITION BY run_id, aspect ORDER BY rank, kb_id, key, task_no) - 1 AS slot FROM k),
p AS (SELECT run_id, kb_id, key, 0 AS phase, 0.0::DOUBLE AS x, seen, 0.0::DOUBLE AS y FROM s JOIN a USING (run_id, aspect) WHERE slot = 0
  UNION ALL SELECT run_id, kb_id, key, 1, slot, seen, 0 FROM s JOIN a USING (run_id, aspect) WHERE slot < 2
  UNION ALL SELECT run_id, kb_id, key, 2, -aspects, NULL, -round(score, 12) FROM {_MERGED} WHERE aspects > 1
  UNION ALL SELECT run_id, kb_id, key, 3, -round(score, 12), NULL, 0 FROM {_MERGED}),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, kb_id, key ORDER BY phase, x, seen, y) AS n FROM p),
f AS (SELECT o.run_id, o.kb_id, o.key, row_number() OVER (PARTITION BY o.run_id ORDER BY phase, x, seen NULLS FIRST, y, first_task, first_rank) AS place FROM o JOIN {_MERGED} m ON m.run_id = o.run_id AND m.kb_id = o.kb_id AND m.key = o.key WHERE n = 1)
SELECT run_id, kb_id, key AS chunk_id, place FROM f WHERE place <= 24""")
def h3(spark, d):
    return research.select_candidates(tasks(spark, d), task_rows(spark, d)).select("run_id", "kb_id", "chunk_id", "place")


def _pool_rows(spark, d):
    rows = t.frame(spark, d, "documents")
    return rows.selectExpr("concat('q', CAST(floor(doc_id / 36) AS BIGINT)) AS query_id", "element_at(array('top', 'context', 'base'), CAST(doc_id * 7 % 3 + 1 AS INT)) AS part", "doc_id AS pos", "concat('c', doc_id * 11 % 200) AS chunk_id", "concat('Body ', doc_id * 11 % 170) AS content", "'vector' AS source")


@query("h4_evidence_pool")
def h4(spark, d):
    return research.evidence_pool(_pool_rows(spark, d))


_SEL = ["concat('q', doc_id % 30) AS query_id", "CAST(floor(doc_id / 30) % 3 AS INT) AS aspect_no", "CASE WHEN doc_id % 97 = 0 THEN '' ELSE concat('aspect ', CAST(floor(doc_id / 30) % 3 AS INT)) END AS aspect", "CAST(doc_id * 7 % 23 AS INT) AS idx", "CASE WHEN doc_id % 53 = 0 THEN 'main' WHEN doc_id % 2 = 0 THEN 'core' ELSE 'supporting' END AS role"]
_SELS = f"(SELECT {', '.join(_SEL)} FROM {_D})"


@query("h5_selection_problems", f"""SELECT DISTINCT * FROM (SELECT query_id, 'invalid_aspect' AS rule FROM {_SELS} WHERE aspect = '' UNION ALL SELECT query_id, 'index_out_of_range' FROM {_SELS} WHERE idx >= 20
UNION ALL SELECT query_id, 'duplicate_index' FROM {_SELS} GROUP BY query_id, aspect_no, idx HAVING count(*) > 1 UNION ALL SELECT query_id, 'invalid_role' FROM {_SELS} WHERE role = 'main'
UNION ALL SELECT query_id, 'too_many_items' FROM {_SELS} GROUP BY query_id HAVING count(DISTINCT idx) > 8)""")
def h5(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr(*_SEL)
    return research.selection_problems(rows, rows.select("query_id").distinct().withColumn("n", F.lit(20)))


@query("h6_evidence_items")
def h6(spark, d):
    chunks = t.frame(spark, d, "text_chunks")
    selected = chunks.selectExpr("concat('q', CAST(floor(doc_id / 24) AS BIGINT)) AS query_id", "doc_id AS place", "tenant_id", "kb_id", "index_version", "chunk_id")
    return research.pack_items(selected, chunks)


@query("h6_pack_status", f"""WITH a AS (SELECT DISTINCT query_id, aspect_no, concat('aspect ', aspect_no) AS aspect FROM {_SELS}), c AS (SELECT a.*, coalesce(max((role = 'core' AND idx % 6 = 0)::INT), 0) AS core FROM a LEFT JOIN {_SELS} s ON s.query_id = a.query_id AND s.aspect_no = a.aspect_no GROUP BY ALL)
SELECT query_id, count(*) AS aspects, count(*) FILTER (WHERE core = 1) AS covered, coalesce(string_agg(aspect, ',' ORDER BY aspect_no) FILTER (WHERE core = 0), '') AS missing, CASE WHEN min(core) = 1 THEN 'complete' WHEN max(core) = 0 THEN 'missing' ELSE 'partial' END AS status FROM c GROUP BY query_id""")
def h6_status(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr(*_SEL)
    aspects = rows.selectExpr("query_id", "aspect_no", "concat('aspect ', aspect_no) AS aspect").distinct()
    found = research.pack_status(aspects, rows.filter("role = 'core' AND idx % 6 = 0"))
    return found.withColumn("missing", F.array_join("missing", ","))


@query("h6_missing_chunks", f"SELECT query_id, chunk_id FROM (SELECT concat('q', doc_id % 25) AS query_id, CASE WHEN doc_id % 6 = 0 THEN 'v9' ELSE index_version END AS v, chunk_id FROM {t.sql('text_chunks')}) WHERE v = 'v9'")
def h6_missing(spark, d):
    chunks = t.frame(spark, d, "text_chunks")
    selected = chunks.selectExpr("concat('q', doc_id % 25) AS query_id", "tenant_id", "kb_id", "CASE WHEN doc_id % 6 = 0 THEN 'v9' ELSE index_version END AS index_version", "chunk_id")
    return research.missing_chunks(selected, chunks).select("query_id", "chunk_id")


_PA = ["concat('r', CAST(floor(doc_id / 4) AS BIGINT)) AS run_id", "CAST(doc_id % 4 AS INT) AS aspect_no", "concat('About  ', doc_id % 4 * (CAST(floor(doc_id / 4) AS BIGINT) % 3)) AS aspect"]
_PQ = ["concat('r', CAST(floor(doc_id / 4) AS BIGINT)) AS run_id", "concat('Query ', doc_id * 3 % 5 % 3, '?') AS query"]


@query("h8_plan_problems", f"""WITH a AS (SELECT {', '.join(_PA)} FROM {_D}), q AS (SELECT {', '.join(_PQ)}, [CAST(doc_id % 5 AS INT)] AS aspect_nos FROM {_D})
SELECT DISTINCT * FROM (SELECT run_id, 'duplicate_aspect' AS rule FROM a GROUP BY run_id, aspect HAVING count(*) > 1 UNION ALL SELECT run_id, 'duplicate_query' FROM q GROUP BY run_id, query HAVING count(*) > 1
UNION ALL SELECT q.run_id, 'aspect_out_of_range' FROM q WHERE aspect_nos[1] NOT IN (SELECT aspect_no FROM a WHERE a.run_id = q.run_id) UNION ALL SELECT a.run_id, 'uncovered_aspect' FROM a WHERE aspect_no NOT IN (SELECT aspect_nos[1] FROM q WHERE q.run_id = a.run_id))""")
def h8(spark, d):
    rows = t.frame(spark, d, "documents")
    queries = rows.selectExpr(*_PQ, "array(CAST(doc_id % 5 AS INT)) AS aspect_nos")
    return research.plan_problems(rows.selectExpr(*_PA), queries)


_PROP = ["concat('r', doc_id % 40) AS run_id", "doc_id AS pos", "concat('More ', CAST(floor(doc_id / 40) AS INT) % 8, '?') AS query"]


@query("h9_next_queries", f"""SELECT run_id, pos, query FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY pos) AS n FROM (SELECT {', '.join(_PROP)}, doc_id FROM {_D}))
WHERE n = 1 AND query NOT IN ('More 1?', 'More 2?') AND doc_id % 3 <> 0 AND query <> 'More 5?'""")
def h9(spark, d):
    rows = t.frame(spark, d, "documents")
    proposed = rows.selectExpr(*_PROP, "CASE doc_id % 3 WHEN 0 THEN array('a', 'z') WHEN 1 THEN array('a') ELSE array('b', 'a') END AS aspect_ids")
    runs = proposed.select("run_id").distinct()
    visited = runs.withColumn("query", F.explode(F.array(F.lit(" more 1 "), F.lit("MORE  2?"), F.lit("more 5."))))
    return research.next_queries(proposed, visited, runs.withColumn("aspect_ids", F.array(F.lit("a"), F.lit("b")))).select("run_id", "pos", "query")


_FIRST = f"(SELECT run_id, kb_id, chunk_id, arg_min(task_id, task_no) AS task_id FROM (SELECT c.*, t.run_id, t.task_no FROM {_ONCE} c JOIN {_TASKS} t ON t.task_id = c.task_id) GROUP BY ALL)"


@query("h10_new_chunks", f"SELECT t.run_id, t.task_id, count(f.chunk_id) AS n FROM {_TASKS} t LEFT JOIN {_FIRST} f ON f.run_id = t.run_id AND f.task_id = t.task_id AND CAST(substr(f.chunk_id, 2) AS INT) % 7 <> 0 GROUP BY ALL")
def h10(spark, d):
    rows, todo = task_rows(spark, d), tasks(spark, d)
    existing = rows.join(todo.select("run_id", "task_id"), "task_id").filter("CAST(substr(chunk_id, 2) AS INT) % 7 = 0").select("run_id", "kb_id", "index_version", "chunk_id").distinct()
    return research.new_chunk_counts(todo, rows, existing)


@query("h11_citation_rate", f"SELECT concat('q', doc_id % 20) AS query_id, count(*) AS total, count(*) FILTER (WHERE doc_id % 9 <> 0 AND doc_id % 8 <> 0) AS verified, round(avg((doc_id % 9 <> 0 AND doc_id % 8 <> 0)::INT), 9) AS rate FROM {t.sql('text_chunks')} GROUP BY 1")
def h11(spark, d):
    chunks = t.frame(spark, d, "text_chunks")
    items = chunks.selectExpr("concat('q', doc_id % 20) AS query_id", "CASE WHEN doc_id % 9 = 0 THEN 'kbx' ELSE kb_id END AS kb_id", "index_version", "chunk_id", "document_id", "title", "CASE WHEN doc_id % 8 = 0 THEN 'other' ELSE content END AS content")
    return research.citation_rate(items, chunks).withColumn("rate", F.round("rate", 9))


@query("h12_answers", f"SELECT conv_id, string_agg(concat(content, '[E', turn, '][E9]'), chr(10) || chr(10) ORDER BY turn) AS answer FROM {t.sql('turns')} GROUP BY conv_id")
def h12(spark, d):
    blocks = t.frame(spark, d, "turns").selectExpr("conv_id AS query_id", "turn AS no", "content AS text", "array(concat('E', turn), 'E9') AS evidence_ids")
    return research.render_answers(blocks).withColumnRenamed("query_id", "conv_id")


@query("h13_answer_problems", f"""SELECT DISTINCT * FROM (SELECT conv_id AS query_id, 'block_length' AS rule FROM {t.sql('turns')} WHERE length(trim(content)) NOT BETWEEN 1 AND 1000 UNION ALL SELECT conv_id, 'duplicate_evidence' FROM {t.sql('turns')} WHERE turn % 5 = 4
UNION ALL SELECT conv_id, 'unknown_evidence' FROM {t.sql('turns')} WHERE turn % 5 = 3 UNION ALL SELECT conv_id, 'unsupported_claim' FROM {t.sql('turns')} WHERE turn % 5 = 2 AND role = 'user'
UNION ALL SELECT conv_id, 'insufficient_with_evidence' FROM {t.sql('turns')} WHERE turn % 5 <> 2 AND role <> 'user' UNION ALL SELECT conv_id, 'answer_length' FROM {t.sql('turns')} GROUP BY conv_id HAVING sum(length(trim(content))) > 4000)""")
def h13(spark, d):
    blocks = t.frame(spark, d, "turns").selectExpr("conv_id AS query_id", "turn AS no", "content AS text", "role = 'user' AS supported", "CASE turn % 5 WHEN 4 THEN array(0, 0) WHEN 3 THEN array(7) WHEN 2 THEN CAST(array() AS array<int>) ELSE array(1) END AS evidence_idx")
    return research.answer_problems(blocks, blocks.select("query_id").distinct().withColumn("idx", F.array(F.lit(0), F.lit(1))))


_COND = "CASE event_id % 7 WHEN 0 THEN 'max_rounds' WHEN 1 THEN 'no_new_chunks' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'complete' WHEN 4 THEN 'degraded' WHEN 5 THEN 'budget' ELSE 'timeout' END"


@query("h14_stop_reasons", f"SELECT run_id, arg_max(reason, s) AS reason FROM (SELECT floor(event_id / 3)::BIGINT AS run_id, {_COND} AS reason, event_id % 7 AS s FROM {t.sql('requests')}) GROUP BY run_id")
def h14(spark, d):
    return research.stop_reasons(t.frame(spark, d, "requests").selectExpr("CAST(floor(event_id / 3) AS BIGINT) AS run_id", f"{_COND} AS reason"))


# --- I5-I26: two configurations over documents as cases -------------------------------------------------------

_RUN = [
    "concat('case', doc_id) AS case_id", "CASE g WHEN 0 THEN 'baseline' ELSE 'candidate' END AS \"group\"", "tenant_id AS experiment", "doc_id % 20 = 0 AS warmup", "CASE WHEN doc_id % 170 = 3 AND tenant_id = 'fr' THEN 'timeout' END AS error",
    "CASE WHEN doc_id % 19 <> 0 OR tenant_id <> 'es' THEN CAST(length(content) % 300 + g * 20 AS DOUBLE) END AS latency_ms", "1 + g * (doc_id % 2) AS application_model_calls",
    "CASE WHEN doc_id % 13 <> 0 OR tenant_id <> 'none' THEN (doc_id * 7 % 10 + g * (doc_id % 2)) / 10.0D END AS context_recall", "CASE WHEN doc_id % 13 <> 1 OR tenant_id <> 'none' THEN (doc_id * 3 % 10) / 10.0D END AS context_precision",
    "tenant_id AS case_type", "CAST(doc_id * 5 % 7 AS INT) AS evidence_count", "length(content) AS evidence_chars", "CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing' ELSE '' END AS evidence_status",
    "CAST(doc_id % 6 AS INT) AS verified_total", "CAST(doc_id % 3 AS INT) AS verified", "doc_id % 500 AS input_tokens", "concat('m', doc_id % 2) AS model", "concat('cfg', g, doc_id % 3) AS config", "doc_id",
]
_RUNS = "(SELECT " + ", ".join(_RUN).replace("10.0D", "10.0::DOUBLE") + f" FROM {_D} CROSS JOIN (VALUES (0), (1)) AS r(g))"


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = t.frame(spark, d, "documents").withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.selectExpr(*[e.replace('"group"', "`group`") for e in _RUN], "array(kb_id, tenant_id) AS tags")
    return rows.withColumns({"mismatches": F.array().cast("array<string>"), "degraded": F.expr("CASE WHEN doc_id % 90 = 5 AND experiment = 'de' THEN array('rerank') ELSE CAST(array() AS array<string>) END")})


@query("i5_prepare_cases", f"SELECT CASE WHEN doc_id % 3 = 0 THEN concat('case_', doc_id + 1) ELSE concat('k', doc_id) END AS id, coalesce(CASE WHEN doc_id % 4 > 0 THEN kb_id END, 'kb0') AS kb_id FROM {_D} WHERE doc_id % 5 > 0")
def i5(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat('k', doc_id) END AS id", "doc_id AS pos", "CASE WHEN doc_id % 4 > 0 THEN kb_id END AS kb_id", "CASE WHEN doc_id % 5 > 0 THEN 'yes' ELSE ' ' END AS ground_truth")
    return ev.prepare_cases(rows, "kb0")[0].select("id", "kb_id")


_CASES = ["CASE WHEN doc_id % 40 = 0 THEN 'same' WHEN doc_id % 41 = 0 THEN 'bad id' ELSE concat('c', doc_id) END AS id", "CASE WHEN doc_id % 33 = 0 THEN ' ' ELSE title END AS question", "CASE WHEN doc_id % 29 = 0 THEN 'odd' ELSE 'fact' END AS case_type", "kb_id AS kb_alias", "CASE WHEN doc_id % 50 = 0 THEN 'none' ELSE 'basic' END AS suite"]


@query("i6_dataset_violations", f"""WITH c AS (SELECT {', '.join(_CASES)} FROM {_D}) SELECT 'required_text' AS rule, id AS location FROM c WHERE question = ' ' UNION ALL SELECT 'id_pattern', id FROM c WHERE id = 'bad id' UNION ALL SELECT 'case_type', id FROM c WHERE case_type = 'odd'
UNION ALL SELECT 'duplicate_id', id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown_kb_alias', id FROM c WHERE kb_alias IN ('src3', 'none') UNION ALL SELECT 'unknown_suite', id FROM c WHERE suite = 'none'""")
def i6(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr(*_CASES)
    aliases = rows.filter("kb_alias NOT IN ('src3', 'none')").select("kb_alias").distinct()
    return ev.dataset_violations(rows, aliases, spark.createDataFrame([("basic",)], "suite string"), ["fact"])


_N = "CAST(floor(doc_id / 20) AS BIGINT)"
_CTX = [f"concat('case', {_N}) AS case_id", "CAST(doc_id % 20 + 1 AS INT) AS rank", "CASE WHEN doc_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS index_version", "concat('text ', doc_id * 3 % 5) AS content", f"CASE WHEN doc_id % 4 = 0 THEN concat('wide ', {_N}) ELSE '' END AS expanded", f"concat('Doc ', doc_id % 3 + {_N}, '.md') AS document", "concat('Part ', doc_id % 2) AS heading"]
_CTXS = f"(SELECT {', '.join(_CTX)} FROM {_D})"


@query("i7_contexts", f"SELECT case_id, text, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, text ORDER BY rank) AS n FROM (SELECT case_id, rank, CASE WHEN index_version <> 'v1' AND expanded <> '' THEN expanded ELSE content END AS text FROM {_CTXS})) WHERE n = 1")
def i7(spark, d):
    return ev.normalize_contexts(t.frame(spark, d, "documents").selectExpr(*_CTX)).select("case_id", "text", "rank")


@query("i8_config_drift", f"""WITH s AS (SELECT concat('case', doc_id) AS case_id, doc_id, ['top_k', 'index_version', 'mode'][z] AS setting, z FROM {_D} CROSS JOIN (VALUES (1), (2), (3)) AS r(z)),
e AS (SELECT case_id, setting, CASE WHEN z = 2 AND doc_id % 3 = 0 THEN NULL ELSE concat('v', doc_id % 4) END AS expected FROM s), a AS (SELECT case_id, setting, concat('v', doc_id % 6) AS actual FROM s WHERE z < 3 OR doc_id % 2 = 0)
SELECT case_id, setting, expected, actual FROM e FULL OUTER JOIN a USING (case_id, setting) WHERE expected IS DISTINCT FROM actual AND NOT (setting = 'index_version' AND expected IS NULL)""")
def i8(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("concat('case', doc_id) AS case_id", "doc_id", "posexplode(array('top_k', 'index_version', 'mode')) AS (z, setting)")
    expected = rows.selectExpr("case_id", "setting", "CASE WHEN z = 1 AND doc_id % 3 = 0 THEN NULL ELSE concat('v', doc_id % 4) END AS expected")
    return ev.config_drift(expected, rows.filter("z < 2 OR doc_id % 2 = 0").selectExpr("case_id", "setting", "concat('v', doc_id % 6) AS actual"))


@query("i9_degradations", f"SELECT concat('case', doc_id) AS case_id, unnest(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'rerank' END, CASE WHEN doc_id % 6 = 0 THEN 'graph' END], lambda x: x IS NOT NULL)) AS stage FROM {_D}")
def i9(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("concat('case', doc_id) AS case_id", "doc_id % 4 = 0 AS rerank_degraded", "'x' AS rerank_error", "doc_id % 6 = 0 AS graph_degraded", "'y' AS graph_error")
    return ev.degradations(rows, ["rerank", "graph"]).select("case_id", "stage")


def _metrics_sql(keys: str, *groups: str) -> str:
    return f"""SELECT {keys}, count(*) AS case_count, count(*) FILTER (WHERE error IS NULL) AS successful_cases, count(*) FILTER (WHERE error IS NOT NULL) AS failed_cases,
avg(context_recall) FILTER (WHERE error IS NULL) AS context_recall, count(context_recall) FILTER (WHERE error IS NULL) AS context_recall_coverage, avg(context_precision) FILTER (WHERE error IS NULL) AS context_precision, count(context_precision) FILTER (WHERE error IS NULL) AS context_precision_coverage,
count(latency_ms) FILTER (WHERE error IS NULL) AS latency_count, avg(latency_ms) FILTER (WHERE error IS NULL) AS mean_latency_ms, quantile_cont(latency_ms, 0.5) FILTER (WHERE error IS NULL) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) FILTER (WHERE error IS NULL) AS p95_latency_ms, max(latency_ms) FILTER (WHERE error IS NULL) AS max_latency_ms,
count(application_model_calls) FILTER (WHERE error IS NULL) AS calls_count, avg(application_model_calls) FILTER (WHERE error IS NULL) AS mean_calls, 0 AS mismatched, count(*) FILTER (WHERE error IS NULL AND doc_id % 90 = 5 AND experiment = 'de') AS degraded FROM {_RUNS} WHERE NOT warmup GROUP BY {keys}"""


_ROUND = ["context_recall", "context_precision", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "max_latency_ms", "mean_calls"]


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("i10_group_metrics", "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND) + f") FROM ({_metrics_sql(chr(34) + 'group' + chr(34))})")
def i10(spark, d):
    return _rounded(ev.group_metrics(runs(spark, d)), _ROUND)


@query("i12_evidence_diagnostics", f"""SELECT "group", count(*) AS case_count, round(avg(evidence_count), 6) AS mean_count, round(avg(evidence_chars), 6) AS mean_chars, sum(verified_total)::BIGINT AS total_items, sum(verified)::BIGINT AS verified_items,
round(sum(verified) / sum(verified_total), 6) AS rate, sum(input_tokens)::BIGINT AS input_tokens, round(avg(input_tokens), 6) AS mean_input_tokens, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM {_RUNS} GROUP BY 1""")
def i12(spark, d):
    return _rounded(ev.evidence_diagnostics(runs(spark, d)), ["mean_count", "mean_chars", "rate", "mean_input_tokens"])


@query("i12_status_distribution", f"SELECT \"group\", evidence_status AS value, count(*) AS n FROM {_RUNS} WHERE evidence_status <> '' GROUP BY ALL")
def i12_status(spark, d):
    return ev.distribution(runs(spark, d), "evidence_status")


def _by_experiment(spark, d):
    rows = runs(spark, d)
    # Metrics by experiment and group: the group name carries both.
    named = rows.withColumn("group", F.concat_ws("|", "experiment", "group"))
    out = ev.group_metrics(named)
    return out.withColumns({"experiment": F.split("group", r"\|")[0], "group": F.split("group", r"\|")[1]})


_COVER = " AND ".join(f"{g}.{c} = {g}.successful_cases" for g in "bc" for c in ("context_recall_coverage", "context_precision_coverage", "latency_count", "calls_count"))
_VERDICT = f"""WITH m AS ({_metrics_sql('experiment, ' + chr(34) + 'group' + chr(34))}),
j AS (SELECT b.experiment, c.context_recall - b.context_recall AS recall_delta, c.context_precision - b.context_precision AS precision_delta, CASE WHEN b.p95_latency_ms = 0 THEN CASE WHEN c.p95_latency_ms = 0 THEN 0 END ELSE (c.p95_latency_ms - b.p95_latency_ms) / b.p95_latency_ms END AS p95_ratio,
c.mean_calls - b.mean_calls AS calls_delta, b.degraded + c.degraded + b.failed_cases + c.failed_cases = 0 AND b.case_count = c.case_count AND {_COVER} AS complete FROM m b JOIN m c ON b.experiment = c.experiment AND b."group" = 'baseline' AND c."group" = 'candidate')
SELECT experiment, round(recall_delta, 6) AS recall_delta, round(p95_ratio, 6) AS p95_ratio, CASE WHEN NOT complete THEN 'evaluation_failed' WHEN recall_delta <= -0.02 OR precision_delta < -0.02 THEN 'negative' WHEN recall_delta < 0.02 THEN 'no_clear_benefit' WHEN p95_ratio > 0.3 OR calls_delta > 0.4 THEN 'effective_high_cost' ELSE 'effective' END AS verdict FROM j"""


@query("i13_comparison", _VERDICT)
def i13(spark, d):
    found = ev.compare(_by_experiment(spark, d), calls_most=0.4)
    return found.select("experiment", F.round("recall_delta", 6).alias("recall_delta"), F.round("p95_ratio", 6).alias("p95_ratio"), "verdict")


_TRACE = "concat('trace-', lpad(CAST(floor(event_id / 4) AS INT)::VARCHAR, 5, '0'), '-', event_id)"


@query("i14_feedback_cases", f"""SELECT CASE WHEN n = 1 THEN b ELSE concat(b, '_', n) END AS id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY event_id) AS n FROM (
SELECT *, concat('lf_', substr(trace_id, 1, 12)) AS b FROM (SELECT {_TRACE} AS trace_id, event_id, value, event_type FROM {t.sql('requests')}) WHERE event_type = 'view' AND value < 3.0 AND event_id % 3 > 0))""")
def i14(spark, d):
    rows = t.frame(spark, d, "requests").withColumn("trace_id", F.expr("concat('trace-', lpad(CAST(CAST(floor(event_id / 4) AS INT) AS STRING), 5, '0'), '-', event_id)"))
    scores = rows.selectExpr("trace_id", "event_type AS name", "value", "'' AS comment", "ts", "event_id AS pos")
    traces = rows.selectExpr("trace_id", "CASE WHEN event_id % 3 > 0 THEN ' question ' ELSE '' END AS query", "array('kb1') AS kb_ids", "CAST(event_id AS STRING) AS log_id")
    return ev.feedback_cases(scores, traces, name="view").select("id", "trace_id")


@query("i15_merge_cases", f"""WITH a AS (SELECT concat('old', doc_id) AS id, doc_id AS q, CASE WHEN doc_id % 3 = 0 THEN 'truth' ELSE '' END AS gt, doc_id FROM {_D}), b AS (SELECT concat('new', doc_id) AS id, doc_id * 2 AS q FROM {_D})
SELECT coalesce(a.id, b.id) AS id, coalesce(gt, '') AS ground_truth, CASE WHEN a.q IS NULL THEN 'b' WHEN b.q IS NULL OR gt <> '' THEN 'a' ELSE 'ab' END AS source FROM a FULL OUTER JOIN b ON a.q = b.q""")
def i15(spark, d):
    rows = t.frame(spark, d, "documents")
    old = rows.selectExpr("concat('old', doc_id) AS id", "concat(' Question ', doc_id) AS question", "CASE WHEN doc_id % 3 = 0 THEN 'truth' ELSE '' END AS ground_truth", "map('x', 'a') AS source")
    new = rows.selectExpr("concat('new', doc_id) AS id", "concat('Question ', doc_id * 2, ' ') AS question", "'' AS ground_truth", "map('y', 'b') AS source")
    return ev.merge_cases(old, new).select("id", "ground_truth", F.array_join(F.array_sort(F.map_values("source")), "").alias("source"))


@query("i16_dataset_scope", f"SELECT tenant_id AS dataset, CASE WHEN count(DISTINCT k) = 1 AND bool_and(n = 1) THEN max(k) ELSE '' END AS kb_id FROM (SELECT tenant_id, CASE tenant_id WHEN 'en' THEN 'kb' ELSE kb_id END AS k, CASE WHEN tenant_id = 'de' THEN 2 ELSE 1 END AS n FROM {_D}) GROUP BY 1")
def i16(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("tenant_id AS dataset", "CASE tenant_id WHEN 'en' THEN array('kb') WHEN 'de' THEN array('a', 'b') ELSE array(kb_id) END AS kb_ids")
    return ev.dataset_scope(rows)


@query("i17_slices", f"SELECT value, count(*) AS n, round(avg(context_recall), 6) AS context_recall, round(avg(context_precision), 6) AS context_precision FROM (SELECT unnest([kb_id, tenant_id]) AS value, r.* FROM {_RUNS} r JOIN {_D} d ON d.doc_id = r.doc_id WHERE \"group\" = 'baseline') GROUP BY value HAVING count(*) >= 3")
def i17(spark, d):
    return _rounded(ev.slice_quality(runs(spark, d).filter("`group` = 'baseline'"), "tags"), ev.QUALITY)


_DELTA = f"(SELECT a.case_id, round(b.context_recall - a.context_recall, 6) AS delta FROM {_RUNS} a JOIN {_RUNS} b ON a.case_id = b.case_id AND a.\"group\" = 'baseline' AND b.\"group\" = 'candidate' WHERE a.context_recall IS NOT NULL)"


@query("i18_case_changes", f"SELECT case_id, delta, 'improved' AS change FROM (SELECT * FROM {_DELTA} WHERE delta > 0 ORDER BY delta DESC, case_id LIMIT 3) UNION ALL SELECT case_id, delta, 'regressed' FROM (SELECT * FROM {_DELTA} WHERE delta < 0 ORDER BY delta, case_id LIMIT 3)")
def i18(spark, d):
    rows = runs(spark, d).withColumn("context_recall", F.round("context_recall", 6))
    sides = [rows.filter(F.col("group") == g) for g in ("baseline", "candidate")]
    # Deltas are rounded before they are ranked, so equal ones tie alike everywhere.
    a, b = sides
    zero = a.withColumn("context_recall", F.lit(0.0))
    moved = a.select("case_id", F.col("context_recall").alias("r")).join(b, "case_id").withColumn("context_recall", F.round(F.col("context_recall") - F.col("r"), 6))
    return ev.case_changes(zero, moved).select("case_id", "delta", "change")


@query("i19_ndcg", f"""WITH c AS (SELECT case_id, rank, lower(regexp_replace(document, '\\.md$', '')) AS d, lower(heading) AS h, CAST(substr(case_id, 5) AS INT) AS n FROM {_CTXS} WHERE rank <= 10)
SELECT case_id, round(sum(CASE WHEN contains(d, concat('doc ', n + 1)) AND (n % 2 = 0 OR contains(h, 'part 1')) THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM c GROUP BY case_id""")
def i19(spark, d):
    contexts = t.frame(spark, d, "documents").selectExpr(*_CTX)
    cases = contexts.select("case_id").distinct().selectExpr("case_id", "CAST(substr(case_id, 5) AS INT) AS n").selectExpr("case_id", "array(concat('DOC ', n + 1, '.md')) AS expected_documents", "CASE WHEN n % 2 = 1 THEN array('Part 1') ELSE CAST(array() AS array<string>) END AS expected_headings")
    return _rounded(ev.ndcg(contexts, cases), ["ndcg"])


@query("i20_low_recall", f"SELECT r.\"group\", case_id, context_recall, round(a, 6) AS mean_context_recall, round(b, 6) AS mean_context_precision FROM {_RUNS} r JOIN (SELECT \"group\", avg(context_recall) AS a, avg(context_precision) AS b FROM {_RUNS} GROUP BY 1) m ON m.\"group\" = r.\"group\" WHERE context_recall <= 0.5")
def i20(spark, d):
    return _rounded(ev.low_recall(runs(spark, d)), ["mean_context_recall", "mean_context_precision"])


# An earlier attempt scored cases in part: of every third one a metric is missing.
_PARTLY = "CASE WHEN doc_id % 3 > 0 THEN context_recall END"


@query("i21_pending_scores", f"SELECT case_id FROM (SELECT *, {_PARTLY} AS scored FROM {_RUNS}) WHERE \"group\" = 'baseline' AND error IS NULL AND (scored IS NULL OR context_precision IS NULL)")
def i21(spark, d):
    rows = runs(spark, d).filter("`group` = 'baseline'")
    return ev.pending_scores(rows, rows.withColumn("context_recall", F.expr(_PARTLY))).select("case_id")


@query("i21_resume_scores", f"SELECT case_id, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE context_recall END AS context_recall, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE context_precision END AS context_precision FROM {_RUNS} WHERE \"group\" = 'baseline'")
def i21_resume(spark, d):
    rows = runs(spark, d).filter("`group` = 'baseline'")
    return ev.resume_scores(rows, rows.filter("doc_id % 2 = 0").selectExpr("case_id", "1.0D AS context_recall", "CAST(NULL AS DOUBLE) AS context_precision"))


@query("i22_config_diff", f"""WITH s AS (SELECT concat('r', doc_id) AS run_id, doc_id FROM {_D}), x AS (SELECT run_id, 'search.top_k' AS path FROM s WHERE doc_id % 3 > 0 UNION ALL SELECT run_id, 'mode' FROM s WHERE doc_id % 2 = 1), y AS (SELECT run_id, 'search.top_k' AS path FROM s WHERE doc_id % 4 > 0)
SELECT run_id, path, 'undeclared' AS problem FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT run_id, path, 'unused' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def i22(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("concat('r', doc_id) AS run_id", "doc_id")
    kind = "mode string, search struct<top_k: int, depth: int>"
    left = ev.flatten_settings(rows.withColumn("settings", F.lit('{"mode": "a", "search": {"top_k": 5}}')), kind)
    right = ev.flatten_settings(rows.selectExpr("run_id", "concat('{\"mode\": \"', CASE WHEN doc_id % 2 = 1 THEN 'b' ELSE 'a' END, '\", \"search\": {\"top_k\": ', 5 + doc_id % 3, '}}') AS settings"), kind)
    return ev.diff_paths(left, right, rows.filter("doc_id % 4 > 0").selectExpr("run_id", "'search.top_k' AS path"))


# Equal fingerprints are those of equal lists, so the lists themselves can be counted.
@query("i23_fingerprints", f"""SELECT case_id, count(DISTINCT listed) AS different FROM (SELECT concat('case', CAST(floor(doc_id / 20) AS BIGINT)) AS case_id, string_agg(concat(doc_id, ' ', CASE WHEN doc_id % 50 = 7 THEN config ELSE 'same' END), ',' ORDER BY doc_id) AS listed
FROM {_RUNS} GROUP BY "group", CAST(floor(doc_id / 20) AS BIGINT)) GROUP BY case_id""")
def i23(spark, d):
    rows = runs(spark, d).selectExpr("`group`", "concat('case', CAST(floor(doc_id / 20) AS BIGINT)) AS case_id", "doc_id AS pos", "concat('c', doc_id) AS chunk_id", "CASE WHEN doc_id % 50 = 7 THEN config ELSE 'same' END AS content")
    found = ev.fingerprints(rows)
    return found.groupBy("case_id").agg(F.countDistinct("fingerprint").alias("different"))


@query("i24_manifest", f"SELECT \"group\", count(*) AS rows, count(error) AS failed, count(DISTINCT config) AS configs FROM {_RUNS} GROUP BY 1")
def i24(spark, d):
    return ev.manifest(runs(spark, d))


_SECRETS = "concat('{{\"api_key\": {k}, \"a\": {{\"Access-Token\": {v}, \"n\": ', doc_id, ', \"input_tokens\": 5, \"list\": [{{\"secret\": {w}, \"x\": \"y\"}}]}}, \"password\": {z}}}')"
_SHOWN = _SECRETS.format(k='\\"k\\"', v="[1, 2]", w='{{\\"deep\\": {{\\"hidden\\": 1}}}}'.replace("{{", "{").replace("}}", "}"), z="null").replace('\\"', '"')
_HIDDEN = _SECRETS.format(k='"[REDACTED]"', v='"[REDACTED]"', w='"[REDACTED]"', z='"[REDACTED]"')


@query("i25_redaction", f"SELECT doc_id, {_HIDDEN} AS j FROM {_D}")
def i25(spark, d):
    rows = t.frame(spark, d, "documents").selectExpr("doc_id", f"{_SHOWN} AS j")
    return rows.select("doc_id", ev.redact(F.col("j")).alias("j"))


@query("i26_context_scores", f"""WITH c AS (SELECT case_id, rank, document, CAST(substr(case_id, 5) AS INT) AS n FROM {_CTXS} WHERE rank <= 10), h AS (SELECT *, document IN (concat('Doc ', n, '.md'), concat('Doc ', n + 2, '.md')) AS hit FROM c),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY case_id ORDER BY rank) / rank AS p FROM h)
SELECT case_id, count(DISTINCT document) FILTER (WHERE hit) AS n, round(count(DISTINCT document) FILTER (WHERE hit) / 2, 6) AS recall, round(coalesce(avg(p) FILTER (WHERE hit), 0), 6) AS precision FROM p GROUP BY case_id""")
def i26(spark, d):
    contexts = t.frame(spark, d, "documents").selectExpr(*_CTX)
    cases = contexts.select("case_id").distinct().selectExpr("case_id", "CAST(substr(case_id, 5) AS INT) AS n").selectExpr("case_id", "array(concat('Doc ', n, '.md'), concat('Doc ', n + 2, '.md')) AS expected_documents")
    return _rounded(ev.context_scores(contexts, cases), ["recall", "precision"])


@query("l5_quality_scorer", SQL["i26_context_scores"].replace("SELECT case_id, count(DISTINCT document) FILTER (WHERE hit) AS n, ", "SELECT case_id, "))
def l5(spark, d):
    contexts = t.frame(spark, d, "documents").selectExpr(*_CTX)
    cases = contexts.select("case_id").distinct().selectExpr("case_id", "CAST(substr(case_id, 5) AS INT) AS n").selectExpr("case_id", "array(concat('Doc ', n, '.md'), concat('Doc ', n + 2, '.md')) AS expected_documents")
    found = extensions.score_quality(cases, lambda rows: ev.context_scores(contexts, rows), ["recall", "precision"])
    return _rounded(found.select("case_id", "recall", "precision"), ["recall", "precision"])
