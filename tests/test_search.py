"""Search, rewrites, redaction and a user's own functions on small rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from trawl.operators import evaluation, extensions, keyword, query_text, vector


def test_rewrites(spark):
    cases = {
        "  plain text  ": "plain text", "```json\n{\"query\": \"abc\"}\n```": "abc", "```JSON {\"rewrite\": \"r\"}```": "r", '{"text": "abc"}': "abc", '{"foo": 1}': None,
        '"plain string"': "plain string", '{"query": {"query": "x"}, "content": "y"}': "y", '{"query": "{\\"text\\": \\"deep\\"}"}': "deep", "\n\n first \nsecond": "first", "x" * 40: "x" * 30,
        "```": "```", "": None, "[1, 2]": "[1, 2]", "12": "12", '{"query": ""}': None, "```sql\nselect```": "sql",
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i int, t string")
    got = {r.i: r.y for r in rows.select("i", query_text.clean_rewrite(F.col("t")).alias("y")).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}


def test_redaction(spark):
    deep = {"secret": {"a": {"b": "hidden"}}, "input_tokens": 5, "list": [{"Access-Token": [1], "x": {"password": None, "y": "z"}}], "author": "me"}
    want = {"secret": "[REDACTED]", "input_tokens": 5, "list": [{"Access-Token": "[REDACTED]", "x": {"password": "[REDACTED]", "y": "z"}}], "author": "me"}
    rows = spark.createDataFrame([(json.dumps(deep),), ("plain",), ('{"api_key": "k',), (None,), ("3",)], "t string")
    got = [r.y for r in rows.select(evaluation.redact(F.col("t")).alias("y")).collect()]
    assert json.loads(got[0]) == want and got[1:] == ["plain", "[REDACTED]", None, "3"]


@pytest.mark.parametrize("blocks", [(8192, 2048), (3, 2)])
def test_cosine_by_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector, "CHUNK_BLOCK", blocks[0])
    monkeypatch.setattr(vector, "QUERY_BLOCK", blocks[1])
    import math
    import random

    rng = random.Random(1)
    vectors = [(f"c{i:02}", f"kb{i % 2}", [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)] if i % 9 else None) for i in range(30)]
    queries = [(f"q{i}", "t", [rng.choice([1.0, -0.5, 0.25]) for _ in range(3)]) for i in range(7)] + [("zero", "t", [0.0] * 3), ("none", "t", None)]
    chunks = spark.createDataFrame([(c, "t", kb, "v", "d", v) for c, kb, v in vectors], "chunk_id string, tenant_id string, kb_id string, index_version string, document_id string, embedding array<float>")
    scope = spark.createDataFrame([(q[0], kb, "v") for q in queries for kb in ("kb0", "kb1") if kb == "kb0" or q[0] != "q3"] * 2, "query_id string, kb_id string, index_version string")
    got = vector.cosine_top_k(spark.createDataFrame(queries, "query_id string, tenant_id string, query_vector array<float>"), scope, chunks, 4).collect()
    want = []
    for q, _, x in queries:
        if x is None or not any(x):
            continue
        hits = []
        for c, kb, v in vectors:
            if v and any(v) and (kb == "kb0" or q != "q3"):
                hits.append((-round(sum(a * b for a, b in zip(x, v, strict=True)) / math.hypot(*x) / math.hypot(*v), 9), kb, c))
        want += [(q, i + 1, c) for i, (_, _, c) in enumerate(sorted(hits)[:4])]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == sorted(want)


def test_keyword_statistics_and_wanted_terms(spark):
    chunks = spark.createDataFrame([("k", "v", "1", "a b b", "T"), ("k", "v", "2", "c", ""), ("m", "v", "3", "a", None)], "kb_id string, index_version string, chunk_id string, content string, title string")
    fields = {"content": "content", "title": "title"}
    assert {(r.field, r.n, r.avgdl) for r in keyword.statistics(chunks, **fields).collect()} == {("content", 3, 5 / 3), ("title", 1, 1.0)}
    whole, some = keyword.postings(chunks, **fields), keyword.postings(chunks, spark.createDataFrame([("b",), ("t",)], "term string"), **fields)
    assert {(r.chunk_id, r.field, r.term, r.tf, r.dl) for r in some.collect()} == {("1", "content", "b", 2, 3), ("1", "title", "t", 1, 1)}
    queries = spark.createDataFrame([("q", "b a zz"), ("r", "a")], "query_id string, query_text string")
    scope = spark.createDataFrame([("q", "k", "v"), ("r", "m", "v")], "query_id string, kb_id string, index_version string")
    found = [sorted(map(tuple, keyword.bm25_top_k(queries, scope, whole, 3, fields=f).collect())) for f in (None, keyword.statistics(chunks, **fields))]
    assert found[0] == found[1] and [(r[0], r[3]) for r in found[0]] == [("q", "1"), ("r", "3")]


def test_own_functions_are_checked(spark):
    queries = spark.createDataFrame([("q", "A  b")], "query_id string, query_text string")
    out = extensions.process_queries(queries, lambda q: q.withColumn("low", F.lower("query_text")), lambda q: q.withColumn("n", F.length("low")))
    assert out.collect() == [("q", "A  b", "a  b", 4)]
    with pytest.raises(ValueError, match="query_text is missing"):
        extensions.process_queries(queries, lambda q: q.select("query_id"))
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    scored = extensions.score_quality(cases, lambda rows: rows.filter("case_id = 'a'").withColumn("m", F.lit(0.5)), ["m"])
    assert sorted(map(tuple, scored.collect()), key=repr) == [("a", 0.5), ("b", None)]
    with pytest.raises(ValueError, match="m is string"):
        extensions.score_quality(cases, lambda rows: rows.withColumn("m", F.lit("x")), ["m"])
    with pytest.raises(Exception, match="more than once"):
        extensions.score_quality(cases, lambda rows: rows.unionAll(rows).withColumn("m", F.lit(0.5)), ["m"]).collect()
    hits = spark.createDataFrame([("q", "k", "c", "d", 1, 0.5), ("q", "other", "c", "d", 2, 0.5), ("q", "k", "e", "d", 9, 0.1)], "query_id string, kb_id string, chunk_id string, document_id string, pos int, score double")
    scope = spark.createDataFrame([("q", "k")], "query_id string, kb_id string")
    assert [r.chunk_id for r in extensions.search_with(queries, scope, 5, lambda q, s, k: hits)[0].collect()] == ["c"]
    with pytest.raises(ValueError, match="pos is bigint"):
        extensions.search_with(queries, scope, 5, lambda q, s, k: hits.withColumn("pos", F.col("pos").cast("long")))


def test_synonyms_walk_each_query_once():
    from trawl.operators.query_text import Synonyms

    rules = Synonyms([{"terms": [" Strasse ", "", None], "expand": [" road", "ROAD", " ", None]}, {"terms": ["  "], "expand": ["never"]}, {"terms": ["as"], "expand": ["Road ", "way"]}, {"terms": None, "expand": ["x"]}, {"terms": ["q"], "expand": None}])
    assert rules.added("Eine STRAßE") == (True, ["road", "way"])
    assert rules.added("was") == (True, ["Road", "way"])
    assert rules.added("zzz q") == (False, []) and rules.added(None) == (False, [])
    assert Synonyms([]).added("a") == (False, []) and Synonyms([{"terms": ["a"], "expand": []}]).added("a") == (True, [])
