"""Keyword search over stored rows: as a full search, and no posting is shuffled."""

import random

import pytest

from trawl.operators import keyword

CHUNKS = "kb_id string, index_version string, chunk_id string, content string, title string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    text = lambda i: " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 80))) + (" 中文 检索" if i % 50 == 0 else "")
    rows = [(rng.choice("ab"), rng.choice(["v1", "v2"]), f"c{i}", text(i), rng.choice(["", "w3 rare", "w1 w2", None])) for i in range(600)]
    return spark.createDataFrame([*rows, ("a", "v2", "empty", "", None), ("a", "v2", "none", None, " ")], CHUNKS).repartition(3)


def asked(spark):
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(["rare", "w1 w2 W2 w5", "中文检索", "nothing", "", None])], "query_id string, query_text string")
    return queries, queries.select("query_id").crossJoin(spark.createDataFrame([("a", "v2"), ("b", "v1")] * 2, "kb_id string, index_version string"))


def shuffled_rows(spark):
    """Rows written to shuffles by all stages so far."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("k", [0, 1, 7, 2000])
def test_stored_rows_equal_full_search(spark, corpus, tmp_path, k):
    queries, scope = asked(spark)
    index = keyword.write_rows(corpus, f"file://{tmp_path}/index", content="content", title="title")
    rows = lambda df: sorted((r.query_id, r["rank"], r.kb_id, r.index_version, r.chunk_id, round(r.score, 8)) for r in df.collect())
    whole = rows(keyword.bm25_top_k(queries, scope, keyword.postings(corpus, content="content", title="title"), k, {"title": 2.0}))
    assert rows(keyword.stored_top_k(queries, scope, index, k, {"title": 2.0})) == whole and bool(whole) == (k > 0)


def test_a_search_does_not_shuffle_the_index(spark, tmp_path):
    """The query table's search: what is shuffled grows with hits, not with postings."""
    from trawl.plans import tables
    from trawl.plans.retrieval_queries import bm25_hits

    sf = "/root/testdata/sf0.001"
    tables._INDEXES.pop((spark.sparkContext.applicationId, sf), None)
    before = shuffled_rows(spark)
    assert bm25_hits(spark, sf).count() > 500
    written = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    postings = keyword.postings(tables.frame(spark, sf, "text_chunks"), content="content", title="title").count()
    assert written < postings / 4, (written, postings)
