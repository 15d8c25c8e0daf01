"""The stored keyword index against a full search, and what it leaves unread."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import blocks, keyword

CHUNKS = "kb_id string, index_version string, chunk_id string, content string, title string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    common = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(rng.choice(common) for _ in range(rng.randrange(1, 40))) + (" rare word rare" if i % 97 == 5 else "") + (" 中文 检索" if i % 50 == 0 else "")
    rows = [(rng.choice("ab"), rng.choice(["v1", "v2", "v2"]), f"c{i}", text(i), rng.choice(["", "w3 rare", "w1 w2", None])) for i in range(900)]
    rows += [("a", "v2", "empty", "", None), ("a", "v2", "none", None, " ")]
    return spark.createDataFrame(rows, CHUNKS).repartition(3)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return blocks.write_index(corpus, f"file://{tmp_path_factory.mktemp('index')}/one", width=8, content="content", title="title")


def asked(spark):
    texts = ["rare", "rare w3", "w1 w2 w3 w4 w5", "中文检索", "nothing here", "", "w7 W7 w7", "rare word"]
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)], "query_id string, query_text string")
    scope = queries.select("query_id").crossJoin(spark.createDataFrame([("a", "v2"), ("b", "v1")], "kb_id string, index_version string"))
    return queries, scope.filter("query_id <> 'q7' OR kb_id = 'b'")


@pytest.mark.parametrize("k,first", [(1, 1), (5, 2), (20, 3), (2000, 1)])
@pytest.mark.parametrize("boosts", [{"title": 2.0}, {}])
def test_equals_full_search(spark, corpus, index, k, first, boosts):
    queries, scope = asked(spark)
    plain = keyword.bm25_top_k(queries, scope, keyword.postings(corpus, content="content", title="title"), k, boosts)
    rows = lambda df: sorted((r.query_id, r["rank"], r.kb_id, r.index_version, r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert rows(blocks.block_top_k(queries, scope, index, k, boosts, first)) == rows(plain)


def test_ranges_without_hope_are_not_read(spark, index):
    queries, scope = asked(spark)
    wanted = blocks.stored(blocks._wanted(queries, scope, index))
    bounds = blocks.stored(blocks.range_bounds(wanted, index, {}))
    early, late = blocks.read_ranges(bounds, wanted, index, 3, {}, first=3)
    of = lambda df: {r.query_id: r.n for r in df.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    ranges, rest = of(bounds), of(late)
    assert ranges["q1"] > 60 and rest.get("q1", 0) < ranges["q1"] // 2  # a rare term beside a common one
    # No range holds more than its bound says.
    every = blocks._scores(bounds, wanted, index, {}).withColumn("range", F.floor(F.col("no") / 8))
    over = every.alias("s").join(bounds.alias("b"), ["query_id", "kb_id", "index_version", "range"]).filter("s.score > b.score + 1e-6")
    assert every.count() > 500 and over.count() == 0


def test_lengths_that_change_later_keep_the_bounds(spark, corpus, index, tmp_path):
    """Bounds hold tf and length, not scores: another average length leaves the result exact."""
    queries, scope = asked(spark)
    longer = blocks.BlockIndex(spark, str(tmp_path))
    for name in ("chunks", "blocks", "terms"):
        rows = index.table(name)
        (rows.write.partitionBy("kb_id", "index_version") if name == "blocks" else rows.write).parquet(f"{tmp_path}/{name}")
    index.table("fields").withColumn("total", F.col("total") * 9).write.parquet(f"{tmp_path}/fields")
    fields = keyword.whole_index(longer.table("fields"))
    plain = keyword.bm25_top_k(queries, scope, keyword.postings(corpus, content="content", title="title"), 10, {}, fields)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    assert rows(blocks.block_top_k(queries, scope, longer, 10, {}, 2)) == rows(plain)
