"""The stored vector index against the full product, and the share of blocks that it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import pivots, vector
from trawl.sources.shared import stored

CHUNKS = "tenant_id string, kb_id string, index_version string, document_id string, chunk_id string, embedding array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        v = centres[i % 12] + 0.15 * rng.normal(size=16)
        rows.append(("t", "ab"[i % 2], "v1" if i % 5 else "v2", f"d{i % 90}", f"c{i}", [float(x) for x in v]))
    rows += [("t", "a", "v1", "d0", f"same{i}", [1.0] * 16) for i in range(40)]
    rows += [("t", "a", "v1", "d1", "zero", [0.0] * 16), ("t", "a", "v1", "d1", "none", None), ("t", "a", "v1", "d1", "empty", []), ("u", "a", "v1", "d2", "other", [1.0] * 16)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3)


def asked(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(size=16)] for _ in range(6)] + [[1.0] * 16, [0.0] * 16, None]
    queries = spark.createDataFrame([(f"q{i}", "t", v) for i, v in enumerate(vectors)], "query_id string, tenant_id string, query_vector array<float>")
    scope = queries.select("query_id").crossJoin(spark.createDataFrame([("a", "v1"), ("b", "v1"), ("b", "v2")], "kb_id string, index_version string"))
    return queries, scope


@pytest.mark.parametrize("k,first,block", [(1, 1, 4096), (10, 2, 50), (3000, 3, 64)])
def test_equals_full_product(spark, corpus, tmp_path, k, first, block):
    index = pivots.write_vectors(corpus, f"file://{tmp_path}/i", pivots=16, ring=0.2, block=block)
    queries, scope = asked(spark)
    rows = lambda df: sorted((r.query_id, r["rank"], r.kb_id, r.index_version, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(pivots.pivot_top_k(queries, scope, index, k, first)) == rows(vector.cosine_top_k(queries, scope, corpus, k))


def test_far_blocks_are_not_read(spark, corpus, tmp_path):
    index = pivots.write_vectors(corpus, f"file://{tmp_path}/i", pivots=32)
    queries = corpus.filter("chunk_id LIKE 'c%7'").select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query_vector"))
    scope = queries.select("query_id").crossJoin(spark.createDataFrame([("a", "v1"), ("b", "v1")], "kb_id string, index_version string"))
    bounds = stored(pivots.block_bounds(queries, scope, index))
    early, late = pivots.read_blocks(bounds, index, 5)
    read = late.agg(F.sum("n")).first()[0] or 0
    whole = bounds.agg(F.sum("n")).first()[0]
    assert read < whole // 4
    # No vector is nearer than its block's bound says.
    over = pivots._multiplied(bounds, index, 5000).join(index.table("vectors").select("chunk_id", "kb_id", "cell", "ring", "part"), ["kb_id", "chunk_id"])
    over = over.join(bounds.drop("query_vector"), ["query_id", *pivots._CELL]).filter("score > most")
    assert over.count() == 0


def test_no_vectors(spark, corpus, tmp_path):
    index = pivots.write_vectors(corpus.filter("chunk_id IN ('zero', 'none', 'empty')"), f"file://{tmp_path}/i")
    assert pivots.pivot_top_k(*asked(spark), index, 5).count() == 0


def test_many_queries_of_a_block(spark, corpus, tmp_path, monkeypatch):
    """A task holds the scores of few queries at a time, and a block's queries are dealt out."""
    index = pivots.write_vectors(corpus, f"file://{tmp_path}/i", pivots=4)
    queries, scope = asked(spark)
    bounds = stored(pivots.block_bounds(queries, scope, index))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pivots._multiplied(bounds, index, 7, most=2)) == rows(pivots._multiplied(bounds, index, 7))
    monkeypatch.setattr(vector, "SLICE", 3)
    import pyarrow as pa

    q, c = bounds.select("query_id", "query_vector").limit(40).toArrow(), corpus.filter("size(embedding) > 0").toArrow()
    few = vector._block_top_k(7)(q, c)
    monkeypatch.setattr(vector, "SLICE", 1000)
    whole = vector._block_top_k(7)(q, c)
    assert few.num_rows == q.num_rows * 7 and few.drop_columns("score") == whole.drop_columns("score") and isinstance(few, pa.Table)
