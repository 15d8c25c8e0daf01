"""A keyword branch that queries share by kind: as the branch given to each query."""

import random

import pytest

from trawl.operators import fusion
from trawl.plans.retrieval_queries import QUERIES

from .test_text_index import shuffled_rows

VECTOR = "query_id string, kb_id string, chunk_id string, document_id string, pos int, score double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    kinds = [(f"q{i}", "ab"[i % 2]) for i in range(12)]
    hits = {k: [("kb", f"c{rng.randrange(60)}", f"d{k}") for _ in range(90)] for k in "ab"}  # some chunks repeated, so ranks skip
    shared = [(k, *x, i + 1, -float(i)) for k, own in hits.items() for i, x in enumerate(own)]
    vector = [(q, "kb", c, "", i + 1, 1.0 / (i + 1)) for q, _ in kinds if q != "q3" for i, c in enumerate(rng.sample([f"c{n}" for n in range(80)], rng.randrange(1, 20)))]
    make = spark.createDataFrame
    kinds = make(kinds, "query_id string, kind string")
    shared = make(shared, VECTOR.replace("query_id", "kind"))
    return make(vector, VECTOR), kinds, shared, shared.join(kinds, "kind").drop("kind")


def plain(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("query_id", "kb_id", "chunk_id", *columns).collect())


def test_fused_as_for_each_query(spark, rows):
    vector, kinds, shared, each = rows
    once = fusion.shared_branch(shared)
    whole = fusion.fuse(vector, each)
    assert plain(fusion.fuse_shared(vector, kinds, once), "score", "rank") == plain(whole, "score", "rank")
    limits = kinds.selectExpr("query_id", "CAST(substr(query_id, 2) AS INT) * 7 AS upto")
    assert plain(fusion.fuse_window(vector, kinds, once, limits), "rank") == plain(whole.join(limits, "query_id").filter("rank <= upto"), "rank")


def test_degraded_as_for_each_query(spark, rows):
    vector, kinds, shared, each = rows
    status = kinds.selectExpr("query_id", "CAST(substr(query_id, 2) AS INT) % 3 <> 0 AS vector_ok", "CAST(substr(query_id, 2) AS INT) % 5 <> 0 AS bm25_ok")
    columns = ("score", "rank", "fusion")
    assert plain(fusion.degrade_shared(vector, kinds, fusion.shared_branch(shared), status), *columns) == plain(fusion.degrade(vector, each, status), *columns)


def test_pairs_of_query_and_chunk_are_not_shuffled(spark, tmp_path):
    rows = [(10_000 + i, [1.0, float(i % 7)], i // 20 % 10) for i in range(2000)]  # 100 queries of 10 kinds
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark)
    found = QUERIES["d7_branch_normal_form"](spark, str(tmp_path)).count()
    written = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    assert found == 40_000 and written < found, (found, written)
