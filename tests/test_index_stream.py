"""Texts are shuffled only for documents that have several rows."""

from pyspark.sql import functions as F

from trawl.sources.shared import stored
from trawl.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_rows(spark):
    rows = [("a", "old", 1), ("a", "new", 2), ("b", "same", 1), ("b", "same", 1), ("c", None, 1), (None, "x", 1), (None, "y", 2), ("d", "one", None)] + [(f"e{i}", "z" * 400, i) for i in range(400)]
    batch = stored(spark.createDataFrame(rows, "document_id string, content string, updated_at int"))
    got = sorted((str(r.document_id), r.content) for r in jobs.newest_rows(batch).collect() if not str(r.document_id).startswith("e"))
    assert got == [("None", "y"), ("a", "new"), ("b", "same"), ("c", None), ("d", "one")]
    assert jobs.newest_rows(batch).count() == 405


def test_current_chunks_stay_where_they_lie(spark):
    documents = spark.createDataFrame([(f"d{i}", 0, 1) for i in range(400)] + [("d1", 1, 2), ("d2", 1, 0)], "document_id string, batch int, updated_at int")
    documents = stored(documents.withColumn("version", F.struct("updated_at", F.xxhash64("updated_at").alias("h"))))
    chunks = stored(spark.createDataFrame([(f"d{i}", 0, "z" * 400) for i in range(400)] + [("d1", 1, "new"), ("d2", 1, "late"), ("d3", 7, "unfinished")], "document_id string, batch int, content string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # the list of all documents is over it
    try:
        found = jobs.current_chunks(chunks, documents)
        assert "SortMergeJoin" not in plan(found) and "hashpartitioning" not in plan(found)
        rows = {(r.document_id, r.batch) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows == {(f"d{i}", 0) for i in range(400) if i != 1} | {("d1", 1)}
