"""Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.plans.indexing import index_documents
from trawl.sources.shared import stored

SCORES = (1, 5)


def index_stream(documents: DataFrame, path: str, checkpoint: str, **options):
    """Keeps the chunk table under ``path`` current with a stream of documents.

    A micro-batch writes all chunks of its documents to a folder of its own (``batch=<id>``), so
    its replay writes the same again; readers take a document's chunks from the batch of its
    newest row (``updated_at``, then a hash of the row, so the order of batches does not matter).
    A row with null content deletes its document. Documents that yield no chunk are FAILED with
    a message, the others INDEXED; a failing task is Spark's to retry, up to
    ``spark.task.maxFailures``, and a batch that still fails stops the stream before anything of
    it is seen.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = newest_rows(batch)
        chunks = index_documents(rows.filter("content IS NOT NULL").drop("version"), **options)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        made = batch.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks/batch={number}").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
        # Of the content only whether there is any goes on, so no text is shuffled to join counts.
        known = rows.select("document_id", "version", F.col("content").isNull().alias("gone"))
        status = F.when(F.col("gone"), "DELETED").when(F.col("chunks").isNull(), "FAILED").otherwise("INDEXED")
        done = known.join(made, "document_id", "left").select("document_id", "version", F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"), F.when(status == "FAILED", "no chunks").alias("message"))
        done.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(batch: DataFrame) -> DataFrame:
    """The newest row of each document, with its ``version``.

    Only rows of documents that have more than one are shuffled and ranked. The ids of these
    are stored first, so that Spark knows how few they are and can leave the other texts where
    they lie.
    """
    version = F.struct("updated_at", F.xxhash64(*batch.columns).alias("h"))
    repeated = stored(batch.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("document_id").alias("_id")), "repeated")
    rows, same = batch.withColumn("version", version), F.col("document_id").eqNullSafe(F.col("_id"))
    newest = Window.partitionBy("document_id").orderBy(F.desc("version"))
    ranked = rows.join(repeated, same, "left_semi").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return rows.join(repeated, same, "left_anti").unionByName(ranked)


def current_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks of each document's newest row.

    Left out are chunks of batches that are not finished, and those of older rows. Which these
    are is stored first: where few documents changed, the chunks are read without a shuffle.
    """
    rows = documents.select("document_id", "batch", "version").withColumn("newest", F.max(F.struct("version", "batch")).over(Window.partitionBy("document_id")))
    old = stored(rows.filter("batch <> newest.batch").select("document_id", "batch").distinct(), "old")
    finished = stored(documents.select("batch").distinct(), "finished")
    return chunks.filter("document_id IS NOT NULL").join(finished, "batch", "left_semi").join(old, ["document_id", "batch"], "left_anti")


def compact_index(spark: SparkSession, path: str, into: str) -> None:
    """Writes the current chunks and the newest row of each document of the index under
    ``path`` as batch 0 of a new index under ``into``, for a stream that goes on from there."""
    chunks, documents = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/documents")
    current_chunks(chunks, documents).drop("batch").write.parquet(f"{into}/chunks/batch=0")
    newest = F.max_by(F.struct("version", "chunks", "status", "message"), F.struct("version", "batch"))
    documents.groupBy("document_id").agg(newest.alias("x")).select("document_id", "x.*").write.parquet(f"{into}/documents/batch=0")


def request_counts(requests: DataFrame, unit: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """A tenant's requests per window; what comes later than ``late`` is dropped."""
    return requests.withWatermark("ts", late).groupBy("tenant_id", F.window("ts", unit).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tenant_id", F.col("w.start").alias("start"), "n")


def daily_successes(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A tenant's successes per UTC day, kept for ``late`` beyond the day."""
    return request_counts(requests.filter("success"), "1 day", late)


def over_rate(counts: DataFrame, plans: DataFrame) -> DataFrame:
    """Windows with more requests than the tenant's plan allows (stream-static join)."""
    return counts.join(plans.select("tenant_id", "qps"), "tenant_id").filter("n > qps")


def valid_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Scores 1 to 5 on traces of the same tenant and log."""
    rows = feedback.filter(F.col("score").between(*SCORES) & (F.col("score") == F.floor("score")))
    known = traces.select("trace_id", F.col("tenant_id").alias("_t"), F.col("log_id").alias("_l"))
    return rows.join(known, "trace_id").filter("tenant_id = _t AND log_id = _l").drop("_t", "_l")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One score for each trace, the latest, under a stable id."""
    best = feedback.groupBy("trace_id").agg(F.max_by(F.struct("score", "comment", "ts"), F.struct("ts", "score")).alias("x"))
    return best.select(F.concat(F.lit("feedback-"), F.substring(F.sha1("trace_id"), 1, 24)).alias("feedback_id"), "trace_id", "x.*")


def feedback_stream(feedback: DataFrame, traces: DataFrame, path: str, checkpoint: str):
    """Upserts: each batch adds its latest scores, ``latest_feedback`` of the folder is current."""

    def write(batch: DataFrame, number: int) -> None:
        latest_feedback(valid_feedback(batch, traces)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feedback.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_records(events: DataFrame) -> DataFrame:
    """Stage events (log_id, stage, payload) as one record per request."""
    return events.groupBy("log_id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("stage", "payload")))).alias("stages"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into a table in memory, for tests."""
    job = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.table(name)


def to_parquet(stream: DataFrame, path: str) -> DataFrame:
    """Runs an aggregated stream to its end; the result of its last batch lies in ``path``.

    Executors write each batch's whole result into a folder of its own, so a replay is harmless
    and no rows come to the driver.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        done.append(number)

    job = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={done[-1]}") if done else spark.createDataFrame([], stream.schema)
