"""Indexing with counted attempts (J2): what fails for a while is tried again, apart from its batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.plans.indexing import index_documents

#: Attempts after the first one.
RETRIES = 2
#: Words in the name of an exception's type that tell a passing failure.
PASSING = ("timeout", "connection", "transport", "temporarily")
_FIELDS = ["document_id", "tenant_id", "kb_id", "title", "source_type", "content", "updated_at"]


def passing(error: BaseException | None) -> bool:
    """Whether an exception, or one that it came from, is of a kind that may pass."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if isinstance(error, (TimeoutError, ConnectionError, OSError)) or any(word in type(error).__name__.lower() for word in PASSING):
            return True
        error = error.__cause__ or error.__context__
    return False


def attempted(documents: DataFrame, work: Callable[[dict], str]) -> DataFrame:
    """``documents`` with ``content`` as ``work`` returns it, and how it failed: ``failure``
    (null, passing or lasting) and ``message``. A row's failure is its own."""
    at = documents.columns.index("content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, failures, messages = [], [], []
            for row in batch.to_pylist():
                content, failure, message = row["content"], None, None
                if content is not None:
                    try:
                        content = work(row)
                    except Exception as error:  # noqa: BLE001  any failure is the document's
                        failure, message = ("passing" if passing(error) else "lasting"), str(error) or type(error).__name__
                contents.append(content)
                failures.append(failure)
                messages.append(message)
            columns = list(batch.columns)
            columns[at] = pa.array(contents, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failures, pa.string()), pa.array(messages, pa.string())], names=[*batch.schema.names, "failure", "message"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("failure", T.StringType()), T.StructField("message", T.StringType())]))


def index_attempts(documents: DataFrame, path: str, checkpoint: str, work: Callable[[dict], str], retries: int = RETRIES, **options):
    """One run over the new documents of a stream and over the retry table, its second source.

    Each micro-batch tries its rows once: chunks of what succeeds go to ``chunks``, what fails
    for a while goes back to the table of ``retries`` with its count, and documents that fail
    for good, or once more than ``retries`` times, are FAILED with their message. All are
    folders of the batch, so its replay writes the same again.
    """
    spark = documents.sparkSession
    first = documents.select(*_FIELDS, F.lit(0).alias("attempt"))
    spark.createDataFrame([], first.schema).write.mode("append").parquet(f"{path}/retries")
    again = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{path}/retries")

    def write(batch: DataFrame, number: int) -> None:
        version = F.struct("updated_at", F.xxhash64(*_FIELDS).alias("h"))
        newest = Window.partitionBy("document_id").orderBy(version.desc(), F.desc("attempt"))
        rows = batch.withColumn("version", version).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        attempted(rows, work).write.mode("overwrite").parquet(f"{path}/attempts/batch={number}")
        tried = batch.sparkSession.read.parquet(f"{path}/attempts/batch={number}")  # a worker's failure is tried once
        done = tried.filter("failure IS NULL")
        chunks = index_documents(done.filter("content IS NOT NULL").select(*_FIELDS[:-1]), **options)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        made = batch.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks/batch={number}").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
        waits = (F.col("failure") == "passing") & (F.col("attempt") < retries)
        # The retry carries the row as it came, not what an attempt made of it.
        back = rows.join(tried.filter(waits).select("document_id"), "document_id", "left_semi")
        back.select(*_FIELDS, (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(f"{path}/retries/batch={number}")
        status = F.when(waits, "RETRYING").when(F.col("failure").isNotNull(), "FAILED").when(F.col("content").isNull(), "DELETED").when(F.col("chunks").isNull(), "FAILED").otherwise("INDEXED")
        rows = tried.join(made, "document_id", "left").select("document_id", "version", (F.col("attempt") + 1).alias("attempts"), F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"), F.coalesce("message", F.when(status == "FAILED", "no chunks")).alias("message"))
        rows.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return first.unionByName(again).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_with_retries(documents: DataFrame, path: str, checkpoint: str, work: Callable[[dict], str], retries: int = RETRIES, wait_seconds: float = 10, **options) -> None:
    """``index_attempts`` until the retry table has nothing new."""
    spark = documents.sparkSession
    for turn in range(retries + 1):
        job = index_attempts(documents, path, checkpoint, work, retries, **options)
        job.awaitTermination()
        if not attempts(spark.read.parquet(f"{path}/documents")).filter("status = 'RETRYING'").limit(1).count():
            return
        if turn < retries:
            time.sleep(wait_seconds)


def attempts(documents: DataFrame) -> DataFrame:
    """The last state of each document: of its newest row, the attempt that came last."""
    last = F.max_by(F.struct("attempts", "chunks", "status", "message", "batch"), F.struct("version", "attempts", "batch"))
    return documents.groupBy("document_id").agg(last.alias("x")).select("document_id", "x.*")
