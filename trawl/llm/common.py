"""Shared helpers of the corpus operators: tables, scratch space, text bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the separators of words in every contract.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder. Where it is unset a temporary folder is made
    once and set for the session, but only if all tasks run in this process (``local``):
    elsewhere a machine's own folder would lose rows without an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.trawl.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trawl-")
        spark.conf.set("spark.trawl.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for the frames; nothing may be read from them any more.

    Shuffle files go when the driver's collector finds their plans unused, so it is asked to.
    """
    spark = None
    for df in frames:
        if path := getattr(df, "stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark:
        gc.collect()
        spark._jvm.System.gc()


#: Texts that Spark hands over to a worker at a time, at most, where workers hold much else: its
#: default of 10,000 whole texts is tens of megabytes on both sides.
BATCH_ROWS = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside; the session's own
    setting holds again afterwards."""
    before = spark.conf.get(_BATCH_KEY)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


#: Rows that a worker holds as Python values at a time.
AT_ONCE = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers wait for other tasks


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id's text leaves that remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, and where each begins (one more entry than texts)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as a struct ``row``, with ``_id`` and ``_th``, which name a row by its doc_id and
    text, null or not. As a struct, columns of any name go through unchanged."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text")).alias("_th"))


#: Rows that share a key are numbered in so many buckets of their contents.
BUCKETS = 1024


def numbered(rows: DataFrame, on: list[str], content: Column) -> DataFrame:
    """``rows`` with ``_nth``, a number from 0 within ``on`` in an order of their ``content``.

    Rows are numbered within a bucket of contents and a partition, and numbers go on from the
    counts of such cells, so rows of one key need not meet in one task. Rows of equal content
    take any order, which cannot be seen; so do, across partitions, those of one bucket.
    """
    cells = [*on, "_bucket", "_part"]
    rows = rows.withColumn("_content", content).withColumns({"_bucket": F.pmod(F.xxhash64("_content"), F.lit(BUCKETS)), "_part": F.spark_partition_id()})
    rows = stored(rows, "numbered")
    earlier = Window.partitionBy(on).orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(cells).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(cells).orderBy("_content")) - 1)
    return within.join(bases, cells).withColumn("_nth", F.col("_nth") + F.col("_base")).drop("_content", "_bucket", "_part", "_base")


def attach(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Joins stored ``decisions`` (_id, _th and more; one row per row of docs, or fewer) to docs.

    The result has the document as a struct ``row`` and the decision's further columns. Rows
    that repeat with the same id and text are matched one to one by number (the greatest
    decisions to the first in order of their other columns); that writes the documents once
    more and is only planned where such rows exist.
    """
    on = ["_id", "_th"]
    rows = keyed(docs)
    if decisions.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = numbered(rows, on, F.to_json("row"))
        rest = [c for c in decisions.columns if c not in on]
        decisions = numbered(decisions, on, F.to_json(F.struct(*rest)) if rest else F.lit(""))
        on = [*on, "_nth"]
    return rows.join(decisions, on).drop(*on)


#: Documents that a sample wants in all, whatever the number of labels.
IN_ALL = 100_000


def sample_ids(rows: DataFrame, label: str, per_label: int, in_all: int = IN_ALL) -> DataFrame:
    """About ``per_label`` different (doc_id, label) of each label, or fewer of each where there
    are so many labels that ``in_all`` would be passed.

    A pair is chosen if its hash is below the share of its label that is wanted, so no task
    meets all rows of a label; at most twice the number in all are kept, of least hash. The
    driver holds a row for each label.
    """
    pairs = stored(rows.select("doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).distinct(), "label-ids")
    counts = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    per_label = max(1, min(per_label, in_all // max(1, len(counts))))
    bounds = [(r[label], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, per_label / r.n)))) for r in counts]
    spark = rows.sparkSession
    shares = spark.createDataFrame(bounds, T.StructType([T.StructField(label, pairs.schema[label].dataType), T.StructField("most", T.LongType())]))
    chosen = pairs.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(shares), label).filter("h <= most")
    return chosen.orderBy("h", "doc_id", label).limit(2 * per_label * max(1, len(bounds))).select("doc_id", label)


def one_text(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, text) of sampled ids: one text for each, whatever rows share an id."""
    on = [c for c in ("doc_id", label) if c in docs.columns]
    texts = docs.select(*on, "text").join(F.broadcast(ids), on)
    return texts.groupBy("doc_id", label).agg(F.min("text").alias("text"))
