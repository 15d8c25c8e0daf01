"""Documents from files and tables, and JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import strip

# File kinds and the size cap.
KINDS = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".html": "html", ".htm": "html"}
MAX_BYTES = 20 * 1024 * 1024
MAX_TITLE = 255


def source_type(name: Column) -> Column:
    """A5: the kind of a document by its file suffix; null for other suffixes."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), suffix)


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """A1: files under ``path`` with kind and title, and rejected files with the reason.

    Spark's binaryFile source passes over files of no bytes; they appear on neither side.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("path", "length", "content", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"))
    rows = rows.withColumns({"source_type": source_type(F.col("name")), "title": strip(F.regexp_replace("name", r"\.[^.]*$", ""))})
    reason = (
        F.when(F.col("source_type").isNull(), "unsupported_type")
        .when(F.col("length") > max_bytes, "too_large")
        .when((F.col("title") == "") | (F.length("title") > MAX_TITLE), "invalid_title")
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("path", "name", "length", "reason")


def decode(content: Column) -> Column:
    """A2: UTF-8 without byte order mark, with plain line ends, trimmed; null where it is invalid."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return strip(F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}", ""), r"\r\n?", "\n"))


def resolve_content(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """A4: stored text wins unless a reparse is asked for or it is blank; blank is a failure."""
    rows = stored.join(parsed.select("document_id", F.col("content").alias("_parsed"), F.col("error").alias("_error")), "document_id", "full_outer")
    own = F.nullif(strip(F.coalesce("content", F.lit(""))), F.lit(""))
    new = F.nullif(strip(F.coalesce("_parsed", F.lit(""))), F.lit(""))
    use_new = F.coalesce("reparse", F.lit(False)) | own.isNull()
    text = F.when(use_new, new).otherwise(F.col("content"))
    return rows.select("document_id", text.alias("content"), F.when(text.isNull(), F.coalesce("_error", F.lit("document content is empty"))).alias("message"))


def read_dataset(spark: SparkSession, path: str, case_schema: str) -> DataFrame:
    """The cases of a JSON dataset, with their position."""
    data = spark.read.schema(f"name string, kb_id string, cases array<struct<{case_schema}>>").json(path, multiLine=True)
    return data.select(F.col("name").alias("dataset"), F.col("kb_id").alias("dataset_kb_id"), F.posexplode("cases").alias("pos", "c")).select("dataset", "dataset_kb_id", "pos", "c.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
