"""Indexing jobs: split and embed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import let, retrieval_text
from trawl.operators.admin import PROCESSING, next_status
from trawl.operators.chunking import split_documents
from trawl.operators.keyword import counted, tokens

DIMENSION = 64
BATCH = 20


def hash_embedding(chunks: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """C1, the default embedder: each term adds a sign to one of ``dimension`` places; unit length.

    All built-in functions, so it stays in the JVM; a text without terms has no embedding.
    """
    h = F.transform(tokens(F.col("embed_text")), lambda x: F.xxhash64(x))
    # A place's terms are counted by sign, in the chunk's own row.
    codes = F.transform(h, lambda x: (F.pmod(x, F.lit(dimension)) * 2 + F.pmod(F.shiftright(x, 20), F.lit(2))).cast("int"))
    m = F.map_from_entries(counted(codes))

    def vector(m: Column) -> Column:
        n = lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0))
        sums = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (n(2 * i) - n(2 * i + 1)).cast("double"))
        return let(sums, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))))

    return chunks.withColumn("embedding", let(m, vector))


def embed_with(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int = DIMENSION, batch: int = BATCH) -> DataFrame:
    """Embeds by a function of at most ``batch`` texts, with count and length checked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, vectors = rows.column(rows.schema.names.index("embed_text")).to_pylist(), []
            for at in range(0, len(texts), batch):
                part = embed(texts[at : at + batch])
                if len(part) != len(texts[at : at + batch]) or any(len(v) != dimension for v in part):
                    raise ValueError("embedding count or dimension does not match")
                vectors += [np.asarray(v, np.float32) for v in part]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*rows.schema.names, "embedding"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def index_documents(documents: DataFrame, version: str = "v2", size: int = 800, overlap: int = 100, embedder: Callable[[DataFrame], DataFrame] = hash_embedding) -> DataFrame:
    """Chunk rows of ``documents`` (document_id, tenant_id, kb_id, title, source_type, content).

    Chunk ids are hashes of document, version and place, so a rerun gives equal rows. v1 embeds
    the raw text, later versions the retrieval text.
    """
    pieces = split_documents(documents.filter("document_id IS NOT NULL"), version, size, overlap, carry=("tenant_id", "kb_id", "title"))
    text = retrieval_text(F.col("title"), F.col("heading_path"), F.col("text"))
    rows = pieces.select(
        F.sha1(F.concat_ws(":", "document_id", F.lit(version), "order_index")).alias("chunk_id"), "tenant_id", "kb_id", "document_id", "title", F.col("text").alias("content"),
        text.alias("retrieval_text"), F.lit(version).alias("index_version"), "section_id", "parent_section_id", "order_index", "heading_path", "chunk_type",
        (F.col("text") if version == "v1" else text).alias("embed_text"),
    )
    return embedder(rows).drop("embed_text")


def index_with_status(documents: DataFrame, errors: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Chunks of the documents in processing, and the new status of each."""
    todo = documents.filter(F.col("status") == PROCESSING).join(errors.select("document_id"), "document_id", "left_anti")
    chunks = index_documents(todo, **options)
    produced = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return chunks, next_status(documents, produced, errors)
