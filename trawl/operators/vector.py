"""Exact cosine top-k over chunk vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    """Sum of products in element order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(ZERO), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best rows of each query with their rank; plans as a partial and a final top-k."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Pairs every row with the queries whose scope names its (kb_id, index_version)."""
    return rows.join(scope, ["kb_id", "index_version"])


def successful(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """D3: chunks whose document is indexed (status 1)."""
    return chunks.join(documents.filter("status = 1").select("document_id"), "document_id", "left_semi")


#: Chunks and queries of a base that a task multiplies at once.
CHUNK_BLOCK, QUERY_BLOCK = 8192, 2048
#: Queries whose scores against a block are held at once.
SLICE = 256


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors become rows of nan."""
    x = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = set(x.value_lengths().to_pylist())
    if len(sizes) == 1 and None not in sizes:  # no Python object for each component
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    else:
        x = np.stack([np.asarray(v, np.float64) for v in x.to_pylist()])
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_BASE = ["tenant_id", "kb_id", "index_version"]
_HIT = ["query_id", *_BASE, "document_id", "chunk_id"]


def _block_top_k(k: int):
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return pa.table({**{c: pa.array([], pa.string()) for c in _HIT}, "score": pa.array([], pa.float64())})
        chunk_units = _unit(chunks["embedding"]).T
        ids, kbs = (np.array(chunks[c].to_pylist()) for c in ("chunk_id", "kb_id"))
        rows, columns, kept = [], [], []
        for start in range(0, queries.num_rows, SLICE):
            scores = np.round(_unit(queries["query_vector"].slice(start, SLICE)) @ chunk_units, 12)  # equal vectors tie
            scores = np.where(np.isfinite(scores), scores, -np.inf)
            for i, own in enumerate(scores, start):
                at = np.flatnonzero(own >= (np.partition(own, -k)[-k] if len(own) > k else -np.inf))
                at = at[np.isfinite(own[at])]
                at = at[np.lexsort((ids[at], kbs[at], -own[at]))][:k]
                rows += [i] * len(at)
                columns += at.tolist()
                kept += own[at].tolist()
        of = pa.array(columns, pa.int64())
        found = {"query_id": queries["query_id"].take(pa.array(rows, pa.int64())), **{c: chunks[c].take(of) for c in _HIT[1:]}}
        return pa.table({**found, "score": pa.array(kept, pa.float64())})

    return run


def _in_blocks(asked: DataFrame, rows: DataFrame, base: list[str], k: int) -> DataFrame:
    """The k best chunks of ``rows`` for each query of ``asked``, of those that share ``base``.

    The chunks of a base are dealt over as many blocks as their count asks for, its queries
    likewise, and each pair of blocks is one small matrix product that gives its k best: what
    is ranked at the end grows with queries and blocks, not with pairs.
    """
    count = lambda df, size, name: df.groupBy(base).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    blocks = count(rows, CHUNK_BLOCK, "chunk_blocks").join(count(asked, QUERY_BLOCK, "query_blocks"), base)
    dealt = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, base).withColumn("query_block", dealt("query_blocks", "query_id")).select("query_id", "query_vector", *base, "query_block", each("chunk_blocks").alias("chunk_block"))
    kept = list(dict.fromkeys([*_HIT[1:], "embedding", *base]))
    right = rows.join(blocks, base).withColumn("chunk_block", dealt("chunk_blocks", "chunk_id", "kb_id")).select(*kept, "chunk_block", each("query_blocks").alias("query_block"))
    on = [*base, "query_block", "chunk_block"]
    hits = left.groupBy(on).cogroup(right.groupBy(on)).applyInArrow(_block_top_k(k), ", ".join(f"{c} string" for c in _HIT) + ", score double")
    return ranked(hits, k, F.desc("score"), F.asc("kb_id"), F.asc("chunk_id"))


def cosine_top_k(queries: DataFrame, scope: DataFrame, chunks: DataFrame, k: int, documents: DataFrame | None = None) -> DataFrame:
    """For each query (query_id, tenant_id, query_vector) its k most similar chunks, of the
    bases in its scope. Chunks without a vector and zero vectors are no hits; vectors of a base
    have one dimension (C2 checks it)."""
    rows = chunks.filter("embedding IS NOT NULL AND size(embedding) > 0")
    if documents is not None:
        rows = successful(rows, documents)
    asked = scope.select("query_id", "kb_id", "index_version").distinct().join(queries.filter("size(query_vector) > 0").select("query_id", "tenant_id", "query_vector"), "query_id")
    return _in_blocks(asked, rows, _BASE, k)


def cosine_top_k_blocks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """D1 over one open scope: every query may see every chunk."""
    rows = chunks.filter("embedding IS NOT NULL AND size(embedding) > 0").withColumn("_all", F.lit(0))
    asked = queries.filter("size(query_vector) > 0").select("query_id", "query_vector", F.lit(0).alias("_all"))
    return _in_blocks(asked, rows, ["_all"], k).select("query_id", "kb_id", "chunk_id", "score", "rank")
