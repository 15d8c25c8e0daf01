"""Exact cosine top-k over stored blocks of vectors, pruned by the triangle inequality.

Every vector, at unit length, belongs to the nearest of a bounded number of pivots, and to a
ring of distances from it. A block is such a ring within one base, and beside it stand its
least and largest distance from the pivot. No vector of a block can be nearer to a query than
the query's own distance from the pivot leaves open, and nearness at unit length is cosine. A
query's most promising blocks are multiplied first; of the others only those that could still
hold one of the k best are read. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.operators.vector import _BASE, _HIT, QUERY_BLOCK, _block_top_k, _unit, ranked
from trawl.sources.shared import stored

#: Pivots, thickness of a ring, vectors of a block, and a query's blocks that are read first.
PIVOTS, RING, BLOCK, FIRST = 64, 0.1, 4096, 4
#: More than rounding can move a bound or a score.
SLACK = 1e-7
_CELL = [*_BASE, "cell", "ring", "part"]


def _placed(pivots: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("embedding")
            unit = _unit(batch.column(at))
            whole = np.isfinite(unit).all(axis=1)  # zero vectors are no hits
            batch, unit = batch.filter(pa.array(whole)), unit[whole]
            cosine = unit @ pivots.T
            cell = cosine.argmax(axis=1) if len(unit) else np.empty(0, np.int64)
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[np.arange(len(unit)), cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _distances(pivots: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1))
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ pivots.T))) if len(pivots) else np.empty((len(unit), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(far), pa.list_(pa.float64()))], names=["query_id", "far"])

    return run


_TABLES = {
    "vectors": "tenant_id string, document_id string, chunk_id string, embedding array<float>, cell int, far double, ring int, part int, kb_id string, index_version string",
    "blocks": "tenant_id string, kb_id string, index_version string, cell int, ring int, part int, near double, far double, n long",
    "pivots": "cell int, vector array<double>",
}


class VectorIndex:
    """``vectors`` (the chunk's columns, cell, ring, part, far), ``blocks`` (tenant_id, kb_id,
    index_version, cell, ring, part, near, far, n) and ``pivots`` (cell, vector) under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    def pivots(self) -> np.ndarray:
        rows = self.table("pivots").orderBy("cell").collect()  # at most PIVOTS
        return np.array([r.vector for r in rows], np.float64)


def write_vectors(chunks: DataFrame, path: str, pivots: int = PIVOTS, ring: float = RING, block: int = BLOCK) -> VectorIndex:
    """Writes the index of ``chunks`` (tenant_id, kb_id, index_version, document_id, chunk_id,
    embedding); vectors have one dimension. Pivots are vectors of least hash."""
    spark = chunks.sparkSession
    rows = chunks.select(*_HIT[1:], "embedding").filter("embedding IS NOT NULL AND size(embedding) > 0")
    some = rows.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("chunk_id", "kb_id"), "chunk_id", "kb_id").limit(pivots).collect()
    if some:
        chosen = np.unique(_unit(pa.chunked_array([pa.array([list(r.embedding) for r in some])])), axis=0)
        vectors = [(i, v.tolist()) for i, v in enumerate(chosen)]
    else:
        chosen, vectors = np.empty((0, 1)), []
    spark.createDataFrame(vectors, "cell int, vector array<double>").write.parquet(f"{path}/pivots")
    kind = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    placed = rows.mapInArrow(_placed(chosen), kind) if some else spark.createDataFrame([], kind)
    placed = stored(placed.withColumn("ring", F.floor(F.col("far") / ring).cast("int")), "placed")
    parts = placed.groupBy(*_BASE, "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = placed.join(parts, [*_BASE, "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    placed.repartition(*_BASE, "cell").sortWithinPartitions("cell", "ring", "part").write.partitionBy("kb_id", "index_version").parquet(f"{path}/vectors")
    held = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    held.groupBy(*_CELL).agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/blocks")
    return VectorIndex(spark, path)


def block_bounds(queries: DataFrame, scope: DataFrame, index: VectorIndex) -> DataFrame:
    """(query_id, query_vector, block's columns, most): the highest cosine a block may hold."""
    asked = queries.filter("size(query_vector) > 0 AND exists(query_vector, x -> x <> 0)").select("query_id", "tenant_id", "query_vector")
    far = asked.select("query_id", "query_vector").mapInArrow(_distances(index.pivots()), "query_id string, far array<double>").withColumnRenamed("far", "fars")
    wanted = scope.select("query_id", "kb_id", "index_version").distinct().join(asked, "query_id").join(far, "query_id")
    rows = index.table("blocks").join(wanted, _BASE).withColumn("d", F.element_at("fars", F.col("cell") + 1))
    least = F.greatest(F.col("d") - F.col("far"), F.col("near") - F.col("d"), F.lit(0.0))
    return rows.select("query_id", "query_vector", *_CELL, "n", (1 - least * least / 2 + SLACK).alias("most"))


def _multiplied(blocks: DataFrame, index: VectorIndex, k: int, most: int = QUERY_BLOCK) -> DataFrame:
    """The k best of each given block for each query that asks for it. A block that more than
    ``most`` queries ask for is multiplied in several tasks, so a task's memory does not grow."""
    asked = blocks.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("groups"))
    vectors = index.table("vectors").join(asked, _CELL).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*dict.fromkeys([*_HIT[1:], "embedding", *_CELL, "group"]))
    queries = blocks.select("query_id", "query_vector", *_CELL).join(asked, _CELL).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")
    on, kind = [*_CELL, "group"], ", ".join(f"{c} string" for c in _HIT) + ", score double"
    return queries.groupBy(on).cogroup(vectors.groupBy(on)).applyInArrow(_block_top_k(k), kind)


def read_blocks(bounds: DataFrame, index: VectorIndex, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(hits of the first blocks, the further blocks that can reach a query's threshold)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), *_CELL)
    placed = bounds.withColumn("place", F.row_number().over(order))
    early = stored(_multiplied(placed.filter(F.col("place") <= first), index, k), "hits")
    threshold = ranked(early, k, F.desc("score")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    rest = placed.filter(F.col("place") > first).join(threshold, "query_id", "left")
    return early, rest.filter(F.col("threshold").isNull() | (F.col("most") >= F.col("threshold")))


def pivot_top_k(queries: DataFrame, scope: DataFrame, index: VectorIndex, k: int, first: int = FIRST) -> DataFrame:
    """As ``vector.cosine_top_k``, from the stored index."""
    bounds = stored(block_bounds(queries, scope, index), "bounds")
    early, late = read_blocks(bounds, index, k, first)
    hits = early.unionByName(_multiplied(late, index, k))
    return ranked(hits, k, F.desc("score"), F.asc("kb_id"), F.asc("chunk_id"))
