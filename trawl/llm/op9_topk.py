"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

Vectors are cut into equal segments at two resolutions. With the means m and deviations s of
the segments (of n components each), a product is at most the sum over segments of
n * (m_q * m_x + s_q * s_x), which is a lower bound on the distance. Inside a task each block
of candidates is bounded coarse to fine against the best k scores that the task has so far,
and exact scores are computed for what survives; Spark then merges the tasks' best k. Queries
come in waves of at most about ``WAVE``, each a broadcast of known size, and each wave's
results are appended to one table.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; a query meets only candidates of its own length and not those with its own vec_id (rows
that share an id count as the same); a null vec_id is a candidate, after all others in ties,
and no query; query rows with equal id and vector are one query, those with equal id and
other vectors are queries of their own, each with its ranks; repeated candidate rows each
count; ties go to the smaller vec_id; components of any finite size are exact integers, and
scores outside the range of a long are clipped; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import scratch, table

K = 10
SCALE = 1024
WAVE = 4096
BLOCK = 2048
SEGMENTS = (4, 16)
EVERY = 100
RESULT = "query_id long, query_no long, vec_id long, score long"
EXACT = 2.0**53  # integers below it are exact as doubles


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v) as exact doubles, or as Python integers where doubles do not hold them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * v)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([int(x) if np.isfinite(x) else scale * int(y) for x, y in zip(scaled, v, strict=True)], object)


def quantised(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their integer components."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    flat = pc.list_flatten(vectors)
    values = np.asarray(pc.fill_null(flat, float("nan")), dtype=np.float64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    return rows, [integers(values[e - n : e], scale) for e, n in zip(ends[rows], sizes[rows], strict=True)]


def matrices(ids: list, vectors: pa.Array) -> dict[int, tuple[list, np.ndarray]]:
    """By length: ids (any may be None) and a matrix of integer components."""
    rows, parts = quantised(vectors)
    by: dict[int, list] = {}
    for r, v in zip(rows, parts, strict=True):
        by.setdefault(len(v), []).append((ids[r], v))
    return {n: ([i for i, _ in x], np.stack([v for _, v in x])) for n, x in by.items()}


def small(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether products of the rows are exact in double precision."""
    if object in (q.dtype, x.dtype):
        return False
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighed so that products of two rows bound theirs."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, b:e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([np.stack([np.sqrt(p.shape[1]) * p.mean(axis=1) for p in parts], axis=1), np.stack([np.sqrt(p.shape[1]) * p.std(axis=1) for p in parts], axis=1)], axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs."""
    if small(q, x):
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.vectorize(lambda v: max(-(2**63), min(2**63 - 1, v)), otypes=[np.int64])(exact)


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, ids: list, q: np.ndarray, k: int = K, segments: tuple[int, ...] = SEGMENTS):
        self.ids, self.q, self.k = np.array(ids, np.int64), q, k
        self.levels = [(s, statistics(q, s)) for s in segments if s < q.shape[1]] if small(q, q) else []
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in ids]  # (-score, no id, vec_id), ascending
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: list, x: np.ndarray) -> None:
        none = np.array([i is None for i in ids])
        ids = np.array([i or 0 for i in ids], np.int64)
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))
        alive = np.ones((len(rows), len(cols)), bool)
        # Bounds are computed in doubles, so they are asked where these hold the products.
        for s, stats in self.levels if np.isfinite(self.least).any() and small(self.q, x) else []:
            own = statistics(x[cols], s)
            slack = 1e-9 * np.linalg.norm(stats[rows], axis=1)[:, None] * np.linalg.norm(own, axis=1)[None, :] + 1
            alive &= stats[rows] @ own.T + slack >= self.least[rows, None]
            r, c = alive.any(axis=1), alive.any(axis=0)
            rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
        if not len(rows) or not len(cols):
            return
        score = products(self.q[rows], x[cols])
        alive &= (score >= self.least[rows, None]) & (none[cols] | (ids[cols] != self.ids[rows, None]))
        for i in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[i])
            if len(at) > self.k:  # the k best and their ties
                kth = np.partition(score[i, at], -self.k)[-self.k]
                at = at[score[i, at] >= kth]
            own, of = self.found[rows[i]], cols[at]
            merged = sorted([*own, *((-v, n, j) for v, n, j in zip(score[i, at].tolist(), none[of].tolist(), ids[of].tolist(), strict=True))])[: self.k]
            self.found[rows[i]] = merged
            if len(merged) == self.k:
                self.least[rows[i]] = -merged[-1][0]


def _searcher(queries, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(ids, q, k) for n, (ids, q) in queries.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for n, (ids, x) in matrices(part.column(0).to_pylist(), part.column(1)).items():
                    if n in best:
                        best[n].add(ids, x)
        rows = [(int(q), n, number, None if none else v, -s) for n, b in best.items() for number, (q, found) in enumerate(zip(b.ids, b.found, strict=True)) for s, none, v in found]
        columns = [[r[0] for r in rows], [r[1] << 32 | r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_no", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, wave: int = WAVE) -> DataFrame:
    """For each query row of ``vectors`` (vec_id, embedding) its k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = vectors.filter(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL").distinct()
    waves = max(1, -(-queries.count() // wave))
    path = scratch(spark, "nearest")
    for w in range(waves):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).orderBy("vec_id", "embedding").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(matrices(own.column("vec_id").to_pylist(), own.column("embedding").combine_chunks()))
        order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        found = rows.mapInArrow(_searcher(shared, k), RESULT).withColumn("rank", F.row_number().over(order))
        found.filter(F.col("rank") <= k).drop("query_no").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(path).select("query_id", "rank", "vec_id", "score")


def op9_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id IS DISTINCT FROM c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
