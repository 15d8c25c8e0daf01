"""BM25 over a stored index of blocks, with exact pruning by block bounds.

Chunks have numbers, a block is a term's postings within a range of numbers of one base, and
beside them stand the largest term frequency and the smallest field length, which bound every
score in the block whatever the index's average length has become. A search reads these
bounds first: a range can score no more than the sum of its blocks' bounds. The most promising
ranges of each query are read and give it a threshold, the score of its k-th best chunk so
far; of the others only ranges that can reach the threshold are read at all. What is left out
cannot be among the k best, so the result is that of a full search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators.keyword import K1, B, counted, query_terms, tokens, whole_index
from trawl.operators.vector import ranked
from trawl.sources.shared import stored

#: Chunk numbers in a range; ranges of a query that are read before there is a threshold.
WIDTH, FIRST = 32, 8
_BASE = ["kb_id", "index_version"]
#: More than scores of equal terms may differ by the order of their sum.
SLACK = 1e-6


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A posting's share of the score but for its term's idf; grows with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class BlockIndex:
    """The stored tables: ``chunks`` (kb_id, index_version, chunk_id, no), ``blocks`` (kb_id,
    index_version, field, term, range, tf, dl, postings), ``terms`` (field, term, df) and
    ``fields`` (kb_id, index_version, field, n, total)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def write_index(chunks: DataFrame, path: str, width: int = WIDTH, **fields: str) -> BlockIndex:
    """Writes the index of the named text fields of ``chunks`` under ``path``.

    Texts are cut into tokens once. Chunks are numbered within sorted partitions, so a range
    mostly holds chunks of one base, and no task needs all chunks of one.
    """
    spark = chunks.sparkSession
    columns = [F.col(column).alias(f"_{name}") for name, column in fields.items()]
    rows = chunks.select(*_BASE, "chunk_id", *columns).sortWithinPartitions(*_BASE, "chunk_id").withColumn("no", F.monotonically_increasing_id())
    each = F.array(*[F.struct(F.lit(name).alias("field"), tokens(F.col(f"_{name}")).alias("t")) for name in fields])
    rows = rows.select(*_BASE, "chunk_id", "no", F.filter(each, lambda x: F.size(x.t) > 0).alias("texts"))
    rows.write.parquet(f"{path}/tokens")
    cut = spark.read.parquet(f"{path}/tokens")
    cut.select(*_BASE, "chunk_id", "no").write.parquet(f"{path}/chunks")
    texts = cut.select(*_BASE, "no", F.explode("texts").alias("x")).select(*_BASE, "no", "x.field", F.size("x.t").alias("dl"), F.col("x.t").alias("t"))
    texts.groupBy(*_BASE, "field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).write.parquet(f"{path}/fields")
    counts = texts.select(*_BASE, "no", "field", "dl", F.explode(counted(F.col("t"))).alias("x")).select(*_BASE, "no", "field", "dl", F.col("x.value").alias("term"), F.col("x.n").alias("tf"))
    range_ = F.floor(F.col("no") / width).cast("long").alias("range")
    one = F.struct(F.col("no"), F.col("tf"), F.col("dl"))
    blocks = counts.groupBy(*_BASE, "field", "term", range_).agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.sort_array(F.collect_list(one)).alias("postings"))
    blocks.repartition(*_BASE, "term").sortWithinPartitions("field", "term", "range").write.partitionBy(*_BASE).parquet(f"{path}/blocks")
    held = spark.read.parquet(f"{path}/blocks").select("field", "term", F.size("postings").alias("n"))
    held.groupBy("field", "term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    return BlockIndex(spark, path)


def _wanted(queries: DataFrame, scope: DataFrame, index: BlockIndex) -> DataFrame:
    """(query_id, kb_id, index_version, field, term, idf, avgdl) of the terms that occur."""
    terms = query_terms(queries)
    # One row per field and query term: a bounded build side.
    stats = index.table("terms").join(terms.select("term").distinct(), "term").join(whole_index(index.table("fields")), "field")
    stats = stats.select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    return scope.select("query_id", *_BASE).distinct().join(terms, "query_id").join(stats, "term")


def _boosted(rows: DataFrame, by: list[str], boosts: dict[str, float]) -> DataFrame:
    """Sums of ``part`` for each field, then the best field after boosts."""
    weight = F.lit(1.0)
    for field, boost in boosts.items():
        weight = F.when(F.col("field") == field, boost).otherwise(weight)
    return rows.groupBy(*by, "field").agg(F.sum("part").alias("part")).groupBy(*by).agg(F.max(weight * F.col("part")).alias("score"))


def range_bounds(wanted: DataFrame, index: BlockIndex, boosts: dict[str, float]) -> DataFrame:
    """(query_id, kb_id, index_version, range, score): what no chunk of the range exceeds."""
    heads = index.table("blocks").select(*_BASE, "field", "term", "range", "tf", "dl").join(wanted, [*_BASE, "field", "term"])
    part = F.col("idf") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return _boosted(heads.select("query_id", *_BASE, "range", "field", part.alias("part")), ["query_id", *_BASE, "range"], boosts)


def _scores(ranges: DataFrame, wanted: DataFrame, index: BlockIndex, boosts: dict[str, float]) -> DataFrame:
    """Exact scores of all chunks in the given ranges."""
    asked = ranges.select("query_id", *_BASE, "range").join(wanted, ["query_id", *_BASE])
    rows = index.table("blocks").select(*_BASE, "field", "term", "range", "postings").join(asked, [*_BASE, "field", "term", "range"])
    rows = rows.select("query_id", *_BASE, "field", "idf", "avgdl", F.explode("postings").alias("p"))
    part = F.col("idf") * impact(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))
    best = _boosted(rows.select("query_id", *_BASE, F.col("p.no").alias("no"), "field", part.alias("part")), ["query_id", *_BASE, "no"], boosts)
    return best.withColumn("score", F.round("score", 9))  # equal terms in another order are a tie


def read_ranges(bounds: DataFrame, wanted: DataFrame, index: BlockIndex, k: int, boosts: dict[str, float], first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(scores of the first ranges, the further ranges that can reach a query's threshold)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *_BASE, "range")
    placed = bounds.withColumn("place", F.row_number().over(order))
    early = stored(_scores(placed.filter(F.col("place") <= first), wanted, index, boosts), "scores")
    threshold = ranked(early, k, F.desc("score")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    rest = placed.filter(F.col("place") > first).join(threshold, "query_id", "left")
    return early, rest.filter(F.col("threshold").isNull() | (F.col("score") + SLACK >= F.col("threshold")))


def block_top_k(queries: DataFrame, scope: DataFrame, index: BlockIndex, k: int, boosts: dict[str, float] | None = None, first: int = FIRST) -> DataFrame:
    """As ``keyword.bm25_top_k``, from the stored index."""
    boosts = boosts or {}
    wanted = stored(_wanted(queries, scope, index), "wanted")
    bounds = stored(range_bounds(wanted, index, boosts), "bounds")
    early, late = read_ranges(bounds, wanted, index, k, boosts, first)
    hits = early.unionByName(_scores(late, wanted, index, boosts))
    # Ties at the k-th place go by chunk_id, so all of them are named first.
    near = hits.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_r") <= k).drop("_r")
    named = near.join(index.table("chunks").select(*_BASE, "no", "chunk_id"), [*_BASE, "no"]).drop("no")
    return ranked(named.select("query_id", *_BASE, "chunk_id", "score"), k, F.desc("score"), F.asc("kb_id"), F.asc("chunk_id"))
