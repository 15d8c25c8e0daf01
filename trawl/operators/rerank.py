"""Rerank of a query's candidates by a score function or a score table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import strip
from trawl.operators.keyword import tokens

MOST = 50
CUT = 1024


def rerank_text() -> Column:
    """the retrieval text, or title and content, cut to 1024 characters."""
    whole = F.concat_ws("\n", F.col("title"), F.col("content"))
    return F.substring(F.when(strip(F.coalesce("retrieval_text", F.lit(""))) != "", F.col("retrieval_text")).otherwise(whole), 1, CUT)


def term_coverage(query: Column, document: Column) -> Column:
    """The default score: the share of the query's distinct terms that the document holds."""
    terms = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(terms, tokens(document))), F.size(terms)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], top_n: int) -> DataFrame:
    """F1: scores at most 50 candidates of a query by ``score(query_text, document)``.

    ``score`` gives a Column: a built-in expression or a pandas UDF around a model.
    """
    rows = candidates.filter(F.col("rank") <= MOST).withColumn("rerank_score", score(F.col("query_text"), rerank_text()))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= top_n)


def validate_scores(scores: DataFrame) -> DataFrame:
    """per query, whether any score (item, value) is missing, repeated, odd or out of range."""
    bad = F.col("value").isNull() | F.isnan("value") | ~F.col("value").between(0, 1)
    return scores.groupBy("query_id").agg(((F.count_if(bad) > 0) | (F.countDistinct("item") != F.count(F.lit(1)))).alias("failed"), F.count(F.lit(1)).alias("n"))


def with_fallback(scored: DataFrame, checks: DataFrame) -> DataFrame:
    """rerank order where a query's scores are valid, its own order with null scores else."""
    rows = scored.join(checks.select("query_id", "failed"), "query_id", "left")
    rows = rows.withColumn("rerank_score", F.when(~F.coalesce("failed", F.lit(True)), F.col("value")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return rows.withColumn("final_rank", F.row_number().over(order))


def noop(candidates: DataFrame, top_n: int) -> DataFrame:
    """the first ``top_n`` with a null score."""
    return candidates.filter(F.col("rank") <= top_n).withColumn("rerank_score", F.lit(None).cast("double"))


def score_table(candidates: DataFrame, scores: DataFrame, most: int = 20) -> DataFrame:
    """scores from a table (query_id, chunk_id, pos, value as text); the first score of a
    chunk counts, missing and unreadable ones are 0, others are clipped to [0, 1]."""
    first = scores.groupBy("query_id", "chunk_id").agg(F.min_by("value", "pos").alias("value"))
    value = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    rows = candidates.filter(F.col("rank") <= most).join(first, ["query_id", "chunk_id"], "left")
    rows = rows.withColumn("rerank_score", F.when(F.isnan(value), 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "chunk_id")
    return rows.withColumn("final_rank", F.row_number().over(order))
