"""Places where a user's own functions go in (L3, L5, L6), with their results checked.

A function takes DataFrames and gives a DataFrame, so it is a part of the plan like any other:
built-in expressions, a pandas UDF around a model, or a reader of another store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = {"query_id": "string", "kb_id": "string", "chunk_id": "string", "document_id": "string", "pos": "int", "score": "double"}


def checked(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """``df`` with just these columns, of these types; ValueError where one is missing or odd."""
    types = dict(df.dtypes)
    problems = [f"{c} is {types.get(c, 'missing')}, not {kind}" for c, kind in columns.items() if types.get(c) != kind]
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))
    return df.select(*columns)


def process_queries(queries: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """L3: stages over a table of queries, each of which keeps the columns that it was given."""
    for stage in stages:
        before = dict(queries.dtypes)
        queries = queries.transform(stage)
        checked(queries, before, getattr(stage, "__name__", "stage"))
    return queries


def score_quality(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], metrics: list[str]) -> DataFrame:
    """``rows`` of cases with a scorer's metrics (case_id and doubles); cases without a score
    have nulls. A case that is scored more than once fails the query when it runs."""
    scores = checked(scorer(rows), {"case_id": dict(rows.dtypes)["case_id"], **dict.fromkeys(metrics, "double")}, "scorer")
    once = scores.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(m).alias(m) for m in metrics])
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("scored more than once: "), F.col("case_id").cast("string")))).otherwise(F.col("_n")))
    return rows.join(once.filter("_n = 1").drop("_n"), "case_id", "left")


def search_with(queries: DataFrame, scope: DataFrame, k: int, *stores: Callable[[DataFrame, DataFrame, int], DataFrame]) -> list[DataFrame]:
    """The hits of each store for the queries within their scope, ready to be fused; hits
    outside the scope or beyond ``k`` are not let through."""
    own = scope.select("query_id", "kb_id").distinct()
    return [checked(store(queries, scope, k), HITS, "store").filter(F.col("pos") <= k).join(own, ["query_id", "kb_id"], "left_semi").select(*HITS) for store in stores]
