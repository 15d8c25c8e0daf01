"""Admission limits in batch form (J3, J4): rate per time unit and successes per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ORDER = ["ts", "event_id"]


def rate_limit(requests: DataFrame, most: int, unit: str = "second") -> DataFrame:
    """A request's place among its tenant's in the same unit of time; refused calls count."""
    own = Window.partitionBy("tenant_id", F.date_trunc(unit, "ts")).orderBy(*_ORDER)
    return requests.withColumn("place", F.row_number().over(own)).withColumn("refused", F.col("place") > most)


def daily_quota(requests: DataFrame, most: int) -> DataFrame:
    """Successes of the tenant earlier on the same UTC day."""
    day = Window.partitionBy("tenant_id", F.date_trunc("day", "ts")).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("success").cast("int")).over(day), F.lit(0))
    return requests.withColumn("used", used).withColumn("refused", F.col("used") >= most)


def admit(requests: DataFrame, rate: int, daily: int, unit: str = "second") -> DataFrame:
    """J3 and J4 together: the day's quota is asked first, and what it refuses is not counted
    for the rate. Once the quota is met it stays met for the day, so until then places are plain
    row numbers and two windows give the same decisions as a loop over the requests."""
    placed = rate_limit(requests, rate, unit).withColumn("ok", F.col("success") & ~F.col("refused"))
    day = Window.partitionBy("tenant_id", F.date_trunc("day", "ts")).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("ok").cast("int")).over(day), F.lit(0))
    return placed.withColumn("decision", F.when(used >= daily, "quota").when(F.col("refused"), "rate").otherwise("accepted"))
