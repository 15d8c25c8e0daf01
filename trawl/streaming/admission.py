"""Admission of requests as a keyed stream with state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 24 * 3600 * 1000
#: How long a day's counter and a rate counter are kept after their first request.
KEEP_DAY_MS, KEEP_UNITS = 25 * 3600 * 1000, 2
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DECISIONS = "event_id long, tenant_id long, ts timestamp, decision string, used long, place long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state needs; the
    session's own setting holds again afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Admission(StatefulProcessor):
    """J3-J5 for one tenant: the day's quota is asked first; what it refuses is not counted for
    the rate. Accepted requests that succeed count for the day.

    A counter lives for a time after its first request, so an idle tenant keeps no state and a
    late request still meets the counters of its own day and time unit. A tenant has one timer,
    of the counter that ends first; it removes all that have ended by then. Counters are read
    in one go, since each call to the state store costs more than many rows.
    """

    def __init__(self, unit_ms: int):
        self.unit_ms = unit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "start long", "n long, until long")
        self.units = handle.getMapState("units", "start long", "n long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A tenant's requests of one micro-batch, which the source's rate bounds.
        batch = sorted(rows, key=lambda r: (r.us, r.event_id is None, r.event_id or 0))
        held = [{k[0]: tuple(v) for k, v in state.iterator()} for state in (self.days, self.units)]
        days, units = (dict(counters) for counters in held)
        for row in batch:
            ms = row.us // 1000
            day, unit = row.local - row.local % DAY_MS, row.local - row.local % self.unit_ms
            used, until = days.setdefault(day, (0, ms + KEEP_DAY_MS))
            place = None
            if used >= row.daily:
                decision = "quota"
            else:
                n, end = units.get(unit, (0, ms + KEEP_UNITS * self.unit_ms))
                place = n + 1
                units[unit] = (place, end)
                decision = "rate" if place > row.rate else "accepted"
                if decision == "accepted" and row.success:
                    days[day] = (used + 1, until)
            yield Row(event_id=row.event_id, tenant_id=key[0], ts=row.ts, decision=decision, used=used, place=place)
        for state, before, counters in ((self.days, held[0], days), (self.units, held[1], units)):
            for start, counter in counters.items():
                if counter[0] and counter != before.get(start):
                    state.updateValue((start,), counter)
        first = lambda counters: min((until for part in counters for n, until in part.values() if n), default=None)
        wanted = first((days, units))
        if wanted is not None and wanted != first(held):
            self.handle.registerTimer(wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, left = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        for state in (self.days, self.units):
            held = [(k, v) for k, v in state.iterator()]
            kept = [(k, v) for k, v in held if v[1] > at]
            left += [v[1] for _, v in kept]
            if len(kept) < len(held):
                if 2 * len(kept) < len(held):
                    state.clear()
                    for k, v in kept:
                        state.updateValue(k, v)
                else:
                    for k, v in held:
                        if v[1] <= at:
                            state.removeKey(k)
        if left:
            self.handle.registerTimer(min(left))
        yield from ()

    def close(self) -> None:
        pass


def admission(requests: DataFrame, plans: DataFrame | None = None, rate: int = 3, daily: int = 1000, unit_seconds: int = 1, late: str = "1 minute") -> DataFrame:
    """A decision for each request (event_id, ts, tenant_id, success) of a stream.

    Requests of one micro-batch are decided in order of (ts, event_id), micro-batches as they
    come. ``plans`` (tenant_id, rate, daily) give tenants limits of their own; others have the
    defaults. Requests later than ``late`` behind the newest one are dropped by the watermark.
    """
    rows = requests.select("event_id", "ts", "tenant_id", F.coalesce("success", F.lit(False)).alias("success"))
    if plans is None:
        rows = rows.withColumns({"rate": F.lit(rate), "daily": F.lit(daily)})
    else:
        rows = rows.join(plans.select("tenant_id", F.col("rate").alias("_rate"), F.col("daily").alias("_daily")), "tenant_id", "left")
        rows = rows.withColumns({"rate": F.coalesce("_rate", F.lit(rate)), "daily": F.coalesce("_daily", F.lit(daily))}).drop("_rate", "_daily")
    # Times as numbers: of the order, and of days and units in the session's time zone.
    none = F.lit(-(2**62))
    rows = rows.withColumns({"us": F.coalesce(F.unix_micros("ts"), none), "local": F.coalesce(F.unix_millis(F.from_utc_timestamp("ts", F.current_timezone())), none)})
    return rows.withWatermark("ts", late).groupBy("tenant_id").transformWithState(Admission(1000 * unit_seconds), DECISIONS, "append", "eventTime")


def run_admission(requests: DataFrame, path: str, checkpoint: str, **options):
    """Decides all that the stream has now, and appends the decisions to ``path``. A later run
    with the same checkpoint goes on where this one ended."""
    with keyed_state(requests.sparkSession):
        job = admission(requests, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return job
