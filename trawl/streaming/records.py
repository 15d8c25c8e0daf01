"""Stage events as one record for each request, kept in keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trawl.streaming.admission import keyed_state

RECORDS = "log_id long, stages array<string>, payloads array<string>, began timestamp, ended timestamp, finished boolean"
#: A request without news for so long is recorded as it is; one that is recorded is remembered
#: for so long, so that late and repeated events make no second record.
IDLE_MS, REMEMBER_MS = 10 * 60 * 1000, 60 * 60 * 1000


#: Stands for an event's missing time.
_NEVER = -(2**62)
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


class Records(StatefulProcessor):
    """Gathers the stages of one request until its last one, or until nothing comes any more.

    A request is one value of the state store, since each call to it costs more than the few
    rows of a request. Its timer stays where the first event put it: when it goes off too early
    it is set again to when the request is really idle.
    """

    def __init__(self, idle_ms: int, remember_ms: int):
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "began long, ended long, timer long, done boolean, stages array<string>, payloads array<string>")

    def _record(self, key, began: int, ended: int, stages: dict, finished: bool) -> Row:
        held = sorted(stages.items(), key=lambda x: (x[0] is not None, x[0] or ""))
        at = lambda us: None if us == _NEVER else _EPOCH + dt.timedelta(microseconds=us)
        return Row(log_id=key[0], stages=[s for s, _ in held], payloads=[p for _, p in held], began=at(began), ended=at(ended), finished=finished)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held.get()
        began, ended, timer, done, names, payloads = before or (None, None, None, False, [], [])
        if done:
            for _ in rows:
                pass
            return
        stages = dict(zip(names, payloads, strict=True))
        for row in sorted(rows, key=lambda r: (r.us, r.last, r.stage is None, r.stage or "")):
            stages[row.stage] = row.payload
            began, ended = (row.us, row.us) if began is None else (min(began, row.us), max(ended, row.us))
            if row.last:
                done = True
                break
        if done:
            yield self._record(key, began, ended, stages, True)
            stages = {}
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = ended // 1000 + self.remember_ms
            self.handle.registerTimer(timer)
        elif timer is None:
            timer = ended // 1000 + self.idle_ms
            self.handle.registerTimer(timer)
        self.held.update((began, ended, timer, done, list(stages), list(stages.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        began, ended, _, done, names, payloads = self.held.get()
        if done:
            self.held.clear()
            return
        idle = ended // 1000 + self.idle_ms
        if idle > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(idle)
            self.held.update((began, ended, idle, False, names, payloads))
            return
        until = max(ended // 1000 + self.remember_ms, idle + 1)
        self.handle.registerTimer(until)
        self.held.update((began, ended, until, True, [], []))
        yield self._record(key, began, ended, dict(zip(names, payloads, strict=True)), False)

    def close(self) -> None:
        pass


def request_stream(events: DataFrame, late: str = "1 minute", idle_ms: int = IDLE_MS, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """Stage events (log_id, stage, payload, ts, last) of a stream as one record a request.

    A stage that comes again keeps its latest payload; ``last`` marks the stage that ends a
    request. What comes after its record is left out.
    """
    rows = events.select("log_id", "stage", "payload", "ts", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce(F.unix_micros("ts"), F.lit(_NEVER)).alias("us"))
    return rows.withWatermark("ts", late).groupBy("log_id").transformWithState(Records(idle_ms, remember_ms), RECORDS, "append", "eventTime")


def run_records(events: DataFrame, path: str, checkpoint: str, **options):
    """Records all requests that the stream ends now, appended to ``path``."""
    with keyed_state(events.sparkSession):
        return request_stream(events, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
