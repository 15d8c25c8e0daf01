"""Streams with state: decisions over restarts, counters that expire, attempts that are counted."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trawl.streaming import admission, limits, records, retries

_REQUESTS = "event_id long, ts timestamp, tenant_id long, success boolean"
_START = dt.datetime(2024, 3, 1, 23, 59, 40, tzinfo=dt.UTC)


def at(seconds):
    return _START + dt.timedelta(seconds=seconds)


def plain(rows, rate, daily):
    """Decisions of a loop over the requests with a counter for each day and second."""
    days, seconds, out = {}, {}, {}
    for event, ts, tenant, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        day, second = (tenant, ts.date()), (tenant, ts.replace(microsecond=0))
        if days.get(day, 0) >= daily:
            out[event] = "quota"
            continue
        seconds[second] = seconds.get(second, 0) + 1
        if seconds[second] > rate:
            out[event] = "rate"
            continue
        out[event] = "accepted"
        days[day] = days.get(day, 0) + bool(ok)
    return out


def feed(spark, folder, rows, **options):
    spark.createDataFrame(rows, _REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(_REQUESTS).parquet(f"{folder}/in")
    admission.run_admission(stream, f"{folder}/out", f"{folder}/cp", **options).awaitTermination()
    return {r.event_id: r.decision for r in spark.read.schema(admission.DECISIONS).parquet(f"{folder}/out").collect()}


def test_decisions_go_on_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((i, at(rng.randrange(40) + rng.random()), rng.choice([1, 1, 2, None]), rng.random() < 0.7) for i in range(120)), key=lambda r: r[1])
    for k in range(3):
        got = feed(spark, tmp_path, rows[40 * k : 40 * k + 40], rate=2, daily=9)
    assert got == plain(rows, 2, 9) and set(got.values()) == {"accepted", "rate", "quota"}
    # The batch form gives the same decisions.
    batch = limits.admit(spark.createDataFrame(rows, _REQUESTS), 2, 9).collect()
    assert {r.event_id: r.decision for r in batch} == got
    assert feed(spark, tmp_path, [], rate=2, daily=9) == got  # nothing is decided twice


def test_tenants_have_limits_of_their_own(spark, tmp_path):
    plans = spark.createDataFrame([(1, 1, 100), (2, 5, 2)], "tenant_id long, rate int, daily int")
    got = feed(spark, tmp_path, [(10 * t + i, at(1), t, True) for t in (1, 2, 3) for i in range(4)], plans=plans, rate=3, daily=50)
    assert [got[10 + i] for i in range(4)] == ["accepted", "rate", "rate", "rate"]
    assert [got[20 + i] for i in range(4)] == ["accepted", "accepted", "quota", "quota"]
    assert [got[30 + i] for i in range(4)] == ["accepted", "accepted", "accepted", "rate"]


def test_counters_expire(spark, tmp_path):
    state = lambda name: {(r.key.tenant_id, r.user_map_key.start) for r in spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", name).load().collect()}
    feed(spark, tmp_path, [(1, at(0), 1, True), (2, at(0), 2, False)])
    assert len(state("units")) == 2 and len(state("days")) == 1  # a failed request counts for no day
    feed(spark, tmp_path, [(3, at(3600), 3, True)])
    feed(spark, tmp_path, [])
    assert {k for k, _ in state("units")} == {3} and {k for k, _ in state("days")} == {1, 3}
    feed(spark, tmp_path, [(4, at(26 * 3600 + 3700), 4, True)])
    feed(spark, tmp_path, [])
    assert {k for k, _ in state("days")} == {4}


def test_session_setting_is_put_back(spark):
    before = spark.conf.get(admission._PROVIDER)
    with pytest.raises(KeyError), admission.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(admission._PROVIDER)
        raise KeyError
    assert spark.conf.get(admission._PROVIDER) == before


class ProxyTransportGone(Exception):
    pass


def _chained():
    try:
        raise ConnectionResetError("reset")
    except ConnectionResetError as cause:
        try:
            raise ValueError("wrapped") from cause
        except ValueError as error:
            return error


def test_passing_failures():
    assert all(map(retries.passing, [TimeoutError(), ConnectionError(), OSError(), ProxyTransportGone(), _chained()]))
    assert not any(map(retries.passing, [ValueError("timeout"), KeyError(), None]))


def _work(row):
    kind, _, text = row["content"].partition("|")
    if kind == "bad":
        raise ValueError("no")
    if kind == "down" or kind.isdigit() and row["attempt"] < int(kind):
        raise TimeoutError
    return text


DOCS = "document_id string, tenant_id string, kb_id string, title string, source_type string, content string, updated_at long"


def documents(spark, rows):
    return spark.createDataFrame([(i, "t", "k", i, "text", c, u) for i, c, u in rows], DOCS)


def test_attempts_are_counted_apart_from_their_batch(spark, tmp_path):
    rows = [("a", "ok|one text", 1), ("b", "1|two text", 1), ("c", "2|three text", 1), ("d", "3|four text", 1), ("e", "down|", 1), ("f", "bad|", 1), ("g", "ok|  ", 1), ("h", None, 1)]
    documents(spark, rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in")
    retries.index_with_retries(stream, str(tmp_path), f"{tmp_path}/cp", _work, wait_seconds=0)
    state = lambda: {r.document_id: (r.attempts, r.status, r.message) for r in retries.attempts(spark.read.parquet(f"{tmp_path}/documents")).collect()}
    assert state() == {
        "a": (1, "INDEXED", None), "b": (2, "INDEXED", None), "c": (3, "INDEXED", None), "d": (3, "FAILED", "TimeoutError"),
        "e": (3, "FAILED", "TimeoutError"), "f": (1, "FAILED", "no"), "g": (1, "FAILED", "no chunks"), "h": (1, "DELETED", None),
    }
    texts = {r.document_id: r.content for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert texts == {"a": "one text", "b": "two text", "c": "three text"}
    # A newer row of a document begins anew, and an older one cannot take its place.
    documents(spark, [("d", "1|new text", 2), ("a", "ok|late", 0)]).write.mode("append").parquet(f"{tmp_path}/in")
    retries.index_with_retries(stream, str(tmp_path), f"{tmp_path}/cp", _work, wait_seconds=0)
    assert state()["d"] == (2, "INDEXED", None) and state()["a"] == (1, "INDEXED", None)
    kept = spark.read.parquet(f"{tmp_path}/documents").filter("status = 'INDEXED'").groupBy("document_id").agg(F.max("version.updated_at").alias("v"))
    assert {r.document_id: r.v for r in kept.collect()}["d"] == 2


_EVENTS = "log_id long, stage string, payload string, ts timestamp, last boolean"


def test_one_record_for_each_request(spark, tmp_path):
    def feed_events(rows):
        spark.createDataFrame(rows, _EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(_EVENTS).parquet(f"{tmp_path}/in")
        records.run_records(stream, f"{tmp_path}/out", f"{tmp_path}/cp", late="10 seconds", idle_ms=60_000, remember_ms=600_000).awaitTermination()
        return sorted((r.log_id, tuple(r.stages), tuple(r.payloads), r.finished) for r in spark.read.schema(records.RECORDS).parquet(f"{tmp_path}/out").collect())

    assert feed_events([(1, "search", "a", at(0), False), (1, "search", "b", at(2), False), (2, "search", "x", at(1), False), (3, "search", "y", at(1), False)]) == []
    # 1 ends, with a repeated event behind it; 2 goes on; 3 says nothing more.
    first = [(1, ("end", "search"), ("ok", "b"), True)]
    assert feed_events([(1, "end", "ok", at(5), True), (1, "search", "late", at(6), False), (2, "rank", "z", at(40), False)]) == first
    third = (3, ("search",), ("y",), False)
    assert feed_events([(1, "search", "again", at(50), False), (4, "search", "w", at(90), False)]) == [*first, third]
    assert feed_events([(5, "search", "v", at(95), False)]) == [*first, third]
    assert feed_events([(2, "end", "ok", at(98), True), (3, "end", "too late", at(98), True)]) == [first[0], (2, ("end", "rank", "search"), ("ok", "z", "x"), True), third]
