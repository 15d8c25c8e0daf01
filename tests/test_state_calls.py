"""How often keyed state calls the store: it grows with counters, not with rows times counters."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from trawl.streaming.admission import Admission
from trawl.streaming.records import Records


class Store(dict):
    """A map or value of the state store that counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def iterator(self):
        return self._call(iter(list(self.items())))

    def containsKey(self, key):  # noqa: N802
        return self._call(key in self)

    def getValue(self, key):  # noqa: N802
        return self._call(dict.get(self, key))

    def updateValue(self, key, value):  # noqa: N802
        self[key] = self._call(value)

    def removeKey(self, key):  # noqa: N802
        self._call(self.pop(key))

    def clear(self):
        self._call(super().clear())

    def exists(self):
        return self._call(() in self)

    def get(self):
        return self._call(dict.get(self, ()))

    def update(self, value):
        self[()] = self._call(value)


class Handle:
    def __init__(self):
        self.stores, self.timers, self.calls = [], set(), 0

    def getMapState(self, *_):  # noqa: N802
        self.stores.append(Store())
        return self.stores[-1]

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    def total(self):
        return self.calls + sum(s.calls for s in self.stores)

    def run_timers(self, processor, key, watermark):
        fired = 0
        while due := sorted(t for t in self.timers if t <= watermark):
            self.timers.discard(due[0])
            list(processor.handleExpiredTimer(key, TimerValues(0, watermark), ExpiredTimerInfo(due[0])))
            fired += 1
        return fired


def test_a_tenant_has_one_timer():
    handle, processor, hour = Handle(), Admission(3_600_000), 3_600_000
    processor.init(handle)
    row = lambda i: Row(event_id=i, ts=dt.datetime(2024, 1, 1), success=True, rate=3, daily=50, us=1000 * (i * hour // 2), local=i * hour // 2)
    out = list(processor.handleInputRows((1,), iter([row(i) for i in range(200)]), TimerValues(0, 0)))
    assert len(out) == 200 and {r.decision for r in out} == {"accepted"}
    assert len(handle.timers) == 1 and handle.total() <= 110  # 100 hours, 5 days, 2 reads, a timer
    before = handle.total()
    assert handle.run_timers(processor, (1,), 99 * hour) == 1 and handle.total() - before <= 10
    assert all(v[1] > 99 * hour for s in handle.stores for v in s.values()) and len(handle.timers) == 1
    assert handle.run_timers(processor, (1,), 10**12) == 1 and not handle.timers and not any(handle.stores)


def test_a_request_is_one_value():
    handle, processor = Handle(), Records(1000, 10)
    processor.init(handle)
    row = lambda i, last: Row(log_id=1, stage=f"s{i}", payload="p", last=last, us=1000 * i)
    for i in range(50):
        assert not list(processor.handleInputRows((1,), iter([row(i, False)]), TimerValues(0, 0)))
    assert handle.total() <= 101 and len(handle.timers) == 1
    assert handle.run_timers(processor, (1,), 1040) == 1 and handle.timers == {1049}  # not idle yet
    found = list(processor.handleInputRows((1,), iter([row(50, True)]), TimerValues(0, 0)))
    assert len(found[0].stages) == 51 and handle.timers == {60}
    assert handle.run_timers(processor, (1,), 60) == 1 and not any(handle.stores)
