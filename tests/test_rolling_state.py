"""What the rolling stream asks of its state store, and which days it holds there."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pandas as pd

from tidewright.streaming import rolling

FIRST = dt.date(2024, 1, 1)


class Store:
    """One state and its timers in memory; counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def _count(self):
        self.calls += 1

    def getValueState(self, name, schema):  # noqa: N802
        return SimpleNamespace(exists=lambda: (self._count(), self.value is not None)[1], get=lambda: (self._count(), self.value)[1], update=lambda v: (self._count(), setattr(self, "value", v)))

    def getMapState(self, name, key, value):  # noqa: N802
        held = {}
        return SimpleNamespace(
            containsKey=lambda k: (self._count(), k in held)[1], getValue=lambda k: (self._count(), held[k])[1], updateValue=lambda k, v: (self._count(), held.__setitem__(k, v)),
            iterator=lambda: (self._count(), iter(held.items()))[1],
        )

    def registerTimer(self, ms):  # noqa: N802
        self._count()
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self._count()
        self.timers.remove(ms)


def ms(day: int) -> int:
    return int(dt.datetime.combine(FIRST + dt.timedelta(day), dt.time(), dt.UTC).timestamp() * 1000)


def made(retain: int) -> tuple[rolling.Rolling, Store]:
    r, store = rolling.Rolling(retain), Store()
    r.init(store)
    return r, store


def given(r, rows, watermark=0):
    part = pd.DataFrame(rows, columns=["id", "date", "close", "seq"])
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    return [t for out in r.handleInputRows((0,), iter([part]), times) for t in out.itertuples(index=False)]


def test_a_batch_asks_the_store_a_few_times_however_many_series_and_days():
    r, store = made(60)
    rows = [(i, FIRST + dt.timedelta(d), float(i + d), 100 * i + d) for i in range(200) for d in range(20)]
    out = given(r, rows)
    assert len(out) == 200 and all(u.days == 20 and u.high == u.id + 19 for u in out)
    assert store.calls <= 4  # before, each day of each series asked several times
    again = given(r, rows[:20])  # replayed
    assert [tuple(u) for u in again] == [tuple(out[0])] and store.calls <= 8


def test_days_leave_by_the_timer_or_the_next_rows_and_the_latest_stay():
    r, store = made(10)
    given(r, [("a", FIRST + dt.timedelta(d), float(d), d) for d in range(10)] + [("b", FIRST, 1.0, 0)])
    assert store.timers == {ms(10)}
    store.timers.clear()  # fires at the end of the first day
    assert list(r.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: ms(12)))) == []
    held, due = r._held()
    assert sorted(held["a"][1]) == [FIRST + dt.timedelta(d) for d in range(3, 10)] and sorted(held["b"][1]) == [FIRST]
    assert store.timers == {ms(13)} and due == ms(13)
    (u,) = given(r, [("a", FIRST + dt.timedelta(10), 10.0, 10)], ms(40))
    assert (u.days, u.last_close, u.high) == (11, 10.0, 10.0)
    held, due = r._held()
    assert sorted(held["a"][1]) == [FIRST + dt.timedelta(d) for d in range(5, 11)] and len(held["b"][1]) == 1
    assert store.timers == set() and due is None
