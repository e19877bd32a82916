"""The stateful stream against the batch result: replays, late rows, and days that leave the state."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from tidewright.streaming import rolling

SCHEMA = "id string, date date, close double, seq long, ts timestamp"


def batch_result(rows):
    won = {}
    for i, d, c, s, _ in rows:
        if s > won.get((i, d), (-1, 0.0))[0]:
            won[i, d] = (s, c)
    out = {}
    for i in {r[0] for r in rows}:
        own = sorted((d, c) for (k, d), (_, c) in won.items() if k == i)
        t = [(d - rolling.ORIGIN).days for d, _ in own]
        slope = float(np.polyfit(np.array(t) - t[0], [c for _, c in own], 1)[0]) if len(own) > 1 else None
        out[i] = (len(own), own[-1][0], own[-1][1], max(c for _, c in own[-6:]), slope)
    return out


def test_trend_takes_closes_out_again():
    rnd = random.Random(1)
    points = [(float(i), rnd.random()) for i in range(50)]
    t = rolling.Trend()
    for p in points:
        t.add(*p)
    for p in points[10:40]:
        t.remove(*p)
    rest = points[:10] + points[40:]
    assert t.n == 20 and t.slope() == pytest.approx(np.polyfit([a for a, _ in rest], [b for _, b in rest], 1)[0])
    for p in rest:
        t.remove(*p)
    assert (t.n, t.slope()) == (0, None)


def test_stream_equals_batch_after_replay_and_late_rows(spark, tmp_path):
    rnd, first = random.Random(2), dt.date(2024, 1, 1)
    rows = []
    for seq in range(400):
        day = seq // 4 + rnd.choice([0, 0, 0, -3, -9])  # some rows come late
        date = first + dt.timedelta(max(0, day))
        rows.append((rnd.choice("abc"), date, round(rnd.random(), 3), seq, dt.datetime.combine(date, dt.time(12))))
    src = f"file://{tmp_path}/in"
    parts = [rows[:150], rows[100:300], rows[300:], rows[390:]]  # the second and the last replay rows
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = rolling.rolling_stream(spark.readStream.schema(SCHEMA).parquet(src), 20, "12 days")
        rolling.run_to_end(spark, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")  # goes on from its checkpoint
    got = {r["id"]: tuple(r)[1:] for r in rolling.latest(spark.read.parquet(f"file://{tmp_path}/out").drop("run")).collect()}
    want = batch_result(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][4] == pytest.approx(want[k][4], rel=1e-6, abs=1e-9)
    state = spark.read.format("statestore").option("stateVarName", "days").option("operatorId", 0).load(f"file://{tmp_path}/cp")
    assert state.count() < len({(r[0], r[1]) for r in rows}) / 2  # old days are gone
