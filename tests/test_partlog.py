"""The table of parts: what a change rewrites, how parts split, and writers at the same time."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewright.operators import merge
from tidewright.sources import partlog, stores

DAY = dt.date(2020, 1, 1)


def points(spark, ids, days, close=1.0):
    return spark.createDataFrame([(f"s{i}", DAY + dt.timedelta(d), close + d) for i in ids for d in days], "id string, date date, close double")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_rewrites_only_the_parts_of_its_ids(spark, tmp_path):
    store = stores.PriceStore(spark, f"file://{tmp_path}/c", target_rows=20)
    store.write(points(spark, range(60), range(5)))
    before = store.table().state()
    assert len(before.parts) > 8 and max(f.rows for f in before.files()) < 60
    store.merge(points(spark, [7, 8], [4, 5], 100.0), DAY)
    after = store.table().state()
    assert 1 <= len(store.table().deltas(before.version)[0]["gone"]) <= 2 and after.version == before.version + 1
    assert len({f.path for f in before.files()} & {f.path for f in after.files()}) >= len(before.files()) - 4
    want = merge.last_wins(points(spark, range(60), range(5)), points(spark, [7, 8], [4, 5], 100.0), DAY)
    assert rows(store.points()) == rows(want)
    store.forget(spark.createDataFrame([("s7",), ("nobody",)], "id string"))
    assert rows(store.points()) == [r for r in rows(want) if r[0] != "s7"]
    assert len(store.table().deltas(after.version)[0]["gone"]) <= 2


def test_reads_open_only_what_may_hold_the_rows(spark, tmp_path):
    store = stores.PriceStore(spark, f"file://{tmp_path}/c", target_rows=20)
    store.write(points(spark, range(60), range(5)))
    found = store.read(["s7", "nobody"])
    assert {r["id"] for r in found.collect()} == {"s7"} and len(found.inputFiles()) <= 2
    assert store.read([]).count() == 0 and store.read(since=DAY + dt.timedelta(4)).count() == 60
    assert not store.table().chosen(since=DAY + dt.timedelta(5))


def test_parts_follow_the_size(spark, tmp_path):
    table = partlog.PartTable(spark, f"file://{tmp_path}/t", "id string, date date, close double", target_rows=30)
    keep = lambda old, new: old.unionByName(new)
    counts = []
    for k in range(4):
        table.replace(points(spark, range(100 * k, 100 * k + 100), [0]), keep)
        counts.append(len(table.state().parts))
    assert counts == sorted(counts) and counts[-1] >= 12
    bits, slots = table.state().slots()
    assert sorted(slots) == list(range(1 << bits))
    # One key with most rows: its part takes several files, dealt over several tasks.
    table.replace(points(spark, [1], range(1000)), keep)
    assert max(len(files) for files in table.state().parts.values()) > 3 and table.read().count() == 1400


def test_checkpoints_and_vacuum(spark, tmp_path):
    table = partlog.PartTable(spark, f"file://{tmp_path}/t", "id string, date date, close double", checkpoint=2)
    assert not table.exists() and table.read().count() == 0
    table.replace(points(spark, [], []), lambda old, new: new)
    assert not table.exists()
    for k in range(5):
        table.replace(points(spark, [k % 2], [k]), lambda old, new: merge.last_wins(old, new, DAY))
    assert any(n.endswith(".state") for n in table._names()) and table.state().version == 5
    want = rows(table.read())
    assert len(want) == 5 and table.vacuum() > 0 and rows(table.read()) == want


def test_writers_of_other_parts_both_succeed_and_of_equal_parts_one_starts_anew(spark, tmp_path):
    schema = "id string, date date, close double"
    a = partlog.PartTable(spark, f"file://{tmp_path}/t", schema, target_rows=10)
    a.replace(points(spark, range(40), range(2)), lambda old, new: new)
    runs = []

    def late(ids, meanwhile):
        """Merge, while another writer commits in between the first time."""

        def merged(old, new):
            runs.append(ids)
            if meanwhile:
                other = meanwhile.pop()
                partlog.PartTable(spark, a.root, schema, target_rows=10).replace(other, lambda o, n: merge.last_wins(o, n, DAY))
            return merge.last_wins(old, new, DAY)

        return merged

    bits, slots = a.state().slots()
    part = {r["id"]: slots[r["s"]] for r in a.read().select("id", partlog.leading(__import__("pyspark.sql.functions").sql.functions.col("id"), bits).alias("s")).distinct().collect()}
    x = "s0"
    apart = next(i for i in part if part[i] != part[x])
    a.replace(points(spark, [0], [0], 50.0), late("apart", [points(spark, [int(apart[1:])], [0], 60.0)]))
    assert runs == ["apart"]
    a.replace(points(spark, [0], [1], 70.0), late("same", [points(spark, [0], [0], 80.0)]))
    assert runs == ["apart", "same", "same"]
    got = {(r["id"], r["date"]): r["close"] for r in a.read().collect()}
    assert got[x, DAY] == 80.0 and got[x, DAY + dt.timedelta(1)] == 71.0 and got[apart, DAY] == 60.0 and len(got) == 80


def test_a_version_goes_to_one_writer(spark, tmp_path):
    path = f"file://{tmp_path}/log/x"
    assert [partlog.place_new(spark, path, t) for t in ("a", "b")] == [True, False]
    assert stores.read_text(spark, path) == "a"


def test_a_failing_write_is_not_taken_for_a_failing_provider(spark, tmp_path, monkeypatch):
    held = stores.EarningsStore(spark, f"file://{tmp_path}/events")
    give = lambda a, b: spark.createDataFrame([], held.schema + ", seq long")
    monkeypatch.setattr(stores, "write_parts", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError, match="disk full"):
        held.refresh(dt.date(2020, 3, 1), give)
