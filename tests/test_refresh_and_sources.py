"""Merges, membership, scans, formats, validation, publication, streaming."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import formats, text, viewstate
from tidewright.operators import earnings, membership, merge, regime, validation
from tidewright.sources import provider, readers, sinks
from tidewright.streaming import refresh

D = dt.date
POINTS = "id string, date date, close double"


def test_last_wins_and_first_wins(spark):
    old = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 2), 2.0), ("a", D(2019, 1, 1), 9.0)], POINTS)
    new = spark.createDataFrame([("a", D(2020, 1, 2), 5.0), ("a", D(2020, 1, 3), 3.0), ("a", D(2020, 1, 4), -1.0)], POINTS)
    last = {r["date"].day: r["close"] for r in merge.last_wins(old, new, D(2020, 1, 1)).collect()}
    assert last == {1: 1.0, 2: 5.0, 3: 3.0}
    first = {r["date"].day: r["close"] for r in merge.first_wins(old, new, D(2020, 1, 1), seq="close").collect()}
    assert first == {1: 1.0, 2: 2.0, 3: 3.0, 4: -1.0}


def test_the_winner_of_a_day_is_the_last_by_seq(spark):
    kind = "id string, date date, close double, seq long"
    old = spark.createDataFrame([("a", D(2020, 1, 1), 9.0, 7), ("a", D(2020, 1, 2), 9.0, 8)], kind)
    new = spark.createDataFrame([("a", D(2020, 1, 1), 5.0, 1), ("a", D(2020, 1, 1), 3.0, 2), ("a", D(2020, 1, 2), -1.0, 3), ("a", D(2020, 1, 3), 6.0, 4), ("a", D(2020, 1, 3), 7.0, None)], kind)
    got = {r["date"].day: r["close"] for r in merge.last_wins(old, new, D(2020, 1, 1), seq="seq").collect()}
    assert got == {1: 3.0, 3: 6.0}
    first = {r["date"].day: r["close"] for r in merge.first_wins(old.drop("seq"), new.where("date > '2020-01-01'"), D(2020, 1, 1), seq="seq").collect()}
    assert first == {1: 9.0, 2: 9.0, 3: 7.0}  # a row without a number comes first


def test_failed_requests_keep_history(spark):
    old = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("b", D(2020, 1, 1), 1.0)], POINTS)
    new = spark.createDataFrame([("a", D(2020, 1, 2), 2.0)], POINTS)
    failed = spark.createDataFrame([("b", "status 500"), ("z", None)], "id string, error string")
    got = {r["id"]: tuple(r)[1:] for r in merge.outcomes(old, new, merge.last_wins(old, new, D(2019, 1, 1)), failed).collect()}
    assert got == {"a": (1, 2, False, None), "b": (0, 1, True, "status 500"), "z": (0, 0, True, "")}


def test_fetch_bounds_tiles_and_outcomes(spark):
    old = spark.createDataFrame([("a", D(2026, 8, 18), 1.0), ("b", D(2026, 8, 1), 1.0)], POINTS)
    got = {r["id"]: r["fetch_from"] for r in merge.fetch_from(old, D(2026, 8, 1)).collect()}
    assert got == {"a": D(2026, 8, 11), "b": D(2026, 8, 1)}
    tiles = merge.tiles(spark, D(2026, 1, 1), D(2026, 1, 20)).collect()
    assert [(t["start"].day, t["end"].day) for t in tiles] == [(1, 14), (15, 20)]
    new = spark.createDataFrame([("a", D(2026, 8, 19), 1.0)], POINTS)
    out = {r["id"]: (r["added"], r["total"], r["stale"]) for r in merge.outcomes(old, new, merge.last_wins(old, new, D(2020, 1, 1))).collect()}
    assert out == {"a": (1, 2, False), "b": (0, 1, True)}
    assert merge.earnings_bounds(D(2026, 8, 1), D(2026, 8, 10))[1] == D(2026, 7, 25)


def test_segment_conflicts_and_share_classes(spark):
    m = spark.createDataFrame([("X", "600", 1), ("X", "500", 2), ("X", "400", 3), ("Y", "400", 4), ("Y", "400", 5)], "ticker string, segment string, seq int")
    keep = {(r["ticker"], r["segment"], r["seq"]) for r in membership.segment_conflicts(m).where("keep").collect()}
    assert keep == {("X", "500", 2), ("Y", "400", 5)}
    c = spark.createDataFrame(
        [("CWEN", "Clearway Energy, Inc. (Class A)", 500, 0, 5.0), ("CWEN-A", "Clearway Energy Inc.", 500, 2, 9.0), ("OLD", "Old Co", 10, 30, 1.0), ("NIL", "Nil Co", 0, None, 1.0)],
        "ticker string, name string, observations int, staleness int, market_cap double",
    )
    got = {r["ticker"]: r["reason"] for r in membership.share_classes(c).collect()}
    assert got["CWEN"] is None and got["CWEN-A"] == "same-company:CWEN"
    assert got["OLD"] == "stale:30" and got["NIL"] == "no-history"


def test_texts(spark):
    row = spark.createDataFrame([(" brk.b ", "The Foo Holdings, Inc. (Class A)", "A &amp;lt; B&#39;s &#8364; x", "consumer cyclical")], "a string, b string, c string, d string")
    got = row.select(text.ticker(F.col("a")), text.company_key(F.col("b")), text.decoded(F.col("c")), text.sector(F.col("d"))).first()
    assert tuple(got) == ("BRK-B", "foo", "A < B's € x", "Consumer Discretionary")
    odd = spark.createDataFrame([("&#128512; &#99999999999999999999; &#55357; &#1114112; &#65;",)], "c string").select(text.decoded(F.col("c"))).first()[0]
    assert odd == "😀 &#99999999999999999999; &#55357; &#1114112; A"


def test_constituents_table(spark):
    html = '<table id="x"><tr><td>NO</td></tr></table><table id="constituents"><tr><th>Symbol</th><th>Name</th><th>Sector</th></tr><tr><td><a href="#">BRK.B</a></td><td>Berk &amp; Co</td><td>Financials</td><td>Ins</td></tr><tr><td>bad1</td><td>x</td><td>y</td></tr></table>'
    df = spark.createDataFrame([("500", html), ("400", "<p>none</p>")], "segment string, html string")
    got = [tuple(r) for r in readers.constituents_table(df).collect()]
    assert got == [("500", "BRK-B", "Berk & Co", "Financials", "Ins")]
    assert [r["segment"] for r in readers.missing_tables(df).collect()] == ["400"]


def test_provider_rows(spark):
    raw = spark.createDataFrame([("a", "2020-01-01", "5", 1), ("a", "2020-01-01", "6", 2), ("a", "20200102", "7", 3), ("a", "2020-01-03", "x", 4)], "id string, date string, close string, seq int")
    assert [(r["date"], r["close"]) for r in readers.adjusted_closes(raw).collect()] == [(D(2020, 1, 1), 6.0)]
    h = spark.createDataFrame([("x", None, "n"), (None, "y.b", "m"), (None, None, "z")], "asset string, symbol string, name string")
    assert sorted(r["ticker"] for r in readers.holdings(h).collect()) == ["X", "Y-B"]


def test_provider_paces_and_retries():
    answers = iter([(429, ""), (500, ""), (200, '[{"symbol": "A", "price": 1}]')])
    slept = []
    p = provider.Provider(lambda path, params: next(answers), slept.append, lambda: 0.0)
    assert p.get("batch-quote") == [{"symbol": "A", "price": 1}]
    assert p.refusals == 1 and p.requests == 3 and any(s >= 2 for s in slept)
    final = provider.Provider(lambda path, params: (402, ""), slept.append, lambda: 0.0)
    assert not final.reachable("x")
    assert provider.api_key(["A", "B"], {"A": " ", "B": " k "}) == "k"


def test_requests_run_on_spark(spark):
    def transport(path, params):
        return (402, "") if params["symbols"].startswith("C") else (200, json.dumps([{"symbol": x} for x in params["symbols"].split(",")]))

    symbols = spark.createDataFrame([(f"S{i}",) for i in range(30)] + [("C",)], "symbol string")
    asked = provider.batched(symbols, 1)
    got = provider.fetched(asked, transport, 3).collect()
    assert len(got) == 31 and sum(r["error"] is not None for r in got) == 1
    assert {json.loads(r["body"])[0]["symbol"] for r in got if r["body"]} == {f"S{i}" for i in range(30)}
    assert all(len(r["params"]["symbols"].split(",")) <= 2 for r in provider.batched(symbols, 2).collect())


def test_http_transport_and_index_pages(spark):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = not self.path.startswith("/no")
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(b'<table id="constituents"><tr><td>AB</td><td>Ab Co</td><td>Energy</td></tr></table>' if ok else b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = provider.http(base, "k")
    assert get("/x", {"a": "b"})[0] == 200 and get("/no", {})[0] == 404
    assert provider.http("http://127.0.0.1:9", timeout=1)("/", {})[0] == 0
    got = readers.index_pages(spark, {"500": "/x"}, get).collect()
    assert [(r["segment"], r["ticker"], r["name"]) for r in got] == [("500", "AB", "Ab Co")]
    with pytest.raises(ValueError, match="500"):
        readers.index_pages(spark, {"500": "/no"}, lambda path, params: json.loads("404 is no answer"))
    with pytest.raises(ValueError, match="no index table"):
        readers.index_pages(spark, {"500": "/x"}, lambda *_: (200, "<p>"))
    server.shutdown()


def test_formats():
    assert formats.percent(0.1234) == "+12.3%" and formats.percent(-0.5) == "−50.0%" and formats.percent(None) == "—"
    assert formats.ratio(1.005) == "1.00" and formats.fixed(0.25, 1) == "0.3"
    assert formats.signed_integer(-2.5) == "−2" and formats.integer(1234567.5) == "1,234,568"
    assert formats.market_cap(3.456e12) == "$3.46T" and formats.market_cap(1.5e11) == "$150B" and formats.market_cap(-1) == "—"
    assert formats.iso_to_display("2026-08-18") == "18 Aug 2026" and formats.price(-1234.5) == "-1,234.50"
    assert formats.meter_position(0.875) == 50 and formats.sign(float("nan")) == 0


def test_rounding_is_towards_positive_infinity(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (None,)], "v double").select(sinks.rounded(F.col("v"), 0).alias("v"))
    assert [r["v"] for r in got.collect()] == [-2.0, 3.0, None]


def test_regime(spark):
    rows = spark.createDataFrame([(0.9, 0.1, 0.9), (0.89, 0.1, 0.06), (0.89, 0.1, 0.05), (0.95, -0.1, 0.0), (None, 0.1, 0.1)], "a double, b double, c double")
    got = [r[0] for r in rows.select(regime.classify(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["normal", "reversal-risk", "caution", "caution", None]


def test_latest_earnings(spark):
    rows = [(k, i, (i, 10.0 + i)) for k in "abc" for i in range(100)]
    days = spark.createDataFrame(rows, "id string, idx int, end struct<idx:int,close:double>")
    events = spark.createDataFrame([("a", D(2020, 3, 1), 2.0, 1.0), ("a", D(2020, 2, 1), 9.0, 1.0), ("b", D(2020, 1, 5), 1.0, 1.0), ("c", D(2021, 1, 1), 1.0, 1.0)], "id string, date date, eps_actual double, eps_estimated double")
    got = earnings.latest(events, days, [D(2020, 1, 1) + dt.timedelta(i) for i in range(100)]).collect()
    assert [r["id"] for r in got] == ["a"]
    assert got[0]["surprise"] == pytest.approx(1 / 70) and got[0]["since_return"] == pytest.approx(109 / 70 - 1)


def test_validation(spark):
    cols = "id string, segment string, benchmark string, last double, low52 double, high52 double, beta double, stale boolean, " + ", ".join(f"{c} double" for c in ("ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1", "ret_6_1", "vol_3m", "vol_1y"))
    ok = (1.0, 1.0, 2.0, 1.0, False, *[0.1] * 8)
    rows = [("A", "500", "SPY", *ok), ("B", "400", "SPY", *ok), ("C", "999", "SPY", *ok), ("A", "500", "SPY", -1.0, 3.0, 2.0, None, True, float("inf"), *[0.1] * 6, -0.1)]
    issues = {(r["subject"], r["issue"]) for r in validation.validate(spark.createDataFrame(rows, cols), minimum=1).collect()}
    assert {("B", "benchmark-mismatch"), ("C", "segment-unknown"), ("A", "id-repeated"), ("A", "close-not-positive"), ("600", "segment-empty"), ("A", "not-finite:ret_1m"), ("A", "invalid:vol_1y"), ("A", "range-inverted")} <= issues
    good = {"as_of": "2026-08-18", "calendar_days": 800, "membership": ["500", "400", "600"], "benchmarks": {"500": "SPY", "400": "IJH", "600": "IJR"}}
    assert validation.manifest_issues(good) == [] and len(validation.manifest_issues({})) == 8


def test_view_state(tmp_path):
    s = viewstate.sanitised({"tab": "x", "screen": {"metric_id": "beta", "segment": "700", "query": "q" * 99}, "cap_per_holding": 2, "watchlist": ["A", "A", 3, ""], "value": float("nan")})
    assert s.tab == "ranked" and s.screen.metric_id == "beta" and s.screen.segment is None and len(s.screen.query) == 40
    assert s.watchlist == ("A",) and s.cap_per_holding is None and s.value == viewstate.DEFAULT_VALUE
    path = tmp_path / "state.json"
    viewstate.save(s, str(path))
    assert viewstate.load(str(path)) == s and json.loads(path.read_text())["tab"] == "ranked"
    path.write_text("{")
    assert viewstate.load(str(path)) == viewstate.ViewState()
    assert viewstate.toggled(viewstate.toggled(s, "B"), "A").watchlist == ("B",)


def test_publish_switches_versions(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    u = spark.createDataFrame([("A", 0.12345678)], "id string, ret double")
    p = spark.createDataFrame([("A", 0, None), ("A", 1, 1.23456), ("A", 2, None)], "id string, idx int, close double")
    m = spark.createDataFrame([("2026-08-18",)], "as_of string")
    first = sinks.publish(u, p, m, root)
    second = sinks.publish(u, p, m, root)
    assert first != second
    manifest, universe = readers.dataset(spark, root)
    assert manifest.first()["as_of"] == "2026-08-18" and universe.first()["ret"] == 0.123457
    got = readers.series(spark, root, ["A", "zz"]).orderBy("idx").collect()
    assert [(r["idx"], r["close"]) for r in got] == [(1, 1.2346), (2, None)]


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [("a", D(2020, 1, 1), dt.datetime(2020, 1, 1), 1.0), ("a", D(2020, 1, 1), dt.datetime(2020, 1, 1), 2.0), ("b", D(2020, 1, 2), dt.datetime(2020, 1, 2), 3.0)]
    df = spark.createDataFrame(rows, "id string, date date, ts timestamp, close double")
    df.coalesce(1).write.parquet(src)
    stream = refresh.first_wins_stream(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
    held = {"df": spark.createDataFrame([("a", D(2020, 1, 1), 9.0)], POINTS)}

    def write(merged):
        held["df"] = spark.createDataFrame(merged.collect(), POINTS)

    points = spark.readStream.schema(df.schema).parquet(src).select("id", "date", "close")
    refresh.last_wins_stream(points, lambda: held["df"], write, D(2019, 1, 1), f"{tmp_path}/cp").awaitTermination(60)
    assert {r["id"]: r["close"] for r in held["df"].collect()} == {"a": 2.0, "b": 3.0}


def test_format_columns_equal_the_scalars(spark):
    values = [None, 0.0, 0.25, -0.25, 0.125, -0.125, 1.005, 2.675, 0.1234, -0.5, 1234567.5, -1234.5, 1e6, 9.9949e8, 1.5e11, 3.456e12, 0.1225, 0.00049, -2.5, 99.95e9, float("nan"), float("inf"), 12.25, 0.35]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    pairs = {
        "percent": formats.percent_column, "percent_plain": formats.percent_plain_column, "spread": formats.spread_column, "ratio": formats.ratio_column, "signed_ratio": formats.signed_ratio_column,
        "integer": formats.integer_column, "signed_integer": formats.signed_integer_column, "cash": formats.cash_column, "price": formats.price_column, "market_cap": formats.market_cap_column,
    }
    rows = df.select("k", *[f(F.col("v")).alias(n) for n, f in pairs.items()]).collect()
    for r in rows:
        for n in pairs:
            assert r[n] == getattr(formats, n)(values[r["k"]]), (n, values[r["k"]])


def test_rows_without_a_company_name_are_companies_of_their_own(spark):
    rows = [("A", None, 5, 0, 1.0), ("B", None, 5, 0, 2.0), ("C", "The Company", 5, 0, 1.0), ("D", "Holdings, Inc.", 5, 0, 1.0), ("E", "Acme Inc.", 5, 0, 1.0), ("F", "Acme Corp", 5, 0, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, name string, observations long, staleness int, market_cap double")
    got = {r["ticker"]: r["reason"] for r in membership.share_classes(df).collect()}
    assert got == {"A": None, "B": None, "C": None, "D": None, "E": "same-company:F", "F": None}
