"""Golden values, properties and edges of the market operators."""

import datetime as dt
import io
import math
import threading
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import calendar, numbers, text
from tidemark.operators import asof, blocks, breadth, isolation, returns, scorecard, scoring, snapshots, tape, windows
from tidemark.plans import catalog
from tidemark.sources import fixed, readers

DAY = dt.date(2024, 1, 1)


def closes(spark, values, sym="A", start=DAY):
    return spark.createDataFrame([(sym, start + dt.timedelta(k), None if v is None else float(v)) for k, v in enumerate(values)], "sym string, d date, close double")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_goes_up(spark):
    r = one(spark, *[numbers.rounded(F.lit(x), d) for x, d in ((-2.5, 0), (2.5, 0), (1.005, 2), (float("inf"), 1), (float("nan"), 1), (1e300, 2))])
    assert tuple(r) == (-2.0, 3.0, 1.0, None, None, 1e300)


def test_ratios(spark):
    r = one(spark, numbers.ratio(F.lit(1.0), F.lit(0.0)), numbers.ratio(F.lit(-1.0), F.lit(0.0)), numbers.ratio(F.lit(0.0), F.lit(0.0)), numbers.ratio(F.lit(3.0), F.lit(2.0)), numbers.pct_change(F.lit(3.0), F.lit(0.0)))
    assert r[0] == math.inf and r[1] == -math.inf and math.isnan(r[2]) and r[3] == 1.5 and r[4] is None


def test_months_run_over(spark):
    d = lambda y, m, k: F.lit(dt.date(y, m, k))
    r = one(spark, calendar.months_later(d(2026, 3, 31), -1), calendar.months_later(d(2024, 2, 29), -12), calendar.before(d(2024, 5, 9), "QUARTER"), calendar.period(d(2024, 5, 9), "quarter"))
    assert tuple(r) == (dt.date(2026, 3, 3), dt.date(2023, 3, 1), dt.date(2024, 3, 31), "2024-Q2")


def test_new_york(spark):
    r = one(spark, calendar.new_york_day(F.lit("2024-01-02 03:00:00").cast("timestamp")), calendar.new_york_label(F.lit("2024-07-02 20:05:00").cast("timestamp")))
    assert tuple(r) == (dt.date(2024, 1, 1), "Jul 2, 2024, 4:05 PM ET")


def test_texts(spark):
    r = one(spark, numbers.parsed(F.lit("1.23%")), numbers.parsed(F.lit("x")), numbers.whole_number(F.lit("0"), 14, 1), numbers.whole_number(F.lit("-3"), 14, 1), text.symbol(F.lit(" brk-b ")), text.symbol(F.lit("a b")), text.listed(F.lit("NYSE"), F.lit("BRK-B")), text.config_name(F.lit("  ")), numbers.signed_percent(F.lit(1.234)))
    assert tuple(r) == (1.23, None, 14, 1, "BRK-B", None, "NYSE:BRK.B", None, "+1.23%")


def test_hand_kept_series(spark):
    rows = catalog.manual_scores(spark, None).collect()
    by = {i: [r["score"] for r in sorted(rows, key=lambda r: r["d"]) if r["id"] == i] for i in ("margindebt", "fundflows", "forwardpe")}
    assert by == {"margindebt": [75.0, 50.0, 62.5, 25.0, 12.5, 37.5, 87.5, 100.0], "fundflows": [50.0, 100.0], "forwardpe": [100.0, 50.0]}
    last = {i: max((r for r in rows if r["id"] == i), key=lambda r: r["d"]) for i in by}
    assert [(last[i]["ma"], last[i]["ratio"]) for i in by] == [(1329177.667, 1.1301), (-23543.0, 1.5499), (20.2, 0.995)]
    specs = fixed.manual_specs(spark).select("id", "weight", "invert", "window")
    assert {r["id"]: r["percentile"] for r in scoring.components(catalog.manual_long(spark), specs, fixed.WINDOWS).collect()} == {"margindebt": 100.0, "fundflows": 20.0, "forwardpe": 33.0}


def test_weights_add_up():
    assert sum(v[0] for v in fixed.FACTORS.values()) == 100 and len(fixed.FACTORS) == 11
    assert {v[2] for v in fixed.FACTORS.values()} == set(fixed.WINDOWS) and {v[4] for v in fixed.FACTORS.values()} - {None} == set(fixed.SHOWN)


def test_short_history_scores_fifty(spark):
    specs = spark.createDataFrame([("x", 3, False, 50), ("gone", 9, True, 5)], "id string, weight int, invert boolean, window int")
    series = closes(spark, [1, 2, 3]).select(F.lit("x").alias("id"), "d", F.col("close").alias("y"))
    r = scoring.components(series, specs, (50, 5)).collect()
    assert len(r) == 1 and (r[0]["score"], r[0]["ma"], r[0]["percentile"]) == (50.0, None, 100.0)
    assert scoring.composite(scoring.components(series, specs, (50, 5))).first()["score"] == 50.0
    with pytest.raises(Exception, match="no component"):
        scoring.composite(scoring.components(series.where("false"), specs, (50, 5))).collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=6, max_size=30), st.booleans())
def test_scores_against_counting(spark, values, invert):
    n = 4
    specs = spark.createDataFrame([("x", 1, invert, n)], "id string, weight int, invert boolean, window int")
    rows = sorted(scoring.scored(closes(spark, values).select(F.lit("x").alias("id"), "d", F.col("close").alias("y")), specs, (n,)).collect(), key=lambda r: r["d"])
    ratios = []
    for k in range(n - 1, len(values)):
        ma, y = sum(values[k - n + 1 : k + 1]) / n, values[k]
        ratios.append(y / ma if ma else math.inf if y > 0 else -math.inf if y < 0 else math.nan)
    key = lambda x: math.inf if math.isnan(x) else x
    if any(map(math.isnan, ratios)):
        return
    want = [math.floor(sum(key(b) <= key(a) for b in ratios) / len(ratios) * 1000 + 0.5) / 10 for a in ratios]
    assert [r["pct"] for r in rows] == want
    assert all(r["score"] == pytest.approx(100 - r["pct"] if invert else r["pct"]) for r in rows)


def test_average_true_range(spark):
    bars = spark.createDataFrame([(DAY, 1.0, 12.0, 10.0, 11.0), (DAY + dt.timedelta(1), 1.0, 15.0, 14.0, 14.0), (DAY + dt.timedelta(2), 1.0, 14.0, 9.0, 10.0)], "d date, open double, high double, low double, close double")
    assert [r["tr"] for r in windows.true_range_percent(bars, 1).orderBy("d").collect()] == [2.0, 4.0, 5.0]
    assert [round(r["y"], 6) for r in windows.true_range_percent(bars, 2).orderBy("d").collect()] == [round(300 / 14, 6), 45.0]


def test_realized_volatility_starts_after_its_window(spark):
    values = [100 * 1.01 ** (k % 3) for k in range(25)]
    rows = windows.realized_volatility(closes(spark, values), 20, ["sym"]).orderBy("d").collect()
    assert len(rows) == 5 and rows[0]["d"] == DAY + dt.timedelta(20)
    x = [math.log(b / a) for a, b in zip(values[:20], values[1:21])]
    m = sum(x) / 20
    assert rows[0]["vol"] == pytest.approx(math.sqrt(sum((v - m) ** 2 for v in x) / 19 * 252) * 100)


def test_flags(spark):
    flat = breadth.name_flags(closes(spark, [5, 5])).collect()
    assert len(flat) == 1 and not flat[0]["up"] and flat[0]["new_high"] and flat[0]["new_low"] and flat[0]["above_sma"] is None
    assert breadth.name_flags(closes(spark, [5])).count() == 0
    day = breadth.internals(closes(spark, [5, 5]).unionByName(closes(spark, [1, 2, 3], "B"))).orderBy("d").collect()
    assert [(r["advances"], r["declines"], r["ad_line"], r["pct_above_sma"]) for r in day] == [(1, 1, 0, None), (1, 0, 1, None)]


def test_flag_properties(spark):
    flags = catalog.name_flags(spark, "/root/testdata/sf0.001")
    assert flags.where("(at_high and not new_high) or (at_low and not new_low)").isEmpty()
    days = catalog.breadth_internals(spark, "/root/testdata/sf0.001").orderBy("d").collect()
    line = 0
    for r in days:
        line += r["advances"] - r["declines"]
        assert r["ad_line"] == line


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a"), (5, "a"), (5, "b"), (9, "a")], "d int, k string")
    right = spark.createDataFrame([(5, "a", 10.0), (5, "a", 11.0), (7, "a", None), (2, "b", 3.0)], "d int, k string, v double")
    got = {(r["d"], r["k"]): r["x"] for r in asof.asof(left, right, ["k"], "v", "x").collect()}
    assert got == {(1, "a"): None, (5, "a"): 11.0, (5, "b"): 3.0, (9, "a"): 11.0}
    assert asof.asof(left, right, ["k"], "v", "x", how="inner").count() == 3
    assert "NestedLoop" not in asof.asof(left, right, ["k"], "v", "x")._jdf.queryExecution().toString()


def test_returns(spark):
    rows = spark.createDataFrame([("A", dt.date(2023, 12, 29), 50.0), ("A", dt.date(2024, 3, 3), 80.0), ("A", dt.date(2024, 3, 28), 100.0), ("A", dt.date(2024, 3, 31), 110.0), ("B", dt.date(2024, 3, 31), 1.0)], "sym string, d date, close double")
    r = {x["sym"]: x for x in returns.horizon_returns(rows).collect()}
    assert [round(r["A"][k], 4) if r["A"][k] is not None else None for k in ("d1", "w1", "m1", "ytd", "y1")] == [10.0, 37.5, 120.0, 120.0, None]
    assert all(r["B"][k] is None for k in returns.HORIZONS)
    bench = returns.horizon_returns(rows.where("sym = 'A'"))
    assert {x["sym"]: x["rel_d1"] for x in returns.relative(returns.horizon_returns(rows), bench).collect()} == {"A": 0.0, "B": None}
    with pytest.raises(Exception, match="benchmark"):
        returns.relative(bench, bench.where("false")).collect()


def test_distribution(spark):
    changes = spark.createDataFrame([("1D", s, p) for s, p in (("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 10.0), ("e", -1.0), ("f", 0.0))][:4], "range_key string, sym string, pct double")
    r = returns.distribution(changes, nested=True).first()
    assert (r["n"], r["median"], r["mean"], r["up"], r["down"], r["unchanged"]) == (4, 3.0, 4.25, 4, 0, 0)
    assert [c["sym"] for c in r["changes"]] == ["a", "b", "c", "d"]
    quotes = spark.createDataFrame([("a", 1.0, 0.0), ("b", None, 1.0), ("c", float("nan"), 1.0), ("d", 3.0, 2.0)], "sym string, price double, prev_close double")
    assert [tuple(x) for x in returns.quote_changes(quotes).collect()] == [("1D", "d", 50.0)]


def test_scorecard_gaps_and_charts(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 5), 10.0), ("A", dt.date(2024, 1, 9), 20.0), ("A", dt.date(2024, 3, 1), 30.0)], "sym string, d date, close double")
    assert [tuple(r) for r in scorecard.period_returns(rows, "month").collect()] == [("A", "2024-03", 50.0)]
    chart = scorecard.rebased_chart(rows, rows.where("d > '2024-01-06'")).orderBy("d").collect()
    assert {r["y"] for r in chart} == {100.0, 150.0} and len(chart) == 4
    bench = spark.createDataFrame([("X", dt.date(2024, 1, k), 8.0 + k) for k in (5, 8, 9)], "sym string, d date, close double").drop("sym")
    chart = scorecard.rebased_chart(rows, bench).orderBy("ord", "d").collect()
    assert [(r["ord"], r["sym"], r["y"]) for r in chart] == [(0, "benchmark", 100.0), (0, "benchmark", 123.08), (0, "benchmark", 130.77), (1, "A", 100.0), (1, "A", None), (1, "A", 200.0)]
    board = scorecard.leaderboard(spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "sym string, y1 double"), "y1", ["y1"], descending=False)
    assert [r["sym"] for r in board.orderBy("place").collect()] == ["b", "c", "a"]


def test_readers(spark, tmp_path):
    doc = '{"Time Series (Daily)": {"2024-01-02": {"4. close": "10.12345", "5. adjusted close": "9.5", "6. volume": "x"}, "2024-01-01": {"4. close": "bad", "5. adjusted close": "8"}}}'
    docs = spark.createDataFrame([("A", doc), ("B", '{"Note": "later"}')], "sym string, doc string")
    assert [tuple(r) for r in readers.daily_closes(docs, "Time Series (Daily)", "4. close", 4).collect()] == [("A", dt.date(2024, 1, 2), 10.1235)]
    assert sorted((r["d"].day, r["adj_close"], r["volume"], r["dividend"]) for r in readers.full_bars(docs).collect()) == [(1, 8.0, 0, 0.0), (2, 9.5, 0, 0.0)]
    assert [r[0] for r in docs.select(readers.feed_error(F.col("doc"))).collect()] == [None, "later"]
    quote = spark.createDataFrame([("A", '{"Global Quote - X": {"05. price": "3", "08. previous close": "2", "10. change percent": "50.0%"}}'), ("B", "{}")], "sym string, doc string")
    assert [tuple(r) for r in readers.point_quotes(quote).orderBy("sym").collect()] == [("A", 3.0, 2.0, 50.0), ("B", None, None, None)]
    series = spark.createDataFrame([("r", '{"data": [{"date": "2024-02-01", "value": "5"}, {"date": "2024-01-01", "value": "."}, {"date": "2023-12-01", "value": "4"}]}')], "name string, doc string")
    assert tuple(readers.newest_first(series).first()) == ("r", 5.0, 4.0)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "made by\n\n,Mkt-RF,RF\n20240102, 1.5,0.1\n\n20240103,-2,\n Copyright\n20240104,9,9\n")
    rows = readers.dated_rows(readers.archived_lines(readers.archives(spark, str(tmp_path))), ["mkt_rf", "rf"]).orderBy("d").collect()
    assert [tuple(r)[1:] for r in rows] == [(dt.date(2024, 1, 2), 1.5, 0.1), (dt.date(2024, 1, 3), -2.0, None)]
    bars = readers.index_bars(spark.createDataFrame([("I", '{"data": [{"date": "2024-01-01", "open": "1", "high": "2", "low": "0.5", "close": "1.5"}, {"date": "x"}]}')], "sym string, doc string"))
    assert [tuple(r)[2:] for r in bars.collect()] == [(1.0, 2.0, 0.5, 1.5)]
    screen = readers.screener(spark.createDataFrame([("NYSE:A", ["A", "10", "9", "10", None])], "s string, d array<string>"))
    assert tuple(breadth.at_tolerance(screen).first()) == (1, 1, 0, ["NYSE:A"], [], 100.0, 0.0)
    ratios = spark.createDataFrame([(dt.date(2024, 1, k), v) for k, v in ((1, "1.0"), (2, "NaN?"), (3, "2"))], "d date, put_call_ratio_full_chain string")
    assert [r["y"] for r in readers.put_call(ratios, ratios, 2).collect()] == [2.0]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert readers.stored(spark, path) is None and snapshots.current(spark, path) is None
    row = lambda *x: spark.createDataFrame(list(x), "d string, v int")
    for new in (row(("a", 1), ("b", 2)), row(("b", 3)), row(("b", 3))):
        snapshots.upsert(new, path, ["d"])
    assert sorted(map(tuple, snapshots.current(spark, path).collect())) == [("a", 1), ("b", 3)]
    ranges = str(tmp_path / "r")
    cols = "n int, range_key string"
    snapshots.merge_keys(spark.createDataFrame([(1, "5D"), (2, "1Y")], cols), ranges)
    snapshots.merge_keys(spark.createDataFrame([(9, "1D")], cols), ranges)
    assert sorted(map(tuple, snapshots.merged(spark, ranges, cols).collect())) == [(1, "5D"), (2, "1Y"), (9, "1D")]


def test_a_failed_change_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    row = lambda *x: spark.createDataFrame(list(x), "d string, v int")
    snapshots.replace(row(("a", 1)), path)

    def broken(*_):
        raise OSError("no rename")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "renamed", broken)
        with pytest.raises(OSError, match="no rename"):
            snapshots.upsert(row(("b", 2)), path, ["d"])
    assert [tuple(r) for r in snapshots.current(spark, path).collect()] == [("a", 1)]
    monkeypatch.setattr(snapshots, "GRACE", 0)
    for k in range(4):
        snapshots.upsert(row(("b", k)), path, ["d"])
    assert sorted(map(tuple, snapshots.current(spark, path).collect())) == [("a", 1), ("b", 3)]
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 2  # this version and the last


def _at_once(*jobs):
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Two jobs that own parts of one store, 25 times each, one of which crashes between its write and its manifest once."""
    monkeypatch.setattr(snapshots, "GRACE", 3_000)
    path, cols, crashed = str(tmp_path / "r"), "n int, range_key string", []
    whole = snapshots.renamed

    def renamed(session, source, target):
        if not crashed and threading.current_thread().name.endswith("_1") and target.endswith("009.json"):
            crashed.append(target)
            raise OSError("crashed")
        return whole(session, source, target)

    monkeypatch.setattr(snapshots, "renamed", renamed)

    def job(key):
        for k in range(25):
            rows = spark.createDataFrame([(k, key), (k, f"{key}-{k}")], cols).coalesce(1)
            try:
                snapshots.merge_keys(rows, path)
            except OSError:
                snapshots.merge_keys(rows, path)
            seen = {r["range_key"] for r in snapshots.merged(spark, path, cols).collect()}
            assert {key, *(f"{key}-{j}" for j in range(k + 1))} <= seen

    _at_once(lambda: job("1D"), lambda: job("5D"))
    got = sorted(map(tuple, snapshots.merged(spark, path, cols).collect()))
    assert got == sorted([(24, "1D"), (24, "5D"), *[(k, f"{j}-{k}") for j in ("1D", "5D") for k in range(25)]])
    assert snapshots.newest(spark, path)[0] == 50


def test_a_writer_between_write_and_manifest(spark, tmp_path):
    """Another job runs in whole in that gap: both changes hold, and the first one's files are still there."""
    path, cols = str(tmp_path / "r"), "n int, range_key string"
    of = lambda *x: spark.createDataFrame(list(x), cols).withColumn("part__", F.col("range_key"))
    mine = snapshots.versions(of((1, "1D")), path, "part__")
    for k in range(3):
        snapshots.merge_keys(spark.createDataFrame([(k, "5D")], cols), path)
    snapshots.publish(spark, path, lambda now: now | mine)
    assert sorted(map(tuple, snapshots.merged(spark, path, cols).collect())) == [(1, "1D"), (2, "5D")]
    base = snapshots.newest(spark, path)[1]
    snapshots.merge_keys(spark.createDataFrame([(7, "5D")], cols), path)
    with pytest.raises(snapshots.Conflict):  # computed from what no longer holds
        snapshots.replace(of((8, "5D")), path, by="part__", base=base)
    snapshots.replace(of((9, "1D")), path, by="part__", base=base)
    assert sorted(map(tuple, snapshots.merged(spark, path, cols).collect())) == [(7, "5D"), (9, "1D")]


def test_upserts_at_once(spark, tmp_path):
    path = str(tmp_path / "u")
    put = lambda who: [snapshots.upsert(spark.createDataFrame([(f"{who}{k}", k)], "d string, v int").coalesce(1), path, ["d"]) for k in range(6)]
    _at_once(lambda: put("a"), lambda: put("b"))
    assert sorted(map(tuple, snapshots.current(spark, path).collect())) == sorted((f"{w}{k}", k) for w in "ab" for k in range(6))


def test_a_log_of_calls(spark, tmp_path):
    """Appends from three threads, and compactions among them, sum exactly; 90 days stay."""
    path, day = str(tmp_path / "log"), dt.date(2024, 1, 1)
    rows = lambda who, k: spark.createDataFrame([(day + dt.timedelta(j), who + k) for j in range(k, k + 60, 7)], "d date, calls long").coalesce(1)
    add = lambda who: [snapshots.append(rows(who, k), path) for k in range(8)]
    _at_once(lambda: add(1), lambda: add(100), lambda: add(10_000), lambda: [snapshots.compact(spark, path) for _ in range(4)])
    want = {}
    for who in (1, 100, 10_000):
        for k in range(8):
            for r in rows(who, k).collect():
                want[r["d"]] = want.get(r["d"], 0) + r["calls"]
    assert dict(map(tuple, snapshots.trimmed(snapshots.logged(spark, path)).collect())) == want
    snapshots.append(spark.createDataFrame([(day + dt.timedelta(k), 1) for k in range(200, 300)], "d date, calls long"), path)
    snapshots.compact(spark, path)
    assert snapshots.newest(spark, path)[1].keys() == {snapshots.SUMMED}
    assert sorted(r["d"] for r in snapshots.logged(spark, path).collect()) == [day + dt.timedelta(k) for k in range(210, 300)]
    snapshots.compact(spark, str(tmp_path / "none"))
    assert snapshots.logged(spark, str(tmp_path / "none")).isEmpty()


def test_only_failures_of_sources_are_set_apart(spark, sf, tmp_path):
    whole = lambda: spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    broken = catalog._damaged(spark, sf, "nation")
    rows, warnings = isolation.isolated(spark, {"a": whole, "b": lambda: spark.read.parquet(f"{broken}/nation.parquet").select("n_name"), "c": lambda: spark.read.parquet("/not/there")}, str(tmp_path / "x"))
    assert rows.count() == 25 and warnings == [("b", "FAILED_READ_FILE"), ("c", "PATH_NOT_FOUND")]
    for run in (lambda p: isolation.loaded(p), lambda p: isolation.isolated(spark, p, str(tmp_path / "y"))):
        with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):  # our own mistake
            run({"a": lambda: whole().select("n_nmae")})
    bad = lambda: whole().select(F.raise_error(F.lit("own")).cast("string").alias("n_name"))
    with pytest.raises(Exception, match="own"):
        isolation.isolated(spark, {"a": bad}, str(tmp_path / "z"))


def test_parameters_are_checked_and_reach_the_scan(spark, sf):
    held = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = catalog.bars_by_parameters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", held)
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(o_orderpriority,2-HIGH)" in pushed and "..." not in pushed.split("]")[0] and all(f"{x}(o_orderdate,{d}" in pushed for x, d in (("GreaterThanOrEqual", "1996-03-01"), ("LessThan", "1998-03-01")))
    trades = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1, 2.0)], "sym string, at timestamp_ntz, key long, price double")
    assert readers.bars_between(trades, "A", "2024-01-01", "2024-01-01").count() == 1
    for bad in (("a' OR 1=1", "2024-01-01", "2024-01-02"), ("A", "2024-01-02", "2024-01-01"), ("A", "yesterday", "2024-01-01")):
        with pytest.raises(ValueError):
            readers.bars_between(trades, *bad)


def test_rounding_of_shares(spark):
    assert one(spark, numbers.share(F.lit(23), F.lit(80)), numbers.share(F.lit(1), F.lit(0)), numbers.share(F.lit(1), F.lit(8), 0)) == (28.8, None, 13.0)


def test_momentum_shows_its_mean_and_missing_factors_leave_a_warning(spark, sf):
    rows = {r["id"]: r for r in catalog.factor_rows(spark, sf).collect()}
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1]["ord"])] == list(fixed.FACTORS)
    assert rows["momentum"]["value"] == catalog.momentum_vs_ma90(spark, sf).first()["value"] != rows["momentum"]["calc_value"]
    assert rows["forwardpe"]["period_label"] == "reading" and rows["credit"]["calc_window"] == 50
    with pytest.raises(ValueError, match="no factor"):
        scoring.loaded({"x": lambda: spark.read.parquet("/not/there")})


def test_falls_below_zero_have_no_yearly_rate(spark):
    days = [dt.date(2019, 1, 2), dt.date(2021, 1, 4), dt.date(2024, 1, 2)]
    rows = spark.createDataFrame([("a", d, c) for d, c in zip(days, (5.0, 4.0, -1.0), strict=True)], "sym string, d date, close double")
    assert {r["range_key"] for r in returns.range_changes(rows).collect()} == {"1Y", "MTD", "QTD", "YTD"}


def test_tape(spark):
    item = lambda *rows: spark.createDataFrame(list(rows), "label string, value double")
    out = tape.tape(item(("r", 1.0)).withColumn("is_rate", F.lit(True)), item(("s", 2.0))).orderBy("part").collect()
    assert [(r["label"], r["is_rate"], r["change_percent"]) for r in out] == [("r", True, None), ("s", False, None)]
    counts = spark.createDataFrame([], "d date, calls long")
    assert tuple(tape.usage(counts).first()) == (0, 0, 0.0)
    bad = spark.range(1).select(tape.incomplete(F.lit(1.0), F.lit(0.0)), tape.incomplete(F.lit(None).cast("double"), F.lit(1.0)), tape.incomplete(F.lit(1.0), F.lit(2.0)))
    assert tuple(bad.first()) == (True, True, False)


def test_plans(spark, sf):
    """One exchange for all breadth windows; pruned scans; no Python and no pairwise join anywhere."""
    plan = catalog.name_flags(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 2 and "Python" not in plan
    for name in ("composite_live", "range_distribution", "breadth_internals", "composite_history"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan
    plan = catalog.advance_decline_line(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_shipdate" in plan


def test_listings_in_both_spellings_and_names_asked_again(spark):
    symbols = spark.createDataFrame([("BRK.B",), ("BF-B",), ("A",), ("NONE",), (None,)], "sym string")
    exchanges = spark.createDataFrame([("BRK-B", "NYSE"), ("BF.B", "NYSE"), ("A", "NYSE"), ("A", "CBOE")], "sym string, exchange string")
    asked = readers.listings(symbols, exchanges)
    assert {(r["sym"], r["s"]) for r in asked.collect()} == {("BRK.B", "NYSE:BRK.B"), ("BF-B", "NYSE:BF.B"), ("A", "CBOE:A"), ("NONE", None), (None, None)}
    first = spark.createDataFrame([("NYSE:BRK.B", 1)], "s string, v int")
    more = spark.createDataFrame([("NYSE:BF.B", 2), ("NYSE:BF.B", 2), ("NYSE:BRK.B", 9), ("NYSE:XX", 3)], "s string, v int")
    names = []

    def ask(lacking):
        names.extend(sorted(r["s"] for r in lacking.collect()))
        return more

    rows, lacking = readers.asked_again(asked.select("s"), first, ask)
    assert sorted(map(tuple, rows.collect())) == [("NYSE:BF.B", 2), ("NYSE:BRK.B", 1)]
    assert names == ["CBOE:A", "NYSE:BF.B"] and lacking.count() == 2
    rows, lacking = readers.asked_again(asked.select("s").limit(0), first.limit(0), lambda n: more)
    assert not rows.count() and not lacking.count()


def test_answers_are_counted_by_the_job_that_reads_them(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"x": 1}'), ("b", None), ("c", '{"Note": "slow"}'), ("d", '{"y": 2}')], "sym string, doc string")
    good, seen = readers.observed(docs, "one")
    good.write.parquet(f"{tmp_path}/good")
    assert seen.get == {"total": 4, "fetched": 2, "failed": 2}
    assert sorted(r["sym"] for r in spark.read.parquet(f"{tmp_path}/good").collect()) == ["a", "d"]


def test_ranges_scan_the_facts_once(spark):
    """The facts are read by the job that writes the closes; what is planned on them reads those."""
    for name in ("range_distribution", "range_change_list", "range_summary"):
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert not [f for f in df.inputFiles() if "lineitem" in f], name


def test_blocks_equal_whole_windows(spark):
    w = lambda *frame: Window.partitionBy("k").orderBy("d", "i").rowsBetween(*frame)
    days = [(("A", "A", "A", None, "B")[i % 5], None if i % 50 == 7 else DAY + dt.timedelta(i * i % 17), i, None if i % 4 == 1 else (i * 37) % 101) for i in range(400)]
    rows = spark.createDataFrame(days, "k string, d date, i int, v long")
    for block in (F.col("d"), F.trunc("d", "MM"), F.lit(1)):
        got = blocks.running(rows, ["k"], ["d", "i"], block, {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "l": ("last", "v")})
        all_ = w(Window.unboundedPreceding, 0)
        want = rows.select("*", F.sum("v").over(all_).alias("s"), F.max("v").over(all_).alias("hi"), F.min("v").over(all_).alias("lo"), F.last("v", ignorenulls=True).over(all_).alias("l"))
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        for n, size in ((1, 1), (7, 7), (7, 30), (252, 1000)):
            got = blocks.trailing(rows, ["k"], ["d", "i"], block, n, {"s": ("sum", "v"), "l": ("last", "v")}, size)
            want = rows.select("*", F.sum("v").over(w(-(n - 1), 0)).alias("s"), F.last("v", ignorenulls=True).over(w(-(n - 1), 0)).alias("l"))
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), (n, size)
    assert blocks.running(rows.limit(0), ["k"], ["d"], F.col("d"), {"s": ("sum", "v")}).count() == 0
    for bad in ({"s": ("mean", "v")}, {"v": ("sum", "v")}):
        with pytest.raises(ValueError):
            blocks.running(rows, ["k"], ["d"], F.col("d"), bad)
    with pytest.raises(ValueError):
        blocks.trailing(rows, ["k"], ["d"], F.col("d"), 8, {"s": ("sum", "v")}, 7)


def test_asof_by_blocks(spark):
    left = spark.createDataFrame([(("A", "B", None)[i % 3], None if i == 40 else DAY + dt.timedelta(i * 7 % 90), i) for i in range(120)], "k string, d date, i int")
    right = spark.createDataFrame([("A", DAY + dt.timedelta(3 * i), None if i % 5 == 2 else float(i)) for i in range(4, 20)] + [(None, DAY, 1.0), (None, DAY, 2.0), ("C", DAY, 5.0)], "k string, d date, y double")
    for by in (["k"], []):
        for how in ("left", "inner"):
            want = asof.asof(left, right, by, "y", "y", how=how)
            for block in (F.col("d"), F.trunc("d", "MM")):
                got = blocks.asof(left, right, by, "y", "y", block, how=how)
                assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_window_of_blocks_holds_a_whole_key(spark, sf):
    """The one window without a block in its partitions runs over the blocks' totals."""
    plan = catalog.market_running(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "hashpartitioning(block__" in plan


def test_archives_line_by_line(spark):
    def packed(*inner):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text_ in inner:
                z.writestr(name, text_)
        return data.getvalue()

    long = ",A\n" + "".join(f"2024{1 + i % 12:02}{1 + i % 28:02},{i}\n" for i in range(1000)) + "\nend\n" + "x" * 100_000
    files = [
        ("zip", packed(("dir/", ""), ("a.csv", "free\r\n , no\r\n,A,B\r\n20240102,1,2%\r\n \r\n20240103,x\r\nfoot\r\n20240104,9,9\r\n"), ("b.csv", ",A\n20240105,1\n"))),
        ("plain", b",A,B\n20249999,1,2\n20240102,3,4,5"), ("no files", packed()), ("no header", b"A,B\n20240102,1,2\n"), ("no data", b",A\n"), ("empty", b""), ("none", None), (None, b",A\n20240102,7\n"),
        ("bad bytes", b"\xff\n,A\n20240102,1\n"), ("long", packed(("l.csv", long))),
    ]
    lines = readers.archived_lines(spark.createDataFrame(files, "path string, content binary"), batch=64)
    rows = readers.dated_rows(lines, ["a", "b"]).collect()
    d = dt.date(2024, 1, 2)
    assert {tuple(r) for r in rows if r[0] != "long"} == {("zip", d, 1.0, 2.0), ("zip", dt.date(2024, 1, 3), None, None), ("plain", None, 1.0, 2.0), ("plain", d, 3.0, 4.0), (None, d, 7.0, None), ("bad bytes", d, 1.0, None)}
    assert sorted(r["a"] for r in rows if r[0] == "long") == list(map(float, range(1000)))
    with pytest.raises(PySparkException):
        readers.archived_lines(spark.createDataFrame([("torn", files[0][1][:40])], "path string, content binary")).count()
