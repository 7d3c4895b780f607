"""Every query by name: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import before, months_later, new_york_day, new_york_label, period
from ..functions.numbers import parsed, pct_change, ratio, rounded, share, signed_percent, whole_number
from ..functions.text import config_name, listed, same_class, symbol
from ..operators import asof as A
from ..operators import blocks
from ..operators import breadth as B
from ..operators import isolation
from ..operators import returns as R
from ..operators import scorecard as C
from ..operators import scoring as S
from ..operators import snapshots as K
from ..operators import tape as T
from ..operators import windows as W
from ..sources import bindings as src
from ..sources import fixed, readers
from ..streaming import streams

SECTOR_WINDOW = 50
FEATURED = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _priority(spark, sf, name: str) -> DataFrame:
    return src.sector_closes(spark, sf).where(F.col("sym") == name).select("d", "close")


def _long(df: DataFrame, id_: str, y: str = "y") -> DataFrame:
    return df.select(F.lit(id_).alias("id"), "d", F.col(y).cast("double").alias("y"))


def price_series(spark, sf) -> DataFrame:
    """The market's and the priorities' closes as long series."""
    return _long(src.market_bars(spark, sf), "market", "close").unionByName(src.sector_closes(spark, sf).select(F.col("sym").alias("id"), "d", F.col("close").alias("y")))


def price_specs(spark) -> DataFrame:
    names = ("market", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return spark.createDataFrame([(n, 10 + k, n == "market", SECTOR_WINDOW) for k, n in enumerate(names)], "id string, weight int, invert boolean, window int")


def manual_long(spark) -> DataFrame:
    """Hand-kept series by their ordinal, laid on consecutive days."""
    rows = fixed.manual_series(spark).join(F.broadcast(fixed.manual_specs(spark)), "series")
    return rows.select("id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("ord")).alias("d"), F.col("value").alias("y"))


def market_factors(spark, sf) -> DataFrame:
    """The factors over orders (credit, vix, realizedvol, momentum) as (id, d, y): one scan, one row a day, one sort."""
    days = src.market_days(spark, sf, FEATURED)  # c0, c1, c2: the featured priorities' closes
    w = Window.orderBy("d")
    past, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    rows = days.withColumn("rn", F.row_number().over(w)).withColumn("tr", tr).withColumn("under", F.last("c1", ignorenulls=True).over(past))
    rows = rows.withColumn("atr", F.when(F.col("rn") >= 14, F.avg("tr").over(w.rowsBetween(-13, 0))))
    rows = rows.withColumn("credit", F.when(F.col("under") != 0, F.col("c0") / F.nullif(F.col("under"), F.lit(0.0))))
    rows = rows.withColumn("nth", F.count("credit").over(past)).withColumn("n", F.count("credit").over(whole))
    first = F.greatest(F.lit(1).cast("long"), F.col("n") - 503)  # the 504th from the end, or the first
    rows = rows.withColumn("base", F.max(F.when(F.col("credit").isNotNull() & (F.col("nth") == first), F.col("credit"))).over(whole))
    y = {"credit": F.col("credit") / F.nullif(F.col("base"), F.lit(0.0)) * 100, "vix": F.col("c2"), "realizedvol": ratio("atr", "close") * 100, "momentum": F.col("close")}
    return rows.select("d", F.explode(F.array(*[F.struct(F.lit(k).alias("id"), c.alias("y")) for k, c in y.items()])).alias("k")).select("k.id", "d", "k.y").where("y is not null")


def factor_parts(spark, sf, events: str | None = None) -> dict:
    """Where each group of factors comes from. `events`: another folder for the events, which may lack them."""
    return {
        "breadth": lambda: B.long_series(B.internals(src.symbol_closes(spark, sf))),
        "market": lambda: market_factors(spark, sf),
        "put/call": lambda: _long(src.error_ratio(spark, events or sf), "putcall"),
        "manual": lambda: manual_long(spark),
    }


def factor_series(spark, sf) -> DataFrame:
    """All eleven factors as one long table, so they are scored in one pass."""
    return S.loaded(factor_parts(spark, sf))[0]


def factor_rows(spark, sf) -> DataFrame:
    return S.components(factor_series(spark, sf), fixed.factor_specs(spark), fixed.WINDOWS, fixed.SHOWN)


# windows and scores
def relative_score(spark, sf):
    rows = S.scored(price_series(spark, sf), price_specs(spark), (SECTOR_WINDOW,))
    return rows.select("id", "d", rounded("ma", 3).alias("ma"), rounded("ratio", 6).alias("ratio"), "pct", "score")


def percentile_rank(spark, sf):
    return S.percentile_rank(price_series(spark, sf)).select("id", rounded("value", 2).alias("value"), "percentile")


def trailing_ma(spark, sf):
    return W.trailing_mean(src.sector_closes(spark, sf), 50, ["sym"], "close").select("sym", "d", rounded("ma", 4).alias("ma"))


def ratio_to_ma(spark, sf):
    return W.ratio_to_mean(src.sector_closes(spark, sf), 10, ["sym"], "close").select("sym", "d", rounded("ratio", 6).alias("ratio"))


def momentum_vs_ma90(spark, sf):
    return S.versus_mean(src.market_bars(spark, sf))


def true_range(spark, sf):
    rows = W.true_range_percent(src.market_bars(spark, sf), 1)
    return rows.select("d", rounded("tr", 2).alias("tr"))


def atr_percent(spark, sf):
    return W.true_range_percent(src.market_bars(spark, sf)).select("d", rounded("y", 6).alias("atr_pct"))


def realized_vol(spark, sf):
    return W.realized_volatility(src.market_bars(spark, sf)).select("d", rounded("vol", 4).alias("vol"))


def vol_risk_premium(spark, sf):
    return T.volatility_premium(src.market_bars(spark, sf), _priority(spark, sf, "3-MEDIUM"))


def history_tail(spark, sf):
    return W.tail(src.sector_closes(spark, sf), 504, ["sym"]).select("sym", "d", rounded("close", 2).alias("close"))


def rebase_100(spark, sf):
    rows = src.sector_closes(spark, sf).select("sym", "d", F.col("close").alias("y"))
    return W.rebased_at(rows, 504, ["sym"]).select("sym", "d", rounded("y", 4).alias("y"))


def running_high_low(spark, sf):
    rows = src.sector_closes(spark, sf)
    w = W.trailing(["sym"], 252)
    return rows.select("sym", "d", F.max("close").over(w).alias("hi"), F.min("close").over(w).alias("lo"))


# as-of joins
def asof_left(spark, sf):
    return A.asof(src.benchmark_closes(spark, sf).select("d"), _priority(spark, sf, "1-URGENT"), [], "close", "close").select("d", "close")


def asof_by_key(spark, sf):
    left = src.symbol_closes(spark, sf).select(F.substring("sym", -1, 1).alias("k"), "sym", "d")
    right = src.sector_closes(spark, sf).select(F.substring("sym", 1, 1).alias("k"), "d", "close")
    return A.asof(left, right, ["k"], "close", "close", how="inner").select("sym", "d", "close")


def asof_ratio_rebased(spark, sf):
    return A.rebased_ratio(_priority(spark, sf, "1-URGENT"), _priority(spark, sf, "2-HIGH")).select("d", rounded("y", 4).alias("y"))


def scalar_asof(spark, sf):
    rows = src.sector_closes(spark, sf).withColumn("last", F.max("d").over(Window.partitionBy("sym")))
    return rows.groupBy("sym").agg(A.at_or_before(F.date_sub("last", 100)).alias("base"))


# composite
def manual_scores(spark, sf):
    specs = fixed.manual_specs(spark).select("id", "weight", "invert", "window")
    rows = S.scored(manual_long(spark), specs, fixed.WINDOWS)
    return rows.select("id", "d", rounded("ma", 3).alias("ma"), rounded("ratio", 4).alias("ratio"), "pct", "score")


def factor_components(spark, sf):
    """All components with how their scores came about, in the declared order (ord)."""
    return factor_rows(spark, sf)


def factor_histories(spark, sf):
    """The last 504 readings of each component to three digits, by place."""
    return S.recent(factor_series(spark, sf))


def composite_live(spark, sf):
    return S.composite(factor_rows(spark, sf))


def composite_degraded(spark, sf):
    """With the put/call source gone: its component is absent, the weights of the others hold, and the warning is kept."""
    series, warnings = S.loaded(factor_parts(spark, sf, events=f"{sf}/not-there"))
    out = S.composite(S.components(series, fixed.factor_specs(spark), fixed.WINDOWS, fixed.SHOWN))
    return out.withColumn("warnings", F.lit("; ".join(f"{k}: {why}" for k, why in warnings)))


def composite_history(spark, sf):
    charted = fixed.factor_specs(spark).where("charted")
    parts = factor_parts(spark, sf)
    series = S.loaded({k: parts[k] for k in ("breadth", "market")})[0]
    return S.composite_history(series, charted, fixed.WINDOWS, src.market_bars(spark, sf))


def component_histories(spark, sf):
    return S.histories(price_series(spark, sf))


# the same over keys too long for one task
def _trades(spark, sf) -> DataFrame:
    return src.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _trade_block():
    """A day's orders in ranges of keys, so a block stays small at any scale."""
    return F.struct("d", F.shiftright("o_orderkey", 32))


def market_running(spark, sf):
    """The market's turnover, high and low up to each single order: one key, as long as the table."""
    rows = blocks.running(_trades(spark, sf), [], ["d", "o_orderkey"], _trade_block(), {"turnover": ("sum", "price"), "high": ("max", "price"), "low": ("min", "price")})
    return rows.select("o_orderkey", "d", *[F.col(c).cast("double").alias(c) for c in ("turnover", "high", "low")])


def market_trailing(spark, sf):
    """High, low and turnover of each order and the 251 before it."""
    rows = blocks.trailing(_trades(spark, sf), [], ["d", "o_orderkey"], _trade_block(), 252, {"high": ("max", "price"), "low": ("min", "price"), "turnover": ("sum", "price")})
    return rows.select("o_orderkey", "d", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "turnover")])


def asof_trades(spark, sf):
    """Each line's day meets the latest day on which its order's kind of market (the benchmark) closed: the left side is the facts, without a key."""
    lines = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    return blocks.asof(lines, src.benchmark_closes(spark, sf), [], "close", "close", F.col("d")).select("l_orderkey", "l_linenumber", "d", "close")


# breadth
def name_flags(spark, sf):
    return B.name_flags(src.symbol_closes(spark, sf))


def breadth_internals(spark, sf):
    return B.internals(src.symbol_closes(spark, sf), src.benchmark_closes(spark, sf))


def advance_decline_line(spark, sf):
    return B.internals(src.symbol_closes(spark, sf)).select("d", "ad_line")


def new_high_low(spark, sf):
    return B.daily_counts(B.name_flags(src.symbol_closes(spark, sf))).select("d", (F.col("new_highs") - F.col("new_lows")).alias("net_new_highs"))


def pct_above_sma(spark, sf):
    return B.daily_counts(B.name_flags(src.symbol_closes(spark, sf))).where("pct_above_sma is not null").select("d", "pct_above_sma")


def ath_summary(spark, sf):
    rows = B.at_extremes(B.name_flags(src.symbol_closes(spark, sf)))
    return rows.select("d", "total", "n_high", "pct", F.array_join("names", ",").alias("names"))


def _at_tolerance(spark, sf, *tolerance):
    rows = src.sector_closes(spark, sf)
    quotes = rows.groupBy(F.col("sym").alias("ticker")).agg(F.max_by("close", "d").alias("high"), F.max_by("close", "d").alias("low"), F.max("close").alias("high_all"), F.min("close").alias("low_all"))
    out = B.at_tolerance(quotes, *tolerance)
    return out.select("total", "n_high", "pct_high", F.array_join("highs", ",").alias("highs"), "n_low", "pct_low", F.array_join("lows", ",").alias("lows"))


def ath_tolerance(spark, sf):
    return _at_tolerance(spark, sf, 0.5)


def ath_tolerance_default(spark, sf):
    """At the reference's tolerance of 0.0005."""
    return _at_tolerance(spark, sf)


# returns and distributions
def sector_returns(spark, sf):
    rows = R.horizon_returns(src.sector_closes(spark, sf))
    return rows.select("sym", "d", *[rounded(k, 2).alias(k) for k in R.HORIZONS])


def relative_returns(spark, sf):
    bench = R.horizon_returns(src.benchmark_closes(spark, sf).select(F.lit("all").alias("sym"), "d", "close"))
    return R.relative(R.horizon_returns(src.sector_closes(spark, sf)), bench).select("sym", *[f"rel_{k}" for k in R.HORIZONS])


def country_returns(spark, sf):
    rows = src.region_closes(spark, sf)
    out = R.horizon_returns(rows.where("type = 'region'").select("sym", "d", "close"))
    return out.select("sym", *[rounded(k, 2).alias(k) for k in R.HORIZONS])


def _once(spark, rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once, for plans that read them more than once: the facts behind them are scanned and shuffled a single time."""
    path = _store(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def range_changes(spark, sf):
    return R.range_changes(_once(spark, src.symbol_closes(spark, sf), "closes"))


def range_distribution(spark, sf):
    return R.distribution(range_changes(spark, sf))


def range_distribution_nested(spark, sf):
    return R.distribution(range_changes(spark, sf), nested=True)


def day_distribution(spark, sf):
    return R.distribution(R.quote_changes(src.quotes(spark, sf)))


def _universe(closes: DataFrame) -> DataFrame:
    """(ord, sym): all symbols, by name."""
    return closes.select("sym").distinct().withColumn("ord", F.row_number().over(Window.orderBy("sym")))


def range_summary(spark, sf):
    closes = _once(spark, src.symbol_closes(spark, sf), "closes")
    return R.summarised(R.range_changes(closes), _universe(closes))


def range_change_list(spark, sf):
    closes = _once(spark, src.symbol_closes(spark, sf), "closes")
    return R.change_list(R.range_changes(closes), _universe(closes))


def day_summary(spark, sf):
    quotes = src.quotes(spark, sf)
    return R.summarised(R.quote_changes(quotes), quotes)


def _torn(quotes: DataFrame) -> DataFrame:
    """Quotes of which some lack a number, by the last character of their symbol."""
    k = F.substring("sym", -1, 1)
    prev = F.when(k == "2", F.lit(None)).when(k == "3", F.lit(0.0)).otherwise(F.col("prev_close"))
    return quotes.select("sym", F.when(k == "1", F.lit(None)).otherwise(F.col("price")).alias("price"), prev.cast("double").alias("prev_close"))


def rejected_quotes(spark, sf):
    return R.rejected(_torn(src.quotes(spark, sf)))


# scorecard
def _resample(cadence):
    return lambda spark, sf: C.resampled(src.region_closes(spark, sf).where("type = 'region'"), cadence).select("sym", "period", "d", "close")


def period_returns(spark, sf):
    return C.period_returns(src.region_closes(spark, sf).where("type = 'style'"), "quarter").select("sym", "period", rounded("ret", 4).alias("ret"))


def heat_cells(spark, sf):
    return C.heat_cells(src.region_closes(spark, sf).where("type = 'region'"), "month")


def scorecard_pivot(spark, sf):
    """The newest 8 years, from the newest (p1) on."""
    return C.scorecard_by_place(src.region_closes(spark, sf).where("type = 'region'"), "year")


def scorecard_quarters(spark, sf):
    """The newest 8 quarters of each style, by place."""
    return C.scorecard_by_place(src.region_closes(spark, sf).where("type = 'style'"), "quarter")


def scorecard_months(spark, sf):
    """The newest 12 months of each region, by place."""
    return C.scorecard_by_place(src.region_closes(spark, sf).where("type = 'region'"), "month")


def scorecard_newest_years(spark, sf):
    """The same with the years as names of columns."""
    return C.scorecard(src.region_closes(spark, sf).where("type = 'region'"), "year")


def scorecard_newest(spark, sf):
    return C.scorecard(src.region_closes(spark, sf).where("type = 'style'"), "quarter")


def _board(spark, sf):
    return R.horizon_returns(src.sector_closes(spark, sf)).select("sym", *[rounded(k, 2).alias(k) for k in ("d1", "m1", "y1")])


def leaderboard_nulls_last(spark, sf):
    return C.leaderboard(_board(spark, sf), "y1", ["d1", "m1", "y1"])


def heat_intensity(spark, sf):
    return C.leaderboard(_board(spark, sf), "d1", ["d1", "y1"], descending=False).select("sym", "heat_d1", "heat_y1")


def rebased_chart(spark, sf):
    return C.rebased_chart(src.sector_closes(spark, sf), src.benchmark_closes(spark, sf), days=365)


def rebased_chart_ytd(spark, sf):
    return C.rebased_chart(src.sector_closes(spark, sf), src.benchmark_closes(spark, sf), year_to_date=True)


# joins, unions, tape
def factor_left_join(spark, sf):
    three = src.benchmark_closes(spark, sf).select("d", rounded("close", 2).alias("mkt"))
    return T.merged_factors(three, _priority(spark, sf, "5-LOW").select("d", rounded("close", 2).alias("mom")))


def missing_anti_join(spark, sf):
    wanted = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return T.missing(wanted, src.table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).distinct(), "k")


def proxy_fallback(spark, sf):
    q = T.latest_change(src.symbol_closes(spark, sf), ["sym"]).select("sym", F.col("value").alias("price"), "change_percent")
    last = F.substring("sym", -1, 1)
    labels = q.select("sym", F.concat(F.lit("index "), "sym").alias("label"), F.concat(F.substring("sym", 1, 7), F.lit("1")).alias("proxy_sym"), F.concat(F.lit("proxy "), "sym").alias("proxy_label"))
    return T.with_proxy(labels, q.where(last.isin("1", "2")), q).select("label", "value", "change_percent", "is_rate")


def quote_union(spark, sf):
    stocks = T.latest_change(src.symbol_closes(spark, sf), ["sym"]).select(F.col("sym").alias("label"), rounded("value", 2).alias("value"), "change_percent")
    rate = src.benchmark_closes(spark, sf).agg(F.max_by("close", "d").alias("x")).select(F.lit("rate").alias("label"), rounded("x", 2).alias("value"), F.lit(True).alias("is_rate"))
    return T.tape(rate, stocks)


def usage_report(spark, sf):
    return T.usage(src.event_counts(spark, sf))


def latest_vs_previous(spark, sf):
    return T.latest_change(src.sector_closes(spark, sf), ["sym"]).select("sym", rounded("value", 2).alias("value"), "change_percent")


def coverage_share(spark, sf):
    o = src.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    return o.select("d", share("k", "n").alias("pct"))


# snapshots
def _store(spark, name: str) -> str:
    """A new store in the folder that all executors share; a local session may do without one, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _at_once(*jobs) -> None:
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()


def snapshot_upsert(spark, sf):
    """The last days' rows are revised and written over the old snapshot's."""
    days = src.benchmark_closes(spark, sf)
    new = W.tail(days, 30, []).select("d", (F.col("close") * 2).alias("close"))
    path = _store(spark, "days")
    K.replace(days, path)
    K.upsert(new, path, ["d"])
    return K.current(spark, path).select("d", rounded("close", 2).alias("close"))


def key_merge(spark, sf):
    """One job owns 1D, another the other ranges of one store; both run at once, twice."""
    cols = "n long, median double, mean double, up long, down long, unchanged long, range_key string"
    days = R.distribution(R.quote_changes(src.quotes(spark, sf)))
    ranges = R.distribution(R.range_changes(src.symbol_closes(spark, sf)))
    path = _store(spark, "ranges")
    _at_once(*[lambda df=df: [K.merge_keys(df, path) for _ in range(2)] for df in (ranges, days)])
    return K.merged(spark, path, cols)


def config_upsert_delete(spark, sf):
    names = src.table(spark, sf, "nation")
    old = names.where("n_nationkey < 10").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("params"), F.lit(0).cast("long").alias("saved_at"), F.col("n_nationkey").alias("ord"))
    new = names.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 1, F.concat(F.lit("v"), F.col("n_nationkey"))).alias("params"), F.lit(1).cast("long").alias("saved_at"), F.col("n_nationkey").alias("ord"))
    return K.configs_saved(old, new)


def config_changes(spark, sf):
    """All nations: the configurations of one half are known, all change, every fourth goes."""
    names, k = src.table(spark, sf, "nation"), F.col("n_nationkey")
    old = names.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), k.cast("string").alias("params"), F.lit(0).cast("long").alias("saved_at"), k.alias("ord"))
    new = names.select(config_name(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"), F.when(k % 4 != 1, F.concat(F.lit("v"), k)).alias("params"), F.lit(1).cast("long").alias("saved_at"), k.alias("ord"))
    return K.configs_saved(old, new)


def counter_trim(spark, sf):
    log = src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.lit(1).cast("long").alias("calls"))
    return K.trimmed(log)


def call_log(spark, sf):
    """Calls by day, appended at once by a job for each priority and compacted meanwhile; the newest 90 days."""
    log, path = src.table(spark, sf, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("d"), F.lit(1).cast("long").alias("calls")), _store(spark, "calls")
    names = [r[0] for r in log.select("o_orderpriority").distinct().collect()]  # five
    jobs = [lambda n=n: K.append(log.where(F.col("o_orderpriority").eqNullSafe(n)).groupBy("d").agg(F.sum("calls").alias("calls")), path) for n in names]
    _at_once(*jobs, lambda: K.compact(spark, path, 100_000))
    K.compact(spark, path)
    return K.logged(spark, path)


# projections, parsing, calendar
def bars_projection(spark, sf):
    rows = src.table(spark, sf, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.max("l_extendedprice").alias("high"), F.sum(F.col("l_quantity").cast("long")).alias("volume")).select("d", rounded("high", 1).alias("high"), "volume")


def bars_full(spark, sf):
    """All fields of the bars, from documents made of the priorities' days; days of one order lack volume, most lack a dividend."""
    o = src.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").alias("d"))
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    day = o.agg(F.min_by(p, k).alias("o"), F.max(p).alias("h"), F.min(p).alias("l"), F.max_by(p, k).alias("c"), F.count(F.lit(1)).alias("n"))
    cells = {"1. open": F.col("o"), "2. high": F.col("h"), "3. low": F.col("l"), "4. close": F.col("c"), "5. adjusted close": F.col("c") / 3, "6. volume": F.when(F.col("n") > 1, F.col("n")), "7. dividend amount": F.when(F.dayofmonth("d") == 1, F.lit(0.25))}
    bar = F.create_map(*[x for name, c in cells.items() for x in (F.lit(name), c.cast("string"))])
    docs = day.groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), bar))).alias("m"))
    return readers.full_bars(docs.select("sym", F.to_json(F.struct(F.col("m").alias("Time Series (Daily)"))).alias("doc")))


# feeds: documents made from the tables and read back
def _priority_docs(spark, sf, fields: dict, series: str) -> DataFrame:
    """(sym, doc): a JSON document for each priority with an object for each day, made of the day's columns."""
    bar = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c)])
    docs = src.sector_closes(spark, sf).groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), bar))).alias("m"))
    return docs.select("sym", F.to_json(F.struct(F.col("m").alias(series))).alias("doc"))


def index_bars_read(spark, sf):
    """A data array of bars for the market, read back."""
    bars = src.market_bars(spark, sf)
    row = F.struct(F.col("d").cast("string").alias("date"), *[F.format_string("%.2f", c).alias(c) for c in ("open", "high", "low", "close")])
    docs = bars.agg(F.collect_list(row).alias("data")).select(F.lit("market").alias("sym"), F.to_json(F.struct("data")).alias("doc"))
    return readers.index_bars(docs)


def point_quotes_read(spark, sf):
    """A quote document for each symbol, its change as text with a percent sign, read back."""
    q = src.quotes(spark, sf)
    change = F.format_string("%.4f%%", pct_change("price", "prev_close"))
    doc = F.to_json(F.create_map(F.lit("Global Quote - DATA"), F.create_map(F.lit("05. price"), F.format_string("%.2f", "price"), F.lit("08. previous close"), F.format_string("%.2f", "prev_close"), F.lit("10. change percent"), change)))
    return readers.point_quotes(q.select("sym", doc.alias("doc")))


def put_call_window(spark, sf):
    """The last 18 days' ratios of two kinds of events, some of them no numbers."""
    days = src.error_ratio(spark, sf)
    text = F.when(F.dayofmonth("d") % 7 == 0, F.lit("None")).otherwise(F.format_string("%.6f", "y"))
    return readers.put_call(days.select("d", text.alias("put_call_ratio_full_chain")), days)


def newest_readings(spark, sf):
    """The newest two numbers of a series for each priority; the newest day of each is no number."""
    rows = src.sector_closes(spark, sf)
    top = F.max("d").over(Window.partitionBy("sym"))
    rows = rows.withColumn("v", F.when(F.col("d") == top, F.lit(".")).otherwise(F.format_string("%.2f", "close")))
    docs = rows.groupBy("sym").agg(F.collect_list(F.struct(F.col("d").cast("string").alias("date"), F.col("v").alias("value"))).alias("data"))
    return readers.newest_first(docs.select(F.col("sym").alias("name"), F.to_json(F.struct("data")).alias("doc")))


def ath_snapshot(spark, sf):
    """From the screener's arrays to the day's snapshot, upserted twice by date with the benchmark's close as of it."""
    rows = src.symbol_closes(spark, sf)
    at = rows.groupBy("sym").agg(F.max_by("close", "d").alias("c"), F.max("close").alias("hi"), F.min("close").alias("lo"))
    cells = [F.col("sym"), *[F.format_string("%.2f", c) for c in ("c", "c", "hi", "lo")]]
    out = B.at_tolerance(readers.screener(at.select(F.concat(F.lit("X:"), "sym").alias("s"), F.array(*cells).alias("d"))))
    day = rows.agg(F.max("d").alias("d")).crossJoin(F.broadcast(out))  # one row by construction
    day = A.asof(day, src.benchmark_closes(spark, sf), [], "close", "spx_close")
    day = day.select("d", "total", F.col("n_high").alias("count"), F.col("pct_high").alias("pct"), F.col("n_low").alias("atl_count"), F.col("pct_low").alias("atl_pct"), F.array_join("highs", ",").alias("tickers"), F.array_join("lows", ",").alias("atl_tickers"), "spx_close")
    path = _store(spark, "highs")
    K.upsert(day.withColumn("d", F.date_sub("d", 1)), path, ["d"])
    for _ in range(2):  # a second run on the same day replaces the first
        K.upsert(day, path, ["d"])
    return K.current(spark, path)


def ath_retried(spark, sf):
    """The screener asked by exchange and symbol. Names that its answer lacks are asked for once more, those alone; what neither answer
    has is listed, as are symbols of which no exchange is known. Symbols are written with a dash, the exchanges' with a point."""
    ends = src.symbol_closes(spark, sf).groupBy("sym").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("c"), F.max("close").alias("hi"), F.min("close").alias("lo"))
    ends = _once(spark, ends.withColumn("sym", F.upper(F.replace("sym", F.lit("#"), F.lit("-")))), "ends")
    tens, ones = F.substring("sym", -2, 1), F.substring("sym", -1, 1)
    exchanges = ends.where(tens != "5").select(same_class(F.col("sym")).alias("sym"), F.when(tens.isin("1", "3"), "NASDAQ").otherwise("NYSE").alias("exchange"))
    asked = readers.listings(ends, exchanges)
    answer = asked.where("s is not null").select("s", F.array("sym", *[F.format_string("%.2f", c) for c in ("c", "c", "hi", "lo")]).alias("d"), tens.alias("tens"), ones.alias("ones"))
    first = answer.where("ones != '3'").select("s", "d")
    again = lambda names: answer.where("tens != '4' or ones != '3'").join(names, "s", "left_semi").select("s", "d")
    rows, lacking = readers.asked_again(asked.select("s"), first, again)
    out = B.at_tolerance(readers.screener(rows))
    one = lambda df, c: F.array_join(F.array_sort(F.collect_list(df[c])), ",")  # noqa: E731 - names of a universe
    left = T.missing(lacking, rows, "s")
    unlisted = asked.where("s is null")
    parts = (ends.agg(F.max("d").alias("d")), lacking.agg(F.count(F.lit(1)).alias("retried")), left.agg(one(left, "s").alias("unresolved")), unlisted.agg(one(unlisted, "sym").alias("unlisted")))
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row by construction
    return out.select("d", "total", "n_high", "pct_high", "n_low", "pct_low", F.array_join("highs", ",").alias("highs"), F.array_join("lows", ",").alias("lows"), "retried", "unresolved", "unlisted")


def factors_merged(spark, sf):
    """Zipped texts with free lines around their rows, one for each factor file and year, unpacked, parsed and joined on the first file's days."""
    three = _texts(src.market_bars(spark, sf).select("d", "open", "high", "low", "close"), "three", ",Mkt-RF,SMB,HML,RF")
    other = _texts(_priority(spark, sf, "5-LOW"), "mom", ",Mom")
    lines = readers.archived_lines(_packed(three.unionByName(other), zipped=True), "name")
    a = readers.dated_rows(lines.where("name = 'three'"), ["mkt_rf", "smb", "hml", "rf"], "name").drop("name")
    b = readers.dated_rows(lines.where("name = 'mom'"), ["mom"], "name")
    return T.merged_factors(a, b)


def _texts(rows: DataFrame, name: str, header: str) -> DataFrame:
    """(name, year, line, head): a line for each day, and the header of the text it belongs in."""
    numbers = [F.format_string("%.2f", c) for c in rows.columns if c != "d"]
    return rows.select(F.lit(name).alias("name"), F.year("d").alias("year"), F.concat_ws(",", F.date_format("d", "yyyyMMdd"), *numbers).alias("line"), F.lit(header).alias("head"))


def _packed(texts: DataFrame, zipped: bool) -> DataFrame:
    """(name, content): a file for each name and year, of 366 lines at most, free lines and a header before its lines and free lines after them."""
    import io
    import zipfile

    def pack(year: pd.DataFrame) -> pd.DataFrame:
        text = f"Made from the tables\nno header yet\n\n{year['head'].iloc[0]}\n" + "\n".join(sorted(year["line"])) + "\n\nAnnual: 12\n20200101,9,9\n"
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("inner.csv", text)
        return pd.DataFrame({"name": [year["name"].iloc[0]], "content": [data.getvalue() if zipped else text.encode()]})

    return texts.groupBy("name", "year").applyInPandas(pack, "name string, content binary")


def _passes(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols asked for, and two passes of documents: the first fails for some of them in three ways, the second for one of these."""
    docs = _priority_docs(spark, sf, {"4. close": F.format_string("%.2f", "close")}, "Time Series (Daily)")
    k = F.substring("sym", 1, 1)
    note = F.lit('{"Note": "call frequency"}')
    first = docs.select("sym", F.when(k == "2", note).when(k == "3", F.lit(None)).when(k == "4", F.lit('{"Error Message": "invalid"}')).otherwise(F.col("doc")).alias("doc"))
    second = docs.where(k.isin("2", "3", "4")).select("sym", F.when(k == "4", F.lit('{"Error Message": "invalid"}')).otherwise(F.col("doc")).alias("doc"))
    return docs.select("sym"), first, second


def ingest_health(spark, sf):
    """Counts and messages after the first pass and after the retry."""
    asked, first, second = _passes(spark, sf)
    one = readers.health(asked, first).select(F.lit(1).alias("pass"), "*")
    return one.unionByName(readers.health(asked, readers.retried(first, second)).select(F.lit(2).alias("pass"), "*"))


def ingest_observed(spark, sf):
    """Each pass's answers are counted in the very job that reads them and stores their closes."""
    _, first, second = _passes(spark, sf)
    counted, stored = [], []
    for k, docs in enumerate((first, second), 1):
        docs, seen = readers.observed(docs, f"pass {k}")
        path = _store(spark, "observed")
        readers.daily_closes(docs, "Time Series (Daily)", "4. close", 2).write.parquet(path)
        counted.append((k, *(seen.get[c] for c in ("total", "fetched", "failed"))))
        stored.append(spark.read.parquet(path).agg(F.lit(k).alias("pass"), F.count(F.lit(1)).alias("closes")))
    metrics = spark.createDataFrame(counted, "pass int, total bigint, fetched bigint, failed bigint")
    return metrics.join(stored[0].unionByName(stored[1]), "pass")


def quarantine(spark, sf):
    """The answers of the first pass that carry an error, or nothing, instead of data."""
    return readers.parted(_passes(spark, sf)[1])[1]


def retried_closes(spark, sf):
    """The closes of both passes, what the first one lacks filled from the second."""
    _, first, second = _passes(spark, sf)
    return readers.daily_closes(readers.retried(first, second), "Time Series (Daily)", "4. close", 2)


# payloads
def sector_payload(spark, sf):
    """The benchmark first, then each sector: returns, and for sectors those relative to it."""
    bench = R.horizon_returns(src.benchmark_closes(spark, sf).select(F.lit("all").alias("sym"), "d", "close"))
    rows = R.relative(R.horizon_returns(src.sector_closes(spark, sf)), bench)
    first = bench.select(F.lit(0).alias("ord"), "sym", "d", rounded("close", 2).alias("close"), *[rounded(k, 2).alias(k) for k in R.HORIZONS], *[F.lit(None).cast("double").alias(f"rel_{k}") for k in R.HORIZONS])
    rest = rows.select(F.row_number().over(Window.orderBy("sym")).alias("ord"), "sym", "d", rounded("close", 2).alias("close"), *R.HORIZONS, *[f"rel_{k}" for k in R.HORIZONS])
    return first.unionByName(rest)


def country_histories(spark, sf):
    """The last 2,600 closes of each region and style."""
    rows = src.region_closes(spark, sf)
    return W.tail(rows, 2600, ["type", "sym"]).select("type", "sym", "d", rounded("close", 2).alias("close"))


def ticker_tape(spark, sf):
    """The whole tape in order: indexes with their proxies, a rate, a commodity's newest reading, stocks; items without a value fall out."""
    q = T.latest_change(src.symbol_closes(spark, sf), ["sym"]).select("sym", F.col("value").alias("price"), "change_percent")
    last = F.substring("sym", -1, 1)
    labels = q.where(F.substring("sym", -2, 1) == "1").select("sym", F.concat(F.lit("index "), "sym").alias("label"), F.concat(F.substring("sym", 1, 7), F.lit("1")).alias("proxy_sym"), F.concat(F.lit("proxy "), "sym").alias("proxy_label"))
    indexes = T.with_proxy(labels, q.where(last.isin("1", "2")), q)
    rate = src.benchmark_closes(spark, sf).agg(F.max_by("close", "d").alias("x")).select(F.lit("rate").alias("label"), rounded("x", 2).alias("value"), F.lit(True).alias("is_rate"))
    two = newest_readings(spark, sf).where("name = '1-URGENT'")
    commodity = two.select(F.lit("commodity").alias("label"), rounded("value", 2).alias("value"), rounded(pct_change("value", "previous"), 2).alias("change_percent"))
    stocks = q.select(F.col("sym").alias("label"), rounded("price", 2).alias("value"), "change_percent")
    return T.tape(indexes, rate, commodity, stocks).where("value is not null")


def component_payload(spark, sf):
    """The components as JSON objects, by their place in the declared order."""
    rows = factor_rows(spark, sf)
    calc = F.struct(F.col("calc_window").alias("window"), "period_label", "invert", F.col("calc_value").alias("value"), "ma", "ratio", "ratio_percentile")
    body = F.to_json(F.struct("id", "value", "percentile", "score", "weight", F.when(F.col("calc_window").isNotNull(), calc).alias("calc")), {"ignoreNullFields": "false"})
    return rows.select("ord", "id", body.alias("body"))


def fixed_universes(spark, sf):
    """The benchmark before the sectors, then regions and styles, in their order."""
    bench = spark.createDataFrame([(0, *fixed.BENCHMARK)], "ord int, sym string, name string").withColumn("type", F.lit("benchmark"))
    sectors = fixed.sectors(spark).select((F.col("ord") + 1).alias("ord"), "sym", "name", F.lit("sector").alias("type"))
    return bench.unionByName(sectors).unionByName(fixed.regions(spark))


def partial_feeds(spark, sf):
    """Two feeds read for one page, one of which isn't there: its place is taken by a row with the error."""
    feeds = {"sectors": lambda: src.sector_closes(spark, sf), "countries": lambda: src.region_closes(spark, f"{sf}/not-there")}
    ask = lambda feed: R.horizon_returns(feed()).select("sym", rounded("y1", 2).alias("y1"))
    parts = {name: lambda feed=feed, name=name: ask(feed).select(F.lit(name).alias("feed"), "sym", "y1", F.lit(None).cast("string").alias("error")) for name, feed in feeds.items()}
    rows, warnings = S.loaded(parts)
    return rows.unionByName(spark.createDataFrame([(name, None, None, why) for name, why in warnings], rows.schema))


def _damaged(spark, sf, table: str) -> str:
    """A folder that has a table's rows and beside them a file that broke off while it was written."""
    folder = _store(spark, "damaged")
    src.table(spark, sf, table).write.parquet(f"{folder}/{table}.parquet")
    p, fs = K._at(spark, f"{folder}/{table}.parquet")
    first = min((x for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
    stream = fs.open(first.getPath())
    try:
        head = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(first.getLen() // 2, 4_096))
    finally:
        stream.close()
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "part-99999-broken.parquet"), True)
    out.write(bytearray(head))
    out.close()
    return folder


def composite_damaged(spark, sf):
    """As composite_degraded, with a put/call source that breaks off while it is read."""
    series, warnings = isolation.isolated(spark, factor_parts(spark, sf, events=_damaged(spark, sf, "events")), _store(spark, "factors"))
    out = S.composite(S.components(series, fixed.factor_specs(spark), fixed.WINDOWS, fixed.SHOWN))
    return out.withColumn("warnings", F.lit("; ".join(f"{k}: {why}" for k, why in warnings)))


def partial_reads(spark, sf):
    """Three feeds for one page: one whole, one not there, one that breaks off. The place of each of the latter is taken by its error."""
    feeds = {"sectors": (src.sector_closes, sf), "countries": (src.region_closes, f"{sf}/not-there"), "symbols": (src.sector_closes, _damaged(spark, sf, "orders"))}
    ask = lambda feed, folder: R.horizon_returns(feed(spark, folder)).select("sym", rounded("y1", 2).alias("y1"))
    parts = {name: lambda f=f, name=name: ask(*f).select(F.lit(name).alias("feed"), "sym", "y1", F.lit(None).cast("string").alias("error")) for name, f in feeds.items()}
    rows, warnings = isolation.isolated(spark, parts, _store(spark, "feeds"))
    return rows.unionByName(spark.createDataFrame([(name, None, None, why) for name, why in warnings], rows.schema))


# streams: run over the events until all are read
def _landed(rows: DataFrame, folder: str, batches: list) -> None:
    """Rows as one file for each condition, one after the other, as a stream would get them."""
    for k, where in enumerate(batches):
        rows.where(where).coalesce(1).write.parquet(f"{folder}/file={k}")


def _files(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def stream_final_days(spark, sf):
    """Counts of days that are final, by an event-time window with a watermark of a day, and the late rows beside them. A tenth of the events
    arrives after all others."""
    e, root = src.table(spark, sf, "events"), _store(spark, "final")
    mid = e.agg(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).cast("long")).first()[0] or 0
    early, last = F.unix_micros(F.col("ts").cast("timestamp")) < mid, F.col("event_id") % 10 == 0
    _landed(e.withColumn("ts", F.col("ts").cast("timestamp")), f"{root}/in", [early & ~last, ~early & ~last, last])
    schema = streams.EVENTS.replace("timestamp_ntz", "timestamp")
    streams.late_aside(_files(spark, f"{root}/in", schema), f"{root}/parted", f"{root}/ck1").awaitTermination()
    streams.appended(streams.daily_counts(_files(spark, f"{root}/parted/kept", schema)), f"{root}/days", f"{root}/ck2").awaitTermination()
    days = spark.read.schema("d date, event_type string, n long").parquet(f"{root}/days")
    late = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/parted/late")
    late = late.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.lit("final").alias("kind"), "*").unionByName(late.select(F.lit("late").alias("kind"), "*"))


def stream_last_state(spark, sf):
    """The last event of each user as keyed state, with users forgotten once event time has gone on for an hour without them."""
    root = _store(spark, "state")
    streams.last_with_state(streams.events(spark, f"{sf}/events.parquet", 1000), f"{root}/rows", f"{root}/ck", silent="1 hour").awaitTermination()
    return streams.last_known(spark, f"{root}/rows")


#: Events of a block and of a task, at most about, where they are numbered within their day.
EVENTS_A_BLOCK, EVENTS_A_TASK = 50_000, 500_000


def _day_numbers(e: DataFrame, width: int, tasks: int) -> DataFrame:
    """Adds rn, an event's number within its day by event_id, from 1. A day is cut into blocks of event ids; rows are numbered within them, and
    how many a day has in blocks before comes from a table of counts. A fixed number of tasks, so that none gets them merged."""
    e = e.withColumn("b", F.coalesce(F.floor(F.col("event_id") / width), F.lit(-(2**62))))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("day", "of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = [F.coalesce("d", F.lit("0001-01-01").cast("date")).alias("day"), F.col("d").isNull().alias("of"), F.col("b").alias("block")]
    sizes = e.groupBy(*known).agg(F.count(F.lit(1)).alias("size")).select("day", "of", "block", before.alias("before"))
    own = e.select("*", *known).repartition(tasks, "day", "of", "block")
    own = own.withColumn("own", F.row_number().over(Window.partitionBy("day", "of", "block").orderBy("event_id")))
    return own.join(sizes, ["day", "of", "block"]).withColumn("rn", F.col("own") + F.col("before")).drop("day", "of", "block", "own", "before")


def stream_first_snapshot(spark, sf):
    """Three snapshots of each day, of which the first wins. Each file has one of a day at most; the second and third run come with the
    next half of the days, repeated ones among them and ones that are late by then."""
    e, root = src.table(spark, sf, "events").withColumn("d", F.to_date("ts")), _store(spark, "first")
    low, high, first, last, n = e.agg(F.min("d"), F.max("d"), F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    width = max(1, ((last - first + 1) if n and last is not None else 1) * EVENTS_A_BLOCK // max(n, 1))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // EVENTS_A_TASK))
    numbered = _day_numbers(e.select("event_id", "ts", "d"), width, tasks)
    runs = numbered.withColumn("run", ((F.col("rn") - 1) % 3).cast("int")).groupBy("d", "run").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    early = F.col("d") < F.lit(low + (high - low) / 2 if low else low)
    of = lambda k: F.col("run") == k
    _landed(runs, f"{root}/in", [early & of(0), (early & of(1)) | (~early & of(0)), (early & of(2)) | (~early & of(1)), ~early & of(2)])
    stream = _files(spark, f"{root}/in", runs.schema)
    streams.appended(streams.first_of_day(stream).select("d", "run", "n", "first_id"), f"{root}/days", f"{root}/ck").awaitTermination()
    return spark.read.schema("d date, run int, n long, first_id long").parquet(f"{root}/days")


def _streamed(spark, sf, name: str, build) -> DataFrame:
    root = _store(spark, name)
    query = build(streams.events(spark, f"{sf}/events.parquet", 1000), root)
    query.awaitTermination()
    return root


def stream_day_counts(spark, sf):
    """Events by day and kind in update mode, each batch replacing the days that it has."""

    def build(stream, root):
        counts = stream.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return streams.keep_last(counts, f"{root}/days", ["d", "event_type"], "n", f"{root}/checkpoint", mode="update")  # a count only grows

    return K.current(spark, f"{_streamed(spark, sf, 'stream', build)}/days")


def stream_last_event(spark, sf):
    """The last event of each user, kept as a snapshot."""
    build = lambda stream, root: streams.keep_last(stream.select("user_id", "event_id", "event_type", "value"), f"{root}/last", ["user_id"], "event_id", f"{root}/checkpoint")
    return K.current(spark, f"{_streamed(spark, sf, 'stream', build)}/last")


def stream_daily_snapshot(spark, sf):
    """A snapshot of each day, the same day's last one holding: events of a day in order of their ids."""

    def build(stream, root):
        days = stream.select(F.to_date("ts").alias("d"), "event_id", "value")
        return streams.keep_last(days, f"{root}/days", ["d"], "event_id", f"{root}/checkpoint")

    return K.current(spark, f"{_streamed(spark, sf, 'stream', build)}/days")


# labels and parameters
def labels_and_parameters(spark, sf):
    """The New York day and label of each event's time, read as UTC; its value as a signed percentage; its id's end as a parameter and,
    with a percent sign, as a number."""
    e = src.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    days = F.substring(F.col("event_id").cast("string"), -2, 2)
    return e.select("event_id", new_york_day(ts).alias("day"), new_york_label(ts).alias("label"), signed_percent("value").alias("change"), whole_number(days, 14, 1).alias("days"), parsed(F.concat(days, F.lit("%"))).alias("number"))


def bars_by_parameters(spark, sf):
    """One priority's bars between two days, by bound parameters."""
    trades = src.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sym"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return readers.bars_between(trades, "2-HIGH", "1996-03-01", "1998-02-28")


def symbol_validation(spark, sf):
    s = F.concat(F.lit("  "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise(F.lit("!")))
    rows = src.table(spark, sf, "part").select("p_partkey", symbol(s).alias("sym"))
    return rows.select("p_partkey", "sym", listed(F.lit("NYSE"), F.col("sym")).alias("listed"))


def csv_preamble_parse(spark, sf):
    """Plain texts with lines before the header and after the data, one a year, made from orders' days."""
    texts = _texts(src.market_bars(spark, sf).select("d", "open", "close"), "orders", ",Open,Close")
    return readers.dated_rows(readers.archived_lines(_packed(texts, zipped=False), "name"), ["open", "close"], "name")


def json_closes(spark, sf):
    """Documents keyed by date, made from the sectors' closes and read back."""
    bar = F.create_map(F.lit("4. close"), F.format_string("%.2f", "close"))
    docs = src.sector_closes(spark, sf).groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), bar))).alias("m"))
    docs = docs.select("sym", F.to_json(F.struct(F.col("m").alias("Time Series (Daily)"))).alias("doc"))
    return readers.daily_closes(docs, "Time Series (Daily)", "4. close", 2)


def month_overflow(spark, sf):
    d = src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", *[months_later(F.col("d"), -n).alias(f"m{n}") for n in (1, 3, 6, 12)], before(F.col("d"), "MM").alias("mtd"), before(F.col("d"), "QUARTER").alias("qtd"), before(F.col("d"), "YEAR").alias("ytd"), period(F.col("d"), "quarter").alias("quarter"))


def js_rounding(spark, sf):
    x = (F.col("c_acctbal") * 100).cast("long") / 1000
    return src.table(spark, sf, "customer").select("c_custkey", rounded(x, 1).alias("r1"), rounded(x, 0).alias("r0"), rounded(pct_change("c_acctbal", F.lit(0.0)), 2).alias("none"))


def queries() -> dict:
    fs = (
        relative_score, percentile_rank, trailing_ma, ratio_to_ma, momentum_vs_ma90, true_range, atr_percent, realized_vol, vol_risk_premium, history_tail, rebase_100, running_high_low,
        asof_left, asof_by_key, asof_ratio_rebased, scalar_asof, manual_scores, factor_components, factor_histories, composite_live, composite_degraded, composite_history, component_histories, component_payload,
        name_flags, breadth_internals, advance_decline_line, new_high_low, pct_above_sma, ath_summary, ath_tolerance, ath_tolerance_default, ath_snapshot,
        sector_returns, relative_returns, country_returns, range_changes, range_distribution, range_distribution_nested, day_distribution, range_summary, range_change_list, day_summary, rejected_quotes,
        period_returns, heat_cells, scorecard_pivot, scorecard_quarters, scorecard_months, scorecard_newest_years, scorecard_newest, leaderboard_nulls_last, heat_intensity, rebased_chart, rebased_chart_ytd,
        factor_left_join, missing_anti_join, proxy_fallback, quote_union, ticker_tape, usage_report, latest_vs_previous, coverage_share, sector_payload, country_histories,
        snapshot_upsert, key_merge, config_upsert_delete, config_changes, counter_trim, bars_projection, bars_full, symbol_validation, csv_preamble_parse, json_closes, month_overflow, js_rounding,
        index_bars_read, point_quotes_read, put_call_window, newest_readings, factors_merged, ingest_health, quarantine, retried_closes,
        stream_day_counts, stream_last_event, stream_daily_snapshot, labels_and_parameters, fixed_universes, partial_feeds,
        bars_by_parameters, call_log, ath_retried, ingest_observed, composite_damaged, partial_reads, market_running, market_trailing, asof_trades, stream_final_days, stream_last_state, stream_first_snapshot,
    )
    out = {f.__name__: f for f in fs}
    return out | {f"resample_{c}": _resample(c) for c in ("month", "quarter", "year")}
