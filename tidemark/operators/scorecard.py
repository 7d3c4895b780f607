"""Resampled heat-maps, leaderboards and rebased charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import period
from ..functions.numbers import heat, pct_change, rounded
from .windows import ordered

SHOWN = {"month": 12, "quarter": 8, "year": 8}
CAPS = {"month": 10.0, "quarter": 20.0, "year": 40.0}


def resampled(closes: DataFrame, cadence: str) -> DataFrame:
    """(sym, period, d, close): the last close of each period."""
    return closes.groupBy("sym", period(F.col("d"), cadence).alias("period")).agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))


def period_returns(closes: DataFrame, cadence: str) -> DataFrame:
    """Return of each period against the one before that the symbol has; periods without rows are not filled."""
    w = Window.partitionBy("sym").orderBy("period")
    return resampled(closes, cadence).withColumn("ret", pct_change("close", F.lag("close").over(w))).where("ret is not null").select("sym", "period", "ret")


def shown_periods(returns: DataFrame, cadence: str) -> DataFrame:
    return returns.select("period").distinct().orderBy(F.desc("period")).limit(SHOWN[cadence])


def heat_cells(closes: DataFrame, cadence: str) -> DataFrame:
    """sym, period, ret, opacity for the newest periods."""
    returns = period_returns(closes, cadence)
    rows = returns.join(F.broadcast(shown_periods(returns, cadence)), "period")
    return rows.select("sym", "period", rounded("ret", 2).alias("ret"), rounded(heat("ret", None, CAPS[cadence]), 4).alias("opacity"))


def scorecard(closes: DataFrame, cadence: str, periods: list[str] | None = None) -> DataFrame:
    """A row for each symbol, a column for each of the newest periods (read first, a dozen values at most, unless given)."""
    returns = period_returns(closes, cadence)
    periods = periods or [r[0] for r in shown_periods(returns, cadence).collect()]
    return returns.groupBy("sym").pivot("period", periods).agg(rounded(F.first("ret"), 2))


def scorecard_by_place(closes: DataFrame, cadence: str) -> DataFrame:
    """A row for each symbol, a column for each of the newest periods by its place: p1 is the newest. Nothing is read beforehand."""
    returns, shown = period_returns(closes, cadence), range(1, SHOWN[cadence] + 1)
    places = returns.select("period").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.desc("period")))).where(F.col("place") <= len(shown))
    rows = returns.join(F.broadcast(places), "period", "left")  # at most a dozen rows
    return rows.groupBy("sym").agg(*[rounded(F.max(F.when(F.col("place") == k, F.col("ret"))), 2).alias(f"p{k}") for k in shown])


def leaderboard(returns: DataFrame, by: str, columns: list[str], descending: bool = True) -> DataFrame:
    """Rank by a return, nulls last either way, with the heat of each cell against its column's largest."""
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    most = returns.agg(*[F.greatest(F.lit(0.01), F.coalesce(F.max(F.abs(c)), F.lit(0.0))).alias(f"most_{c}") for c in columns])
    rows = returns.crossJoin(F.broadcast(most))  # one row by construction
    rank = F.row_number().over(Window.orderBy(key, "sym"))
    return rows.select(rank.alias("place"), "sym", *columns, *[rounded(heat(c, f"most_{c}"), 4).alias(f"heat_{c}") for c in columns])


def rebased_chart(closes: DataFrame, benchmark: DataFrame, days: int | None = None, year_to_date: bool = False, name: str = "benchmark") -> DataFrame:
    """ord, sym, d, y: the benchmark's series (0), then the others by symbol, each on the benchmark's calendar within the range that ends on
    its last day: 100 on the first day that the series has there, null on days that it lacks, and throughout if it has none.

    The grid has a row for each series and day; symbols are few, and are sent to all tasks."""
    end = benchmark.agg(F.max("d").alias("end"))
    calendar = benchmark.crossJoin(F.broadcast(end))  # one row by construction
    if year_to_date:
        calendar = calendar.where(F.col("d") >= F.trunc("end", "YEAR"))
    elif days is not None:
        calendar = calendar.where(F.col("d") >= F.date_sub("end", days))
    names = closes.groupBy("sym").agg(F.lit(1).alias("n")).select((F.row_number().over(Window.orderBy("sym"))).alias("ord"), "sym")
    names = names.unionByName(closes.sparkSession.createDataFrame([(0, name)], "ord int, sym string"))
    every = closes.select("sym", "d", "close").unionByName(benchmark.select(F.lit(name).alias("sym"), "d", "close"))
    grid = calendar.select("d").distinct().crossJoin(F.broadcast(names))  # days by symbols: what a chart shows
    rows = grid.join(every, ["sym", "d"], "left")
    whole = ordered(["ord", "sym"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y = F.col("close") / F.nullif(F.first("close", ignorenulls=True).over(whole), F.lit(0.0)) * 100
    return rows.select("ord", "sym", "d", rounded(y, 2).alias("y"))
