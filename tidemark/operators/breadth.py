"""Market internals: flags of each name on each day, then counts over names, then the cumulative line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import share
from .windows import ordered, trailing

YEAR, LONG_MEAN = 252, 200


def name_flags(closes: DataFrame) -> DataFrame:
    """(sym, d, close) -> flags of every row but a name's first: up (above the last close), new_high and new_low (of the last 252
    rows, this one included), above_sma (null before 200 rows), at_high and at_low (against all earlier closes). One sort."""
    w = ordered(["sym"])
    year, mean = trailing(["sym"], YEAR), trailing(["sym"], LONG_MEAN)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("close")
    rows = closes.select(
        "sym", "d", "close", F.row_number().over(w).alias("rn"), F.lag("close").over(w).alias("prev"),
        F.max("close").over(year).alias("hi"), F.min("close").over(year).alias("lo"), F.avg("close").over(mean).alias("sma"),
        F.max("close").over(past).alias("top"), F.min("close").over(past).alias("floor"),
    ).where("rn > 1")
    return rows.select("sym", "d", (c > F.col("prev")).alias("up"), (c >= F.col("hi")).alias("new_high"), (c <= F.col("lo")).alias("new_low"), F.when(F.col("rn") >= LONG_MEAN, c > F.col("sma")).alias("above_sma"), (c >= F.col("top")).alias("at_high"), (c <= F.col("floor")).alias("at_low"))


def daily_counts(flags: DataFrame) -> DataFrame:
    """A row for each day; what isn't up is a decline. Names without a row that day don't count."""
    n = F.count(F.lit(1))
    counts = flags.groupBy("d").agg(
        F.count_if("up").alias("advances"), (n - F.count_if("up")).alias("declines"), F.count_if("new_high").alias("new_highs"), F.count_if("new_low").alias("new_lows"),
        F.count_if("above_sma").alias("above"), F.count("above_sma").alias("covered"), F.count_if("at_high").alias("at_highs"), F.count_if("at_low").alias("at_lows"), n.alias("names"),
    )
    return counts.select("d", "advances", "declines", "new_highs", "new_lows", share("above", "covered").alias("pct_above_sma"), "at_highs", share("at_highs", "names").alias("pct_at_highs"), "at_lows", share("at_lows", "names").alias("pct_at_lows"))


def internals(closes: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """The daily table with the advance/decline line and the benchmark's close of that very day, if any.

    The line runs over one row a day: names are counted first."""
    days = daily_counts(name_flags(closes))
    if benchmark is not None:
        days = days.join(benchmark.select("d", F.col("close").alias("benchmark_close")), "d", "left")
    return days.withColumn("ad_line", F.sum(F.col("advances") - F.col("declines")).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))


def long_series(days: DataFrame) -> DataFrame:
    """The three breadth factors as (id, d, y)."""
    rows = days.select("d", F.explode(F.array(
        F.struct(F.lit("breadthadline").alias("id"), F.col("ad_line").cast("double").alias("y")),
        F.struct(F.lit("breadthhilo").alias("id"), (F.col("new_highs") - F.col("new_lows")).cast("double").alias("y")),
        F.struct(F.lit("breadthpct200").alias("id"), F.col("pct_above_sma").alias("y")),
    )).alias("k"))
    return rows.select("k.id", "d", "k.y").where("y is not null")


def at_extremes(flags: DataFrame) -> DataFrame:
    """One row: the last day's names at their highs, sorted, with counts and share."""
    last = flags.select(F.max("d").alias("d"))
    rows = flags.join(F.broadcast(last), "d")
    names = F.array_sort(F.collect_list(F.when(F.col("at_high"), F.col("sym"))))
    return rows.groupBy("d").agg(F.count(F.lit(1)).alias("total"), F.size(names).cast("long").alias("n_high"), names.alias("names")).withColumn("pct", share("n_high", "total"))


def at_tolerance(quotes: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """(ticker, high, low, high_all, low_all) -> one row: names within the tolerance of their all-time high and low."""
    good = quotes.where("high is not null and high_all is not null")
    top = F.col("high") >= F.col("high_all") * (1 - tolerance)
    bottom = F.coalesce(F.col("low") <= F.col("low_all") * (1 + tolerance), F.lit(False))
    out = good.agg(F.count(F.lit(1)).alias("total"), F.count_if(top).alias("n_high"), F.count_if(bottom).alias("n_low"), F.array_sort(F.collect_list(F.when(top, F.col("ticker")))).alias("highs"), F.array_sort(F.collect_list(F.when(bottom, F.col("ticker")))).alias("lows"))
    return out.withColumn("pct_high", share("n_high", "total")).withColumn("pct_low", share("n_low", "total"))
