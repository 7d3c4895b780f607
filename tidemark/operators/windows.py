"""Windows over ordered series. Every operator takes the series' keys, so each series is sorted once, in its own partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio


def ordered(by: list[str], order: str = "d"):
    return Window.partitionBy(*by).orderBy(order)


def trailing(by: list[str], n: int, order: str = "d"):
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def trailing_mean(df: DataFrame, n: int, by: list[str], y: str = "y", order: str = "d", out: str = "ma") -> DataFrame:
    """Mean of the last n rows; rows with fewer before them are left out."""
    rows = df.withColumn("rn__", F.row_number().over(ordered(by, order))).withColumn(out, F.avg(y).over(trailing(by, n, order)))
    return rows.where(F.col("rn__") >= n).drop("rn__")


def ratio_to_mean(df: DataFrame, n: int, by: list[str], y: str = "y", order: str = "d") -> DataFrame:
    """Adds ma and ratio."""
    return trailing_mean(df, n, by, y, order).withColumn("ratio", ratio(y, "ma"))


def true_range_percent(bars: DataFrame, n: int = 14, by: list[str] | None = None) -> DataFrame:
    """Adds tr (the first bar's is high - low), atr (simple mean of n) and y, the mean in percent of the close."""
    by = by or []
    prev = F.lag("close").over(ordered(by))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    rows = trailing_mean(bars.withColumn("tr", tr), n, by, "tr", out="atr")
    return rows.withColumn("y", ratio("atr", "close") * 100)


def realized_volatility(closes: DataFrame, n: int = 20, by: list[str] | None = None, days: int = 252) -> DataFrame:
    """(…, d, close) -> adds vol: annualised deviation of the last n log returns in percent, from row n + 1 on."""
    by = by or []
    rows = closes.withColumn("r__", F.ln(F.col("close") / F.nullif(F.lag("close").over(ordered(by)), F.lit(0.0)))).withColumn("rn__", F.row_number().over(ordered(by)))
    rows = rows.withColumn("vol", F.stddev_samp("r__").over(trailing(by, n)) * F.sqrt(F.lit(float(days))) * 100)
    return rows.where(F.col("rn__") > n).drop("r__", "rn__")


def tail(df: DataFrame, n: int, by: list[str], order: str = "d") -> DataFrame:
    """The last n rows of each series."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("rn__") <= n).drop("rn__")


def rebased_at(df: DataFrame, n: int, by: list[str], y: str = "y", order: str = "d") -> DataFrame:
    """100 at the n-th row from the end, or the first if there are fewer."""
    rows = df.withColumn("rn__", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    base = F.max(F.when(F.col("rn__") == F.least(F.lit(n), F.col("n__")), F.col(y))).over(Window.partitionBy(*by))
    return rows.withColumn("base__", base).withColumn("y", F.col(y) / F.nullif(F.col("base__"), F.lit(0.0)) * 100).drop("rn__", "n__", "base__")
