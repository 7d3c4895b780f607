"""Quotes: fallbacks, unions, what is missing, volatility premium, factor joins, call counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded
from .windows import realized_volatility, tail

ITEM = ("label", "value", "change_percent", "is_rate")


def with_proxy(labels: DataFrame, index: DataFrame, proxy: DataFrame) -> DataFrame:
    """(sym, label, proxy_sym, proxy_label) -> the index's quote, else its proxy's under the proxy's label; neither: no row."""
    q = lambda df, p: df.select(F.col("sym").alias(f"{p}sym"), F.struct("price", "change_percent").alias(p))
    rows = labels.join(q(index, "i_"), F.col("sym") == F.col("i_sym"), "left").join(q(proxy, "p_"), F.col("proxy_sym") == F.col("p_sym"), "left")
    has = F.col("i_.price").isNotNull()
    rows = rows.select(F.when(has, F.col("label")).otherwise(F.col("proxy_label")).alias("label"), F.when(has, F.col("i_")).otherwise(F.col("p_")).alias("x"))
    return rows.select("label", rounded("x.price", 2).alias("value"), rounded("x.change_percent", 2).alias("change_percent"), F.lit(False).alias("is_rate")).where("value is not null")


def tape(*parts: DataFrame) -> DataFrame:
    """Items of all parts in order; what a part lacks is null."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("a tape needs a part")
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in ITEM], "part").withColumn("is_rate", F.coalesce("is_rate", F.lit(False)))


def latest_change(series: DataFrame, by: list[str]) -> DataFrame:
    """value and change_percent of each series' last row against the one before."""
    last = tail(series, 2, by).groupBy(*by).agg(F.max_by("close", "d").alias("value"), F.when(F.count(F.lit(1)) > 1, F.min_by("close", "d")).alias("before"))
    return last.select(*by, "value", rounded((F.col("value") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100, 2).alias("change_percent"))


def incomplete(price: Column, prev: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c)
    return bad(price) | bad(prev) | (prev == 0)


def missing(requested: DataFrame, got: DataFrame, key: str) -> DataFrame:
    return requested.join(got.select(key), key, "left_anti")


def volatility_premium(closes: DataFrame, implied: DataFrame, last: int = 180) -> DataFrame:
    """d, realized, implied, spread for days that have both; the spread is of the unrounded values."""
    both = realized_volatility(closes).select("d", "vol").join(implied.select("d", F.col("close").alias("iv")), "d")
    return tail(both, last, []).select("d", rounded("vol", 2).alias("realized"), rounded("iv", 2).alias("implied"), rounded(F.col("iv") - F.col("vol"), 2).alias("spread"))


def merged_factors(three: DataFrame, momentum: DataFrame) -> DataFrame:
    return three.join(momentum.select("d", "mom"), "d", "left")


def usage(counts: DataFrame, days: int = 14, kept: int = 90) -> DataFrame:
    """One row: total and average (1 digit, 0 if there is none) of the newest days' calls, of at most `kept` days."""
    newest = counts.groupBy("d").agg(F.sum("calls").alias("calls")).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("d")))).where(F.col("rn") <= min(days, kept))
    total, n = F.coalesce(F.sum("calls"), F.lit(0)), F.count(F.lit(1))
    return newest.agg(total.cast("long").alias("total"), n.alias("days"), F.coalesce(rounded(total / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("average"))
