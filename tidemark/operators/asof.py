"""Point-in-time joins: the latest row on or before a date. One shuffle and one sort, never a join of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dated_stream(left: DataFrame, right: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Both sides as one stream: row__ (a left row, null for the right side's), keys, order, v__ (the right side's value), side__ (0 right, 1 left)."""
    keys = [*by, order]
    r = right.groupBy(*keys).agg(F.max(value).alias("v__"))
    a = left.select(F.struct(*left.columns).alias("row__"), *keys, F.lit(None).cast(r.schema["v__"].dataType).alias("v__"), F.lit(1).alias("side__"))
    b = r.select(F.lit(None).cast(a.schema["row__"].dataType).alias("row__"), *keys, "v__", F.lit(0).alias("side__"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, by: list[str], value: str, out: str, order: str = "d", how: str = "left") -> DataFrame:
    """Adds to each left row the right side's `value` of the latest row with the same keys and an equal or earlier `order`.

    Both sides are laid into one ordered stream, right rows before left rows of the same date; the last right value seen is
    carried forward. Of right rows with equal keys and dates the largest value counts. how="inner" drops what finds none."""
    w = Window.partitionBy(*by).orderBy(order, "side__").rowsBetween(Window.unboundedPreceding, 0)
    rows = dated_stream(left, right, by, value, order).withColumn(out, F.last("v__", ignorenulls=True).over(w)).where("side__ = 1")
    if how == "inner":
        rows = rows.where(F.col(out).isNotNull())
    return rows.select("row__.*", out)


def at_or_before(target: Column, close: str = "close", d: str = "d") -> Column:
    """An aggregate: the close of the latest row on or before `target` (a column that is constant in the group)."""
    return F.max_by(F.when(F.col(d) <= target, F.col(close)), F.when(F.col(d) <= target, F.col(d)))


def rebased_ratio(numerator: DataFrame, denominator: DataFrame, n: int = 504) -> DataFrame:
    """(d, y): numerator over the latest denominator, 100 at the n-th row from the end. A zero denominator gives no row."""
    from .windows import rebased_at

    rows = asof(numerator.select("d", F.col("close").alias("a")), denominator.select("d", F.col("close").alias("b")), [], "b", "b", how="inner")
    return rebased_at(rows.where("b != 0").select("d", (F.col("a") / F.col("b")).alias("y")), n, [])
