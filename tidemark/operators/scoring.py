"""Full-history percentile scores and the weighted composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio, rounded
from .asof import asof
from .isolation import loaded  # noqa: F401 - part of scoring's interface
from .windows import ordered, tail

LONG = ["id", "d", "y"]


def _sum_of_last(column: str, sizes: tuple[int, ...], w) -> F.Column:
    """The sum of the last `column` rows, as the difference of two running sums; `sizes` are the values that `column` has."""
    before = F.lit(None).cast("decimal(38,8)")
    for n in sizes:
        before = F.when(F.col(column) == n, F.lag("sum__", n).over(w)).otherwise(before)
    return (F.col("sum__") - F.coalesce(before, F.lit(0))).cast("double")


def _ranked(series: DataFrame, specs: DataFrame, windows: tuple[int, ...], order: str) -> DataFrame:
    """All rows with rn__ (row number), sum__ (running sum), scored__ (whether there is a window), ma, ratio, pct, score."""
    w = ordered(["id"], order)
    rows = series.join(F.broadcast(specs), "id")
    rows = rows.withColumn("rn__", F.row_number().over(w)).withColumn("sum__", F.sum(F.col("y").cast("decimal(30,8)")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("scored__", F.col("rn__") >= F.col("window")).withColumn("ma", _sum_of_last("window", windows, w) / F.col("window"))
    rows = rows.withColumn("ratio", F.when(F.col("scored__"), ratio("y", "ma")))
    rank = F.cume_dist().over(Window.partitionBy("id", "scored__").orderBy("ratio"))
    rows = rows.withColumn("pct", rounded(rank * 100, 1))
    return rows.withColumn("score", F.when(F.col("invert"), rounded(100 - F.col("pct"), 1)).otherwise(F.col("pct")))


def scored(series: DataFrame, specs: DataFrame, windows: tuple[int, ...], order: str = "d") -> DataFrame:
    """Long series (id, order, y) and specifications (id, weight, invert, window) -> adds ma, ratio, pct and score. `windows`: the lengths
    that the specifications name.

    A reading is compared with the mean of the last `window` rows, and the ratio ranked within its whole history (share of ratios at
    or below it). Series of all windows are scored in one pass: the trailing sum is the difference of two running sums, which
    are DECIMAL, so it is exact and costs the same for any window. Inverted series score 100 - pct."""
    rows = _ranked(series, specs.select("id", "weight", "invert", "window"), windows, order)
    return rows.where("scored__").drop("rn__", "sum__", "scored__")


def percentile_rank(series: DataFrame, order: str = "d") -> DataFrame:
    """(id, value, percentile): the latest reading's rank in its history, whole percent."""
    last = F.max_by("y", order).over(Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = series.withColumn("value", last)
    return rows.groupBy("id", "value").agg(rounded(100 * F.count_if(F.col("y") <= F.col("value")) / F.count(F.lit(1)), 0).alias("percentile"))


def components(series: DataFrame, specs: DataFrame, windows: tuple[int, ...], shown: tuple[int, ...] = (), order: str = "d") -> DataFrame:
    """A row for each series that there is: ord, id, value, percentile, score (50 while the history is short), weight, and how the score came
    about (all null then): calc_window, period_label, invert, calc_value, ma, ratio, ratio_percentile.

    `value` is the last reading to two digits; unrounded where the specification says `exact`; and where it has a number `shown` (one of
    `shown`) and the series that many rows, the last reading against the mean of so many, in percent. One pass over the series:
    the last reading, its rank, its score and the mean shown come from the same partitions."""
    w = ordered(["id"], order)
    optional = {"ord": F.lit(None).cast("int"), "shown": F.lit(None).cast("int"), "period_label": F.lit(None).cast("string"), "exact": F.lit(False)}
    specs = specs.select("*", *[c.alias(k) for k, c in optional.items() if k not in specs.columns])
    rows = _ranked(series, specs, windows, order)
    rows = rows.withColumn("shown__", F.when(F.col("rn__") >= F.col("shown"), _sum_of_last("shown", shown, w) / F.col("shown")))
    rows = rows.withColumn("last__", F.last("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = ("ord", "weight", "invert", "window", "period_label", "exact")
    last = F.max_by(F.struct("y", "shown__", "scored__", "ma", "ratio", "pct", "score", *kept), order).alias("s")
    out = rows.groupBy("id").agg(last, F.count_if(F.col("y") <= F.col("last__")).alias("below"), F.count(F.lit(1)).alias("n"))
    y, has = F.col("s.y"), F.col("s.scored__")
    versus = rounded((y / F.nullif(F.col("s.shown__"), F.lit(0.0)) - 1) * 100, 2)
    value = F.when(F.col("s.shown__").isNotNull(), versus).when(F.col("s.exact"), y).otherwise(rounded(y, 2))
    calc = {"calc_window": F.col("s.window"), "period_label": F.col("s.period_label"), "invert": F.col("s.invert"), "calc_value": rounded(y, 3), "ma": rounded("s.ma", 3), "ratio": rounded("s.ratio", 4), "ratio_percentile": F.col("s.pct")}
    return out.select(
        "s.ord", "id", value.alias("value"), rounded(100 * F.col("below") / F.col("n"), 0).alias("percentile"), F.when(has, F.col("s.score")).otherwise(50.0).alias("score"), "s.weight",
        *[F.when(has, c).alias(k) for k, c in calc.items()],
    )


def recent(series: DataFrame, last: int = 504, digits: int = 3) -> DataFrame:
    """(id, place, d, value): the last rows of each series, numbered from 0."""
    rows = tail(series, last, ["id"])
    place = (F.row_number().over(ordered(["id"])) - 1).alias("place")
    return rows.select("id", place, "d", rounded("y", digits).alias("value"))


def histories(series: DataFrame, last: int = 504, digits: int = 3) -> DataFrame:
    """id, history: array of (d, y) of the last rows, ascending."""
    rows = tail(series, last, ["id"])
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", rounded("y", digits).alias("y")))).alias("history"))


def composite(parts: DataFrame) -> DataFrame:
    """One row: the weighted mean of the scores of the series there are, whole points. No series: an error."""
    n = F.count(F.lit(1))
    mean = F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0)).cast("double")
    return parts.agg(F.when(n == 0, F.raise_error(F.lit("no component could be computed"))).otherwise(rounded(mean, 0)).alias("score"), F.sum("weight").alias("weight_seen"), n.alias("n_components"))


def composite_history(series: DataFrame, specs: DataFrame, windows: tuple[int, ...], closes: DataFrame, last: int = 504) -> DataFrame:
    """(id, d, y) -> d, score (whole points) for the days on which all series that there are have a score, with the latest close (null if
    none yet). A series that has loaded but is too short for a score leaves no day. The weights of the series that there are come
    with the days (a few ids a day), so the series are read once."""
    rows = _ranked(series, specs.select("id", "weight", "invert", "window"), windows, "d")
    own = lambda c: F.sum(F.when(F.col("scored__"), c))
    days = rows.groupBy("d").agg(own(F.col("score").cast("decimal(18,1)") * F.col("weight")).alias("s"), own(F.col("weight")).alias("w"), F.collect_set(F.struct("id", "weight")).alias("ids"))
    every = F.collect_set("ids").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a day
    total = F.aggregate(F.array_distinct(F.flatten(every)), F.lit(0), lambda t, x: t + x["weight"])
    days = days.withColumn("total", total).where("w = total").select("d", rounded(F.col("s").cast("double") / F.col("w"), 0).alias("score"))
    return asof(tail(days, last, []), closes.select("d", "close"), [], "close", "close")


def versus_mean(closes: DataFrame, n: int = 90) -> DataFrame:
    """One row: the latest close against the mean of the last n, in percent; none if there are fewer."""
    rows = tail(closes, n, [])
    out = rows.agg(F.max_by("close", "d").alias("latest"), (F.sum(F.col("close").cast("decimal(30,8)")).cast("double") / F.count(F.lit(1))).alias("ma"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == n).select("latest", rounded("ma", 4).alias("ma"), rounded((F.col("latest") / F.nullif(F.col("ma"), F.lit(0.0)) - 1) * 100, 2).alias("value"))
