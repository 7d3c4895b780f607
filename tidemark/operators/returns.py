"""Calendar-anchored returns and cross-sectional distributions. All base dates of a symbol are looked up in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import before, months_later
from ..functions.numbers import annualized, pct_change, rounded
from .asof import at_or_before
from .tape import incomplete

HORIZONS = ("d1", "w1", "mtd", "m1", "qtd", "m3", "m6", "ytd", "y1")
#: Range -> years that it is annualised over.
RANGES = {"5D": 1, "MTD": 1, "QTD": 1, "YTD": 1, "1Y": 1, "3Y": 3, "5Y": 5}


def _with_last(closes: DataFrame) -> DataFrame:
    own = Window.partitionBy("sym")
    return closes.withColumn("last", F.max("d").over(own)).withColumn("back", F.row_number().over(own.orderBy(F.desc("d"))))


def horizon_returns(closes: DataFrame) -> DataFrame:
    """(sym, d, close) -> unrounded returns in percent, anchored to each symbol's own last day; null where there is no base."""
    last = F.col("last")
    targets = {"w1": F.date_sub(last, 7), "mtd": before(last, "MM"), "m1": months_later(last, -1), "qtd": before(last, "QUARTER"), "m3": months_later(last, -3), "m6": months_later(last, -6), "ytd": before(last, "YEAR"), "y1": months_later(last, -12)}
    bases = _with_last(closes).groupBy("sym").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"), F.max(F.when(F.col("back") == 2, F.col("close"))).alias("d1"), *[at_or_before(t).alias(k) for k, t in targets.items()])
    return bases.select("sym", "d", "close", *[pct_change("close", k).alias(k) for k in HORIZONS])


def relative(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rounded returns, and rounded differences of the unrounded ones to the benchmark's (one row; none: an error)."""
    b = benchmark.agg(F.when(F.count(F.lit(1)) != 1, F.raise_error(F.lit("the benchmark must have one row"))).cast("int").alias("n"), *[F.first(k).alias(f"b_{k}") for k in HORIZONS]).where("n is null")
    rows = returns.crossJoin(F.broadcast(b))  # one row by construction
    return rows.select("sym", "d", "close", *[rounded(k, 2).alias(k) for k in HORIZONS], *[rounded(F.col(k) - F.col(f"b_{k}"), 2).alias(f"rel_{k}") for k in HORIZONS])


def range_changes(closes: DataFrame) -> DataFrame:
    """(range_key, sym, pct): each symbol's own last close against its close on or before a base anchored to the last day of all
    symbols (5D: the sixth row from its end); 3Y and 5Y annualised; two digits; bases that aren't above 0, and ratios that can't be
    annualised, are left out."""
    top = closes.agg(F.max("d").alias("top"))
    rows = _with_last(closes).crossJoin(F.broadcast(top))  # one row by construction
    t = F.col("top")
    targets = {"MTD": before(t, "MM"), "QTD": before(t, "QUARTER"), "YTD": before(t, "YEAR"), "1Y": months_later(t, -12), "3Y": months_later(t, -36), "5Y": months_later(t, -60)}
    bases = rows.groupBy("sym").agg(F.max_by("close", "d").alias("close"), F.max(F.when(F.col("back") == 6, F.col("close"))).alias("5D"), *[at_or_before(x).alias(k) for k, x in targets.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("range_key"), F.lit(n).alias("years"), F.col(f"`{k}`").alias("base")) for k, n in RANGES.items()]))
    long_ = bases.select("sym", "close", pairs.alias("k")).select("sym", "close", "k.*").where("base > 0")
    pct = F.when(F.col("years") == 3, annualized("close", "base", 3)).when(F.col("years") == 5, annualized("close", "base", 5)).otherwise(pct_change("close", "base"))
    pct = F.when((F.col("years") > 1) & (F.col("close") <= 0), F.lit(None)).otherwise(pct)
    return long_.select("range_key", "sym", rounded(pct, 2).alias("pct")).where("pct is not null")


def quote_changes(quotes: DataFrame) -> DataFrame:
    """(range_key 1D, sym, pct) from quotes; incomplete ones are left out, see `rejected`."""
    good = quotes.where(~incomplete(F.col("price"), F.col("prev_close")))
    return good.select(F.lit("1D").alias("range_key"), "sym", rounded(pct_change("price", "prev_close"), 2).alias("pct"))


def rejected(quotes: DataFrame) -> DataFrame:
    """The incomplete quotes and why: what `quote_changes` leaves out."""
    price, prev = F.col("price"), F.col("prev_close")
    bad = lambda c: c.isNull() | F.isnan(c)
    why = F.when(bad(price), F.lit("no price")).when(bad(prev), F.lit("no previous close")).otherwise(F.lit("previous close 0"))
    return quotes.where(incomplete(price, prev)).select("sym", "price", "prev_close", why.alias("reason"))


def distribution(changes: DataFrame, nested: bool = False) -> DataFrame:
    """A row for each range: n, median, mean, up, down, unchanged, of rounded changes; nested: with the sorted list of all."""
    p = F.col("pct")
    more = [F.array_sort(F.collect_list(F.struct("pct", "sym"))).alias("changes")] if nested else []
    mean = F.sum(p.cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return changes.groupBy("range_key").agg(F.count(F.lit(1)).alias("n"), rounded(F.median("pct"), 2).alias("median"), rounded(mean, 2).alias("mean"), F.count_if(p > 0).alias("up"), F.count_if(p < 0).alias("down"), F.count_if(p == 0).alias("unchanged"), *more)


def summarised(changes: DataFrame, universe: DataFrame) -> DataFrame:
    """`distribution` with total (names of the universe, with or without data) and annualized (null for 1D, which has no such key)."""
    total = universe.select("sym").distinct().agg(F.count(F.lit(1)).alias("total"))
    years = F.create_map(*[F.lit(x) for k, n in RANGES.items() for x in (k, n > 1)])
    return distribution(changes).crossJoin(F.broadcast(total)).withColumn("annualized", F.try_element_at(years, F.col("range_key")))  # one row by construction


def change_list(changes: DataFrame, universe: DataFrame) -> DataFrame:
    """(range_key, place, sym, pct): the changes of each range from the least to the largest, ties in the universe's order (ord, sym)."""
    rows = changes.join(universe.select("sym", "ord"), "sym")
    return rows.select("range_key", F.row_number().over(Window.partitionBy("range_key").orderBy("pct", "ord")).alias("place"), "sym", "pct")
