"""Running and trailing windows and as-of joins over keys too long for one task: all trades of a market, one heavy symbol.

A window holds its whole key in one task. Here a key is cut into blocks by a column that never decreases along the order (a day, a day and
a range of keys). Each block is aggregated, what lies before it is carried from block to block over these totals alone, and every block then
opens with a row that holds its carry, so the rows need one shuffle by key and block and no task has more than a block. The block is a function of the row,
so both readings of the rows agree, also when a lost executor's part is computed again. Input is read twice: write it first where it is dear.

Rows without an order or a block come first, in a block of their own. Null keys are a key. Empty input gives empty output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import dated_stream

#: kind -> aggregate, of a block as of a window; "last", the last value that is not null, has one for each (see below).
KINDS = {"sum": F.sum, "max": F.max, "min": F.min, "last": None}


def running(df: DataFrame, by: list[str], order: list[str], block: Column, outs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds out = kind(column) over all rows of the key up to and with this one, for out: (kind, column) in `outs`; kinds: sum, max, min, last.

    `order` should be total within a key: which of tied rows comes first isn't defined. Sums of DOUBLE depend on the order of additions, so pass
    DECIMAL or whole numbers. A null adds nothing; before the first value the result is null."""
    for out, (kind, _) in outs.items():
        if kind not in KINDS:
            raise ValueError(f"{out}: no such kind: {kind!r}")
        if out in df.columns:
            raise ValueError(f"there is a column {out} already")
    keys = [f"k{i}__" for i in range(len(by))]
    marks = [f"o{i}__" for i in range(len(order))]
    values = [f"v{i}__" for i in range(len(outs))]
    rows = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("row__"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)],
        *[F.col(c).alias(m) for c, m in zip(order, marks, strict=True)], block.alias("block__"), *[F.col(c).alias(v) for (_, c), v in zip(outs.values(), values, strict=True)],
    )
    kinds = [kind for kind, _ in outs.values()]
    at = F.struct(*marks)
    totals = rows.groupBy(*keys, "block__").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) if k == "last" else KINDS[k](v).alias(v) for k, v in zip(kinds, values, strict=True)])
    before = Window.partitionBy(*keys).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "block__", *[_over(k, v, before).alias(v) for k, v in zip(kinds, values, strict=True)])
    kind_of = dict(rows.dtypes)
    opening = carried.select(F.lit(None).cast(rows.schema["row__"].dataType).alias("row__"), *keys, *[F.lit(None).cast(kind_of[m]).alias(m) for m in marks], "block__", *values, F.lit(0).alias("side__"))
    own = Window.partitionBy(*keys, "block__").orderBy("side__", *marks).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("side__", F.lit(1)).unionByName(opening)
    done = both.select("row__", "side__", *[_over(k, v, own).alias(o) for o, k, v in zip(outs, kinds, values, strict=True)]).where("side__ = 1")
    return done.select("row__.*", *outs)


def _over(kind: str, value: str, window) -> Column:
    return F.last(value, ignorenulls=True).over(window) if kind == "last" else KINDS[kind](value).over(window)


def trailing(df: DataFrame, by: list[str], order: list[str], block: Column, n: int, outs: dict[str, tuple[str, str]], size: int = 100_000) -> DataFrame:
    """Adds out = kind(column) over the last n rows of the key, this one included (fewer at its start); kinds as in `running`.

    Rows are numbered by a running count, cut into pieces of `size` rows, and each piece's last n - 1 rows go to the next one as well, so
    a task has size + n - 1 rows of a key. `order` must be total within a key."""
    if n < 1 or size < n:
        raise ValueError("a window has at least one row, a piece at least a window's")
    one = df.withColumn("one__", F.lit(1).cast("long"))
    rows = running(one, by, order, block, {"rn__": ("sum", "one__")}).drop("one__")
    piece = F.floor((F.col("rn__") - 1) / size)
    passed_on = (F.col("rn__") - 1) % size > size - n
    rows = rows.withColumn("at__", F.explode(F.when(passed_on, F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.struct((piece + 1).alias("piece"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own"))))))
    w = Window.partitionBy(*by, F.col("at__.piece")).orderBy("rn__").rowsBetween(-(n - 1), 0)
    done = rows.select("*", *[_over(kind, c, w).alias(o) for o, (kind, c) in outs.items()])
    return done.where("at__.own").select(*df.columns, *outs)


def asof(left: DataFrame, right: DataFrame, by: list[str], value: str, out: str, block: Column, order: str = "d", how: str = "left") -> DataFrame:
    """As `asof.asof`, with no key whole in one task. `block` is an expression of the order column."""
    stream = dated_stream(left, right, by, value, order)
    rows = running(stream, by, [order, "side__"], block, {"found__": ("last", "v__")}).where("side__ = 1")
    if how == "inner":
        rows = rows.where("found__ is not null")
    return rows.select("row__.*", F.col("found__").alias(out))
