"""Helpers shared by the training-data operators: the shared folder, written tables, ordered buckets, distributed ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only a local session, as in tests, gets one of its own where it is
    unset; on a cluster a folder of one machine would lose rows, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
        root = spark.sparkContext.getCheckpointDir()
    return root


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's SQL settings (dots as double underscores) for what is planned and run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    had = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cleaned(spark: SparkSession) -> contextlib.AbstractContextManager:
    """What is run inside leaves no shuffle files behind: Spark removes a query's as soon as it has ended, not when its plan is
    garbage-collected."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: `df` as a Parquet table in the shared folder, read again. It outlives any executor, and the shuffles that made
    it are removed."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/{name}"
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_bucket(df: DataFrame, key: str, rows: int = 1024, coarse: int = 64, most: int = 1 << 16) -> Column:
    """A long that never falls as `key` (long) rises, with about `rows` rows to a value, and at most `most` values.

    The quantiles of `key` (one small aggregate) split its range; within a quantile the buckets have equal widths.
    Null keys count as the least key. Equal keys share a bucket."""
    n, splits = df.agg(F.count(F.lit(1)), F.percentile_approx(F.col(key), [i / coarse for i in range(coarse + 1)], 20 * coarse)).first()
    if not n or not splits:
        return F.lit(0).cast("long")
    per = max(1, min(most // coarse, -(-n // (coarse * rows))))
    k = F.coalesce(F.col(key), F.lit(splits[0]))
    inner = F.array(*[F.lit(int(x)) for x in splits[1:-1]])
    i = F.size(F.filter(inner, lambda x: x <= k))
    lo, hi = (F.element_at(F.array(*[F.lit(int(x)) for x in part]), i + 1) for part in (splits[:-1], splits[1:]))
    width = F.greatest(F.lit(1.0), (hi.cast("double") - lo.cast("double")))
    fine = F.floor((k.cast("double") - lo.cast("double")) / width * per)
    return i.cast("long") * per + F.least(F.lit(per - 1).cast("long"), F.greatest(F.lit(0).cast("long"), fine))


def ranked(df: DataFrame, group: list[str], sub: str, order: list[Column], rank: str, total: str | None = None, coarse: int | None = None) -> DataFrame:
    """Adds the rank (long, from 0) of each row within `group`, ordered by `sub`, then `order`; `total`: and the group's size.

    No task holds a whole group: rows are numbered within (group, sub), and how many rows have lower values of `sub` comes from
    a table of counts, joined on the same keys (so without another shuffle). `sub` has to split groups evenly; neither it nor the
    group may be null. `coarse`: `sub` is a long, and its counts are summed by so many of its values first, so that no task gets
    the whole table of counts either."""
    n, before, size, c, base = fresh(df.select("*", *[F.lit(0).alias(c) for c in (rank, total) if c]), "n__", "before__", "size__", "coarse__", "base__")
    counts = df.groupBy(*group, sub).agg(F.count(F.lit(1)).alias(n))
    lower = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = [F.sum(n).over(Window.partitionBy(*group)).alias(size)] if total else []
    if coarse:
        counts = counts.withColumn(c, F.floor(F.col(sub) / coarse))
        tops = counts.groupBy(*group, c).agg(F.sum(n).alias(base)).select(*group, c, lower(Window.partitionBy(*group).orderBy(c), base).alias(base))
        own = lower(Window.partitionBy(*group, c).orderBy(sub), n)
        counts = counts.join(tops, [*group, c]).select(*group, sub, (F.col(base) + own).alias(before), *sizes)
    else:
        counts = counts.select(*group, sub, lower(Window.partitionBy(*group).orderBy(sub), n).alias(before), *sizes)
    local = df.withColumn(n, F.row_number().over(Window.partitionBy(*group, sub).orderBy(*order)))
    out = local.join(counts, [*group, sub]).withColumn(rank, F.col(before) + F.col(n) - 1)
    return (out.withColumn(total, F.col(size)) if total else out).drop(n, before, size)
