"""Proportional stratified interleaving: shards that each have the mixture of the whole.

Rows are shuffled by a seeded hash within their stratum and ranked there; a row's fractional rank is (rank + 1/2) / rows of its
stratum. The rows in the order of their fractional ranks, cut into equal parts, are the shards: their counts differ by one at
most, and those of a stratum in two shards by about as little. Ranks are counted over buckets of the hash, so a stratum with
most of all rows is in many tasks.

Null strata are one stratum. Repeated rows: each has a place, which one is arbitrary. Null keys come first among equal
hashes. An empty table gives no rows. More columns stay as they are; those that have the outputs' names are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ranked


def interleaved(df: DataFrame, shards: int = 24, stratum: str = "source", key: str = "doc_id", seed: str = "tidemark", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds shard (int) and slot (long, from 0 without gaps). Pass few columns: rows are shuffled twice."""
    s, h, sub, rank, size, part, at, frac = fresh(df, "s__", "h__", "sub__", "rank__", "size__", "part__", "at__", "frac__")
    n = df.count()
    digits = 2 if n < 1 << 22 else 4
    rows = df.withColumn(s, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    rows = rows.withColumn(h, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn(sub, F.substring(h, 1, digits))
    rows = ranked(rows, [s], sub, [F.col(h), F.col(key)], rank, size)
    rows = rows.withColumn(frac, (F.col(rank) + 0.5) / F.col(size))
    parts = max(1, -(-n // 1024))
    rows = rows.withColumn(part, F.least(F.lit(parts - 1).cast("long"), F.floor(F.col(frac) * parts)))
    rows = ranked(rows, [], part, [F.col(frac), F.col(s), F.col(h), F.col(key)], at, coarse=4096)
    number = F.expr(f"`{at}` * {shards} div {max(n, 1)}")
    first = F.expr(f"((`{at}` * {shards} div {max(n, 1)}) * {n} + {shards - 1}) div {shards}")
    return rows.withColumn(shard, number.cast("int")).withColumn(slot, F.col(at) - first).drop(s, h, sub, rank, size, part, at, frac)
