"""Threshold-scaled sketches of documents, in DataFrame functions alone.

A document's shingles are its distinct sequences of five words (a shorter text: the whole sequence; no words: none), words being
what white space parts, in lower case. The sketch retains every shingle hash below a fixed fraction of the hash range. Texts of
fewer than about FLOOR / FRACTION shingles would keep too few for an estimate; their threshold is the (FLOOR + 1)-th smallest hash,
which itself is left out. `upto` says up to which hash a sketch is complete; two sketches are compared up to the lesser of
theirs. A threshold is in no sketch that it bounds, so both the likeness (Jaccard) and the containment of a short text in a long one
are unbiased, and the union of sketches, up to the lesser bound, is a sketch of the union.

Null text: no shingles. Two texts without words are alike (1.0); one with and one without are not (0.0). More columns stay; a column
of the output's name is replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, ordered_bucket

#: Of the hashes' range: one in 4. Texts of FLOOR / FRACTION (128) shingles and more, most texts, are sketched by it alone.
FRACTION = 1 / 4
FLOOR = 32
#: Rows of a bucket in `with_next`, few, so that tasks get equal shares of them; beyond about 1e8 rows buckets get larger.
BUCKET_ROWS = 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def sketched(df: DataFrame, text: str, sketch: str, words: int = 5) -> DataFrame:
    """Adds the struct `sketch`: n (distinct shingles), upto, hashes (ascending)."""
    w, h, k = fresh(df, "w__", "h__", "k__")
    bound = int(_LEAST + FRACTION * 2**64)
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\t\n\x0B\f\r]", " ")), " +")
    df = df.withColumn(w, F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size(w)
    shingles = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(words)]))
    df = df.withColumn(h, F.when(n >= words, F.sort_array(F.array_distinct(shingles))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(k, F.size(F.filter(h, lambda x: x < bound)))
    kept = F.slice(h, F.lit(1), F.greatest(F.lit(FLOOR), F.col(k)))
    upto = F.when(F.size(h) <= F.greatest(F.lit(FLOOR), F.col(k)), F.lit(_MOST)).when(F.col(k) >= FLOOR, F.lit(bound - 1)).otherwise(F.try_element_at(h, F.lit(FLOOR + 1)) - 1)
    return df.withColumn(sketch, F.struct(F.size(h).alias("n"), upto.alias("upto"), kept.alias("hashes"))).drop(w, h, k)


def compared(a: Column, b: Column) -> Column:
    """likeness, containment (of a in b): from two sketches."""
    upto = F.least(a["upto"], b["upto"])
    x, y = (F.filter(s["hashes"], lambda v: v <= upto) for s in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    none = F.when((a["n"] == 0) & (b["n"] == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(
        F.when(either > 0, both / F.nullif(either, F.lit(0))).otherwise(none).alias("likeness"),
        F.when(F.size(x) > 0, both / F.nullif(F.size(x), F.lit(0))).otherwise(none).alias("containment"),
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union: hashes up to the lesser bound. Its n is unknown (null)."""
    upto = F.least(a["upto"], b["upto"])
    return F.struct(F.lit(None).cast("int").alias("n"), upto.alias("upto"), F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda v: v <= upto)).alias("hashes"))


def as_text(sketch: Column) -> Column:
    """shingles:completeness bound:hashes, in hexadecimal."""
    return F.concat_ws(":", F.hex(sketch["n"].cast("long")), F.hex(sketch["upto"]), F.concat_ws(",", F.transform(sketch["hashes"], lambda v: F.hex(v))))


def with_next(df: DataFrame, key: str, columns: dict[str, str], tie: str, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds, under the new names, the columns of the row that follows in ascending `key` (then `tie`); after the last, the first.

    Rows are dealt by ordered buckets; each bucket also gets the first row of the next one, so a window within the bucket is
    enough. `derive` adds columns once rows are in their buckets, so they aren't shuffled. The first keys, which are sent to all
    tasks, are as many as buckets: one for BUCKET_ROWS rows, and a million at most (about 50 MB). Null keys come first."""
    if df.isEmpty():
        return derive(df).select("*", *[F.col(c).alias(n) for c, n in columns.items()])
    bucket, guest, to, head = fresh(df, "bucket__", "guest__", "to__", "head__")
    rows = df.withColumn(bucket, ordered_bucket(df, key, BUCKET_ROWS, most=1 << 20))
    heads = rows.groupBy(bucket).agg(F.min(F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("k")))[ "k"].alias(head), F.max(F.col(key).isNull()).alias(guest))
    heads = heads.select(F.when(F.col(guest), F.lit(None)).otherwise(F.col(head)).alias(head), bucket)
    at = Window.orderBy(bucket)
    ends = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(head, F.col(bucket).alias(f"{bucket}h"), F.coalesce(F.lag(bucket).over(at), F.max(bucket).over(ends)).alias(to))
    guests = rows.join(F.broadcast(heads), rows[key].eqNullSafe(heads[head])).withColumn(bucket, F.col(to)).drop(head, to, f"{bucket}h").withColumn(guest, F.lit(True))
    rows = derive(rows.withColumn(guest, F.lit(False)).unionByName(guests).repartition(bucket))
    w = Window.partitionBy(bucket).orderBy(guest, F.col(key).asc_nulls_first(), tie)
    return rows.select("*", *[F.lead(c).over(w).alias(n) for c, n in columns.items()]).where(~F.col(guest)).drop(bucket, guest)
