"""Importance resampling towards a target distribution, over hashed n-grams.

Features are runs of 1 to ORDER words, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. A bucket's
gain compares its share of the target's features with its share of the source's (both smoothed by one), in whole thousandths of
the natural logarithm. A document's weight is the sum of its features' gains; with Gumbel noise from its id added, the highest
scores are a draw without replacement in proportion to exp(weight / 1000).

Long texts are skewed, so no task reads one whole after this first step: texts are cut at word boundaries into chunks of CHUNK words and
carry, the ORDER - 1 words that follow. A chunk owns the features that start at its own words, so each feature of a text is in
exactly one. Chunks are dealt out evenly and written; from then on a text is the sum of its chunks: counts per bucket are summed
in each task, then over tasks (BUCKETS rows); weights are summed by document. The draw finds its last score from counts by score, and ranks
drawn rows within buckets of the score, never all rows in one task.

Words: A-Z lower-cased, then runs of letters, digits and anything beyond ASCII. Null or wordless text: no features, weight 0, not drawn,
but scored. Repeated rows are drawn one by one, with ranks in a row. A null id is hashed as no digits, and stands after others of
the same score. Target texts may be null. With no features at all in source and target every gain is 0. An empty table gives no
rows. Other columns are not read."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ordered_bucket, written
from .lm_score import _pieces

ORDER, BUCKETS, SEED, SHARE, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Words that a chunk owns.
CHUNK = 4_096
#: Repeated rows that are written out at once.
COPIES = 4_096
CHUNKS = "doc_id long, text_key binary, seq int, own int, words binary"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE_CRC = zlib.crc32(b" ")
_shifts: dict[int, np.ndarray] = {}


def _chunks(size: int, order: int):
    """(doc_id, text, text_key) -> chunks; a text without words is one without own words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key")), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
                for seq, a in enumerate(range(0, max(1, len(words)), size)):
                    own = min(size, len(words) - a)
                    for column, x in zip(out, (doc, key, seq, own, b" ".join(words[a : a + own + order - 1])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    return rows


def chunked(rows: DataFrame, size: int = CHUNK, order: int = ORDER) -> DataFrame:
    """The chunks of (doc_id, text), as a table dealt out evenly. text_key tells apart texts that share an id."""
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return written(rows.mapInArrow(_chunks(size, order), CHUNKS).hint("rebalance"), "chunks")


def _shift(length: int) -> np.ndarray:
    """What so many zero bytes make of a CRC-32's register, by each of its four bytes."""
    if length not in _shifts:
        if len(_shifts) > 4_096:
            _shifts.clear()
        # CRC-32 is affine: the register after zeros, less that of an empty one, is linear in the register's bits
        zeros = bytes(length)
        base = zlib.crc32(zeros, 0)
        bits = [zlib.crc32(zeros, 1 << k) ^ base for k in range(32)]
        table = np.zeros((4, 256), np.uint32)
        for k, v in enumerate(bits):
            table[k // 8, (np.arange(256) >> (k % 8)) & 1 == 1] ^= np.uint32(v)
        _shifts[length] = table
    return _shifts[length]


def _joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts whose parts have these, the right ones being so long."""
    out, sizes = right.copy(), np.unique(lengths)
    tables = np.stack([_shift(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    which = np.searchsorted(sizes, lengths)
    for k in range(4):
        out ^= tables[which, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(words: bytes, own: int, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the features that start at the first `own` words."""
    parts = words.split()
    crc = np.fromiter(map(zlib.crc32, parts), np.uint32, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    after = np.fromiter((zlib.crc32(w, _SPACE_CRC) for w in parts), np.uint32, len(parts))  # of a space and the word
    out, run = [crc[:own] % np.uint32(buckets)], crc
    for n in range(2, order + 1):
        left = run[: len(parts) - n + 1]
        run = _joined(left, after[n - 1 :], sizes[n - 1 :] + 1)
        out.append(run[:own] % np.uint32(buckets))
    return np.concatenate(out).astype(np.int64)


def bucket_counts(chunks: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): sums of each task, then of all."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for words, own in zip(batch.column("words").to_pylist(), batch.column("own").to_pylist(), strict=True):
                n += np.bincount(features(words, own, order, buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return chunks.select("words", "own").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the chunks of both sides. `buckets` rows come to the driver, whatever the tables' sizes."""
    counts = []
    for chunks in (source, target):
        n = np.zeros(buckets, np.int64)
        for b, x in bucket_counts(chunks, order, buckets).collect():
            n[b] = x
        counts.append(n)
    of_source, of_target = int(counts[0].sum()), int(counts[1].sum())
    return np.asarray([math.floor(1000 * math.log((t + 1) * (of_source + buckets) / ((s + 1) * (of_target + buckets)))) for s, t in zip(*(n.tolist() for n in counts), strict=True)], np.int64)


def weighted(chunks: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(doc_id, text_key, copies, n_words, n_features, weight): one row for rows of one id and text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(w, own, order, len(gain)) for w, own in zip(batch.column("words").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            some = [pa.array([len(f) for f in found], pa.int64()), pa.array([int(gain[f].sum()) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "seq", "own")), *some], ["doc_id", "text_key", "seq", "own", "n_features", "weight"])

    rows = chunks.mapInArrow(sums, "doc_id long, text_key binary, seq int, own int, n_features long, weight long")
    copies = F.count_if(F.col("seq") == 0)
    each = lambda c: F.expr(f"sum({c}) div count_if(seq = 0)")
    return rows.groupBy("doc_id", "text_key").agg(copies.alias("copies"), each("own").alias("n_words"), each("n_features").alias("n_features"), each("weight").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(weights: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, copies, score, first): the highest scores of those with enough words, `share` percent of them in rows; `first` is
    the rank of the first copy. The last document may be drawn with fewer copies than it has, see `upto`."""
    fit = weights.where(F.col("n_words") >= least_words)
    by_score = written(fit.groupBy("score").agg(F.sum("copies").alias("n")), "by_score")
    total = by_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = share * total // 100
    # rows above each score, in two levels: by ranges of scores, then within a range
    by_score = by_score.withColumn("down", -F.col("score"))
    by_score = by_score.withColumn("range", ordered_bucket(by_score, "down"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = by_score.groupBy("range").agg(F.sum("n").alias("n")).select("range", above(Window.orderBy("range")).alias("base"))
    starts = by_score.select("score", "range", above(Window.partitionBy("range").orderBy("down")).alias("inside")).join(ranges, "range")
    starts = starts.select("score", (F.col("base") + F.col("inside")).alias("above")).where(F.col("above") < upto)
    rows = fit.join(starts, "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "text_key")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first", F.col("above") + before + 1).where(F.col("first") <= upto)
    return rows.select("doc_id", "text_key", "first", F.lit(upto).cast("long").alias("upto"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, seed: int = SEED) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, n_features, weight, score and its rank in the draw (null: not drawn)."""
    plain = lambda df, k, t: df.select(k.cast("long").alias("doc_id"), F.col(t).alias("text"))
    source = chunked(plain(docs, F.col(doc_id), text))
    gain = gains(source, chunked(plain(target, F.lit(None), target_text)))
    weights = weighted(source, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    weights = written(weights, "weights")
    firsts = drawn(weights, share).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    rows = weights.join(firsts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    kept = ["doc_id", "n_words", "n_features", "weight", "score", "first", "upto", "copies"]
    rows = rows.select(*kept, F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))).alias("block"))
    rows = rows.select(*kept, F.explode(F.sequence(F.col("block"), F.least(F.col("copies"), F.col("block") + COPIES) - 1)).alias("copy"))
    rank = F.col("first") + F.col("copy")
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= F.col("upto"), rank).alias("rank"))
