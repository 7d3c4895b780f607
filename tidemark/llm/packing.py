"""Best-two-fit packing of token sequences.

A bin is filled greedily, the largest unpacked piece that fits first; then its smallest piece is replaced by two unpacked pieces
that fit the gap so widened more tightly, if there are such. Packing depends on lengths alone, so it is planned over the
table of counts by length (at most `size` rows, however many documents there are), a filling repeated as often as its
lengths last. Pieces then get their places by their rank within their length, counted without gathering a length in one task.
Ids, which are most of the bytes, take no part in the ranking: pieces are numbered when they are written, and meet their places
by that number.

Null or empty text: only the end id. Repeated rows are packed as often as they occur; null document ids too. An empty
table gives no rows. Columns not named are kept if asked for; clashing names are no matter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ranked, written
from .tokens import encoder

PIECE = "array<struct<piece:int,start:long,length:long,ids:binary>>"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only what is longer than `size` is cut, and the first piece takes the rest."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def pieces_of(text: Column, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, size: int = 1024) -> Column:
    @F.pandas_udf(PIECE)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in texts:
            out = []
            for t in batch.tolist():
                ids = coder.encode(t or "") + end
                out.append([{"piece": k, "start": at, "length": n, "ids": ids[4 * at : 4 * (at + n)]} for k, (at, n) in enumerate(cut(len(ids) // 4, size))])
            yield pd.Series(out)

    return pieces(text)


def tokenized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", nth: str = "nth", **how) -> DataFrame:
    """A row for each piece: `keep`, piece, start, length, ids (little-endian uint32), and its number (unique, not dense). A written
    table: texts are tokenized once, and numbers stay what they are."""
    rows = docs.select(*keep, F.explode(pieces_of(F.col(text), **how)).alias("p__"))
    return written(rows.select(*keep, "p__.*", F.monotonically_increasing_id().alias(nth)), "pieces")


def plan(counts: dict[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """counts by length -> for each length its runs (first rank, number, first bin, offset in each bin); the number of bins."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    runs: dict[int, list] = {n: [] for n in counts}
    used, bins = Counter(), 0
    lengths = np.arange(size + 1)
    while True:
        held: Counter = Counter()
        spare = left.copy()
        below = np.maximum.accumulate(np.where(spare > 0, lengths, 0))  # the largest length at hand up to each
        space = size
        while (n := int(below[space])) > 0:
            held[n] += 1
            spare[n] -= 1
            space -= n
            if not spare[n]:
                below = np.maximum.accumulate(np.where(spare > 0, lengths, 0))
        if not held:
            return runs, bins
        small = min(held)
        if len(held) > 1 or held[small] > 1:
            gap, best = space + small, (small, 0, 0)
            at = np.flatnonzero(spare[: gap + 1])
            at = at[at > 0]
            if len(at):
                other = below[gap - at]
                twice = (other == at) & (spare[at] < 2)  # the same length needs two of it
                other = np.where(twice, below[np.maximum(other - 1, 0)], other)
                both = np.where(other > 0, at + other, 0)
                k = int(both.argmax())
                if both[k] > best[0]:
                    best = (int(both[k]), int(at[k]), int(other[k]))
            if best[1]:
                held[small] -= 1
                held += Counter()
                held.update(best[1:])
        times = min(int(left[n]) // k for n, k in held.items())
        offset = 0
        for n in sorted(held, reverse=True):
            for _ in range(held[n]):
                runs[n].append((used[n], times, bins, offset))
                used[n] += times
                offset += n
            left[n] -= held[n] * times
        bins += times


def placed(pieces: DataFrame, size: int = 1024, length: str = "length", nth: str = "nth", heavy: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to `size` and a number of their own, which goes. `heavy` columns, if
    there, are left out of the ranking. Read more than once: give a written table."""
    counts = {int(r[0]): r[1] for r in pieces.groupBy(length).count().collect()}  # at most `size` rows
    runs, _ = plan(counts, size)
    tables = {n: tuple(np.asarray(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}
    heavy = [c for c in heavy if c in pieces.columns]
    salt, rank, spot = fresh(pieces, "salt__", "rank__", "spot__")
    salts = min(1 << 16, max(16, -(-sum(counts.values()) // 200_000)))
    light = pieces.select(nth, length) if heavy else pieces
    rows = ranked(light.withColumn(salt, F.pmod(F.xxhash64(nth), F.lit(salts))), [length], salt, [F.col(nth)], rank)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        bins, offsets = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            first, _, bin_, offset = tables[int(one)]
            mine = np.flatnonzero(n == one)
            k = np.searchsorted(first, r[mine], "right") - 1
            bins[mine], offsets[mine] = bin_[k] + r[mine] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    rows = rows.withColumn(spot, place(length, rank))
    if heavy:
        rows = pieces.join(rows.select(nth, spot), nth)
    return rows.select(*[c for c in pieces.columns if c != nth], f"{spot}.sequence_id", f"{spot}.offset")


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = 1024, **how) -> DataFrame:
    """Every piece of every document with its ids, its sequence and its place there."""
    (nth,) = fresh(docs, "nth")
    return placed(tokenized(docs, keep, text, nth, size=size, **how), size, nth=nth)
