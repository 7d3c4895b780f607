"""Stupid-backoff scores, computed relationally.

score(w | c) = count(c w) / count(c) where the corpus has c w, else BACKOFF * score(w | c without its first word), down to
count(w) / words. By default a document's own n-grams are not counted as evidence for it (leave one out), without which no
n-gram of the corpus would ever be unseen.

Equal texts have equal scores, so each distinct text is counted once with the number of its rows, and its score goes to all of them; a
group of copies costs its rows' hashes, not its n-grams. Distinct texts are kept as the hashes of their words, made once, and lie in packs
of about PACK words. N-grams are named by 64-bit hashes:
  - a pack's distinct n-grams with their counts there (an n-gram comes once from each pack, so there are no hot keys) travel to their
    part, a range of the hash, as arrays;
  - `counted`: the count table, grouped by part, with a row for each n-gram that more than one record has: its total and its packs. The others'
    counts are their pack's own;
  - its explosion by pack gives each pack its n-grams' totals;
  - a pack's texts and totals meet, what has no total there is counted in the pack, and each text's logarithms are summed.
N-grams go through these in SLICES ranges of the hash, one after the other, so that the shuffle's disk is a fraction of all n-grams. For
the same reason the packs are scored in HALVES.

Words: A-Z lower-cased, parted by white space; a document's n-grams don't reach over its ends. Null or wordless text: no words,
sum 0, mean null. Repeated rows count as often as they occur. Null ids are rows like others. Texts are told apart by 128-bit
hashes. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .near_dups import _mixed, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Ranges of the hash that are counted one after the other, and of the packs that are scored so.
SLICES, HALVES = 4, 4
#: Words of a pack (about 150 MB while it is scored); n-grams of a part, at most about; least parts of a slice.
PACK, PART, PARTS = 600_000, 1_000_000, 24
#: Totals that are packed at once in a worker.
PACKET = 2_000_000
#: Unused: common n-grams need no table of their own since they have one row for each pack. A test still sets it.
FREQUENT = 100_000
HASHED = "a long, b long, row long, m long, words binary"
PACKETS = "part int, pack long, grams array<long>, counts array<long>"
COUNTED = "gram long, total long, packs array<long>"
ANSWERS = "pack long, grams array<long>, totals array<long>"
SCORED = "row long, n_words long, n_seen long, n_backed_off long, log10_sum double"


def _pieces(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches again, of about `chars` bytes of text each, so that what is made of them stays small."""
    for batch in batches:
        sizes = np.asarray([x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // chars, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, row, m, text) -> HASHED: in place of a text the hashes of its words."""
    for batch in _pieces(batches):
        hashes, ends = word_hashes(batch.column("text").to_pylist())
        raw, cuts = hashes.tobytes(), (8 * ends).tolist()
        words = pa.array([raw[x:y] for x, y in zip([0, *cuts], cuts, strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "row", "m")], words], [c.split()[0] for c in HASHED.split(", ")])


def _grams(words: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; for each word its text, and its place there."""
    hashes = np.frombuffer(b"".join(words), np.uint64)
    sizes = np.asarray([len(x) // 8 for x in words], np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [_mixed(hashes + np.uint64(1))]
    for n in range(2, order + 1):
        prev = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])[: len(hashes)]
        out.append(_mixed(prev * np.uint64(0x9E3779B97F4A7C55) + hashes + np.uint64(n)))
    return out, text, place


def _summed(grams: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of `many` (1 for most)."""
    distinct, counts = np.unique(grams, return_counts=True)
    more = np.flatnonzero(many > 1)
    np.add.at(counts, np.searchsorted(distinct, grams[more]), many[more] - 1)
    return distinct, counts


def _packets(order: int, slice_: int, slices: int, parts: int):
    """(pack, m, words) -> PACKETS of the n-grams whose hash lies in the slice: a record for each pack and part of the slice. A pack that
    is read in pieces has several."""
    low, high = (slice_ << 64) // slices, (slice_ + 1 << 64) // slices
    width = -(-(high - low) // parts)
    edges = np.asarray([low + k * width for k in range(1, parts) if low + k * width < high], np.uint64)

    def records(pack: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        cuts = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        once = np.repeat(np.arange(0, 2 * len(cuts) - 2, 2), np.diff(cuts)) + (counts > 1)  # in a part what occurs once comes first: equal counts compress
        by = np.argsort(once.astype(np.uint16) if 2 * len(cuts) <= 1 << 16 else once, kind="stable")
        grams, counts = grams[by], counts[by]
        some = np.flatnonzero(np.diff(cuts))
        offsets = pa.array(np.append(cuts[some], len(grams)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (grams.view(np.int64), counts)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), pack)), *lists], ["part", "pack", "grams", "counts"])

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for whole in batches:
            packs = whole.column("pack").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(np.diff(packs)) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, len(packs)], strict=True):
                if x == y:
                    continue
                if held and packs[x] != last:
                    yield records(last, held)
                    held = []
                last = int(packs[x])
                for batch in _pieces([whole.slice(x, y - x)], "words"):
                    many = batch.column("m").to_numpy(zero_copy_only=False)
                    grams, text, place = _grams(batch.column("words").to_pylist(), order)
                    for n, g in enumerate(grams):
                        mine = np.flatnonzero((g >= np.uint64(low)) & (g <= np.uint64(high - 1)) & (place >= n))
                        held.append((g[mine], many[text[mine]]))
        if held:
            yield records(last, held)

    return packets


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and how many each row has."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _counted(packets: pa.Table) -> pa.Table:
    """PACKETS of one part -> COUNTED: the n-grams that are in more than one record."""
    (grams, sizes), (counts, _) = _flat(packets.column("grams")), _flat(packets.column("counts"))
    packs = np.repeat(packets.column("pack").to_numpy(), sizes)
    by = np.argsort(grams)
    ordered = grams[by]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(by)])
    sizes = np.diff(np.append(starts, len(by)))
    more = sizes > 1
    totals = np.add.reduceat(counts[by], starts)[more] if len(by) else counts
    offsets = np.append(0, np.cumsum(sizes[more])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(packs[by[np.repeat(more, sizes)]]))
    return pa.table([pa.array(ordered[starts[more]]), pa.array(totals), lists], ["gram", "total", "packs"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, gram, total) -> ANSWERS, a record for each pack that is among some PACKET of them."""

    def record(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        packs, grams, totals = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("pack", "gram", "total"))
        by = np.argsort(packs, kind="stable")
        here, starts = np.unique(packs[by], return_index=True)
        offsets = pa.array(np.append(starts, len(by)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(here), *[pa.ListArray.from_arrays(offsets, pa.array(x[by])) for x in (grams, totals)]], ["pack", "grams", "totals"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKET:
            yield record(held)
            held, size = [], 0
    if size:
        yield record(held)


def _totals(grams: np.ndarray, text: np.ndarray, many: np.ndarray, told: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of a pack's occurrences, which stand by text: its n-gram's total, which is the pack's own where none is told, and how often
    the n-gram stands in the same text."""
    by = np.argsort(grams, kind="stable")
    ordered, texts = grams[by], text[by]
    first = np.append(True, ordered[1:] != ordered[:-1])[: len(by)]
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(many[by], starts) if len(by) else many
    at = np.searchsorted(ordered[starts], told)
    here = np.flatnonzero(at < len(starts))
    here = here[ordered[starts[at[here]]] == told[here]]
    sums[at[here]] = totals[here]
    runs = np.flatnonzero(first | np.append(True, texts[1:] != texts[:-1])[: len(by)])
    lengths = np.diff(np.append(runs, len(by)))
    out, own = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    out[by], own[by] = np.repeat(sums, np.diff(np.append(starts, len(by)))), np.repeat(lengths, lengths)
    return out, own


def _scored(order: int, backoff: float, leave_one_out: bool, words: int):
    """(pack, row, m, words), ANSWERS of one pack -> the score of each text."""

    def rows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams, text, place = _grams(texts.column("words").to_pylist(), order)
        size = np.bincount(text, minlength=texts.num_rows)
        many = texts.column("m").to_numpy()[text]
        told, totals = _flat(answers.column("grams"))[0].view(np.uint64), _flat(answers.column("totals"))[0]
        left = []
        for n, g in enumerate(grams):
            there = np.flatnonzero(place >= n)
            total, own = _totals(g[there], text[there], many[there], told, totals)
            left.append(np.zeros(len(place), np.int64))
            left[n][there] = total - own if leave_one_out else total
        base = words - (size[text] if leave_one_out else 0)
        result = np.log10(np.where((left[0] > 0) & (base > 0), left[0] / np.maximum(base, 1), 1 / max(words, 1)))
        used = np.ones(len(place), np.int64)
        for n in range(2, order + 1):
            context = np.concatenate([np.zeros(1, np.int64), left[n - 2][:-1]])[: len(place)]
            ok, seen = place >= n - 1, left[n - 1] > 0
            kept = np.log10(np.maximum(left[n - 1], 1) / np.maximum(context, 1))
            result = np.where(ok, np.where(seen, kept, result + np.log10(backoff)), result)
            used = np.where(ok & seen, n, used)
        full = np.minimum(order, place + 1)
        add = lambda x: np.bincount(text, x, texts.num_rows)
        out = [texts.column("row"), pa.array(size), pa.array(add(used == full).astype(np.int64)), pa.array(add(used < full).astype(np.int64)), pa.array(add(result).astype(np.float64))]
        return pa.table(out, [c.split()[0] for c in SCORED.split(", ")])

    return rows


def distinct_texts(rows: DataFrame) -> DataFrame:
    """HASHED: each text once, named by two hashes, with a number and how many rows have it."""
    texts = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("text").alias("text"))
    return written(texts.select("a", "b", F.monotonically_increasing_id().alias("row"), "m", "text").mapInArrow(_hashed, HASHED), "texts")


def counted(packets: DataFrame, tasks: int) -> DataFrame:
    """The count table, (gram, total, packs), of n-grams in more than one record of PACKETS."""
    return packets.repartition(tasks, "part").groupBy("part").applyInArrow(_counted, COUNTED)


def answered(packets: DataFrame, tasks: int) -> DataFrame:
    """ANSWERS: the totals of a pack's n-grams that are in other packs too, in two lists of one order."""
    return counted(packets, tasks).select(F.explode("packs").alias("pack"), "gram", "total").mapInArrow(_packed, ANSWERS)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, leave_one_out: bool = True) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit("b"), "text")})
    texts = distinct_texts(rows)
    size = (F.octet_length("words") / 8).cast("long")
    place = F.shiftright("row", 33)  # the partition that numbered the row
    sums = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * F.col("m")), F.lit(0)), F.coalesce(F.max(place), F.lit(0)))
    n, distinct, words, last = sums.first()
    together = PACK * (last + 1) // max(distinct, 1)  # a pack is some partitions, or a part of one
    pack = F.floor(place / together) if together > 1 else F.floor(F.col("row") / max(1, n * PACK // max(distinct, n, 1)))
    packs = texts.select(pack.alias("pack"), "row", "m", "words")
    parts = max(PARTS, -(-order * distinct // (SLICES * PART)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 2)
    told = [written(answered(packs.select("pack", "m", "words").mapInArrow(_packets(order, k, SLICES, parts), PACKETS), tasks), f"totals_{k}") for k in range(SLICES)]

    def half(k: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("pack"), F.lit(HALVES)) == k
        every = told[0]
        for t in told[1:]:
            every = every.unionByName(t)
        # a pack without texts has no totals either
        found = packs.where(mine).groupBy("pack").cogroup(every.where(mine).groupBy("pack")).applyInArrow(_scored(order, backoff, leave_one_out, words), SCORED)
        return written(found, f"scores_{k}")

    found = half(0)
    for k in range(1, HALVES):
        found = found.unionByName(half(k))
    found = texts.select("a", "b", "row").join(found, "row").drop("row")
    mean = F.when(F.col("n_words") > 0, F.col("log10_sum") / F.nullif(F.col("n_words"), F.lit(0)))
    return rows.select("doc_id", "a", "b").join(found, ["a", "b"]).drop("a", "b").withColumn("log10_mean", mean)
