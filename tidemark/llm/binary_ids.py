"""Token ids in files of Simple-8b words, in ascending document order, and back.

A 64-bit word holds a selector (top 4 bits) and `n` ids of `60 // n` bits, the first in the lowest bits. `n` is one of COUNTS, by
selector; the last selector is the escape: one id at full width. A block holds whole documents' ids, about BLOCK_IDS of
them, as words; beside them stand its documents, their lengths and where each begins, so that a block is decoded with a few
vector operations and any document is found without reading the others. Blocks are rows of Parquet files, one file for each
range of document ids, so Spark's commit protocol covers lost executors, on any store that Spark writes.

There are as many files as shuffle partitions, and more where that would make them larger than FILE_BYTES of text, so a task doesn't
grow with the input. Null or empty text: only the end id. Null document ids come first. Equal (or null) document ids: by a hash of the
text, then by text, so that they too are dealt over files. An empty table gives no rows. Columns other than the two named
are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK_IDS = 1 << 16
#: Of text, at most about, for a file.
FILE_BYTES = 128_000_000
#: Of text, encoded at once.
SLICE_BYTES = 4_000_000
SCHEMA = "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, lengths array<int>, starts array<int>, words binary"
KINDS = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
ARROW = pa.schema([(name, KINDS[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])


def pack_words(ids: np.ndarray) -> np.ndarray:
    """ids (any below 2**60) -> Simple-8b words, each with as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    width = np.maximum(1, np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int8))
    step, widest, upto = np.ones(n, np.uint8), width.copy(), 1
    for count in sorted(COUNTS)[1:]:
        if count > n:
            break
        while upto < count:  # widest: the largest width among an id and the upto - 1 after it
            widest = np.maximum(widest[:-1], width[upto:])
            upto += 1
        fit = widest <= 60 // count
        if not fit.any():
            break
        step[: len(fit)][fit] = count
    jump, at, i = step.tolist(), [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    at = np.asarray(at)
    held, out = step[at], np.zeros(len(at), np.uint64)
    for selector, count in enumerate(COUNTS):
        mine = np.flatnonzero(held == count)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(60 // count)
            parts = ids[at[mine][:, None] + np.arange(count)] << shifts
            out[mine] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector << 60)
    return out


def unpack_words(words: np.ndarray) -> np.ndarray:
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.asarray(COUNTS)[selector]
    at, out = np.cumsum(held) - held, np.zeros(int(held.sum()), np.uint64)
    for k in np.unique(selector):
        count, mine = COUNTS[k], np.flatnonzero(selector == k)
        bits = 60 // count
        parts = (words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[at[mine][:, None] + np.arange(count)] = parts
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about SLICE_BYTES of text, or one row."""
    for batch in batches:
        upto, at = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(upto):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _blocks(batches: Iterator[pa.RecordBatch], name: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, part = encoder(name), TaskContext.get().partitionId()
    docs, counts, pieces, size, block, done = [], [], [], 0, 0, 0

    def row() -> pa.RecordBatch:
        lengths = np.concatenate(counts)
        words = pack_words(np.concatenate(pieces)).astype("<u8").tobytes()
        values = (part, block, done, size, docs, lengths, np.cumsum(lengths) - lengths, words)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(ARROW, values, strict=True)], schema=ARROW)

    for batch in _slices(batches):
        ids, lengths = coder.encode_all(batch.column("text"))
        ids = np.insert(ids, np.cumsum(lengths), end_id)
        lengths = lengths + 1
        ends, names, first, at = np.cumsum(lengths), batch.column("doc").to_pylist(), 0, 0
        while first < len(ends):
            last = min(len(ends), int(np.searchsorted(ends, at + BLOCK_IDS - size)) + 1)  # behind the document that fills the block
            docs += names[first:last]
            counts.append(lengths[first:last])
            pieces.append(ids[at : ends[last - 1]])
            size += len(pieces[-1])
            first, at = last, ends[last - 1]
            if size >= BLOCK_IDS:
                yield row()
                docs, counts, pieces, block, done, size = [], [], [], block + 1, done + size, 0
    if docs:
        yield row()


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, files: int | None = None) -> None:
    """Encodes every whole text, ends it with `end_id` and writes the files. `files`: their number, if it is to be another."""
    if not files:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "doc", "h").sortWithinPartitions("doc", "h", "text").select("doc", "text")
    rows.mapInArrow(lambda it: _blocks(it, tokenizer, end_id), SCHEMA).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_ids, lengths, starts, first, words in zip(batch["doc_ids"], batch["lengths"], batch["starts"], batch["first"], batch["words"], strict=True):
            raw = unpack_words(np.frombuffer(words, "<u8")).astype("<u4").tobytes()
            ids = [raw[4 * s : 4 * (s + n)] for s, n in zip(starts, lengths, strict=True)]
            yield pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in doc_ids], "Int64"), "start": first + np.asarray(starts, np.int64), "n_tokens": np.asarray(lengths, np.int64), "ids": ids})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32), from the files alone."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    rows = rows.select("doc_ids", "lengths", "starts", (F.col("before") + F.col("start_in_part")).alias("first"), "words")
    return rows.mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids binary")
