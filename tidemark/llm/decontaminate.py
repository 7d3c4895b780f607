"""Benchmark passages in documents, by Wu-Manber search over words.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window is `width` consecutive words of an item; an item
of fewer words, but not none, is one window. Windows of one length m are sought together: a table has, for each block of two
words in any window, how far the search may shift on without missing a window; blocks not in the table let it shift by m - 1.
Where the shift is 0, the windows that end with this block are compared word by word. A document's word inside any
occurrence is hit.

Null or wordless texts have no words and no hits; null or wordless items have no windows. Equal items are found both. Items
with a null id hit words and are not named. An empty benchmark hits nothing. More columns stay as they are; one that has the
output's name is replaced."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = "n_words long, n_hit long, items array<string>, hits array<struct<start:long,end:long>>"
#: Characters of benchmark text sent to the executors at once; a larger benchmark is sought in several passes. The tables of so many
#: were measured to take 190 MB in a Python worker.
PASS_CHARS = 2_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """Those of one length."""

    def __init__(self, m: int, items: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], list] = defaultdict(list)
        for window, ids in items.items():
            for end in range(self.block, m + 1):
                b = window[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.far), m - end)
            self.ending[window[m - self.block :]].append((list(window), ids))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, ids of the items) of every occurrence, by start."""
        m, far, shift, n = self.m, self.far, self.shift.get, len(text)
        i = m
        if self.block == 2:
            while i <= n:
                step = shift((text[i - 2], text[i - 1]), far)
                if step:
                    i += step
                    continue
                for window, ids in self.ending[text[i - 2], text[i - 1]]:
                    if text[i - m : i] == window:
                        yield i - m, ids
                i += 1
        else:
            for i, w in enumerate(text):
                for _, ids in self.ending.get((w,), ()):
                    yield i, ids


def windows_of(items: list[tuple[str | None, str | None]], width: int) -> list[Windows]:
    by: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = tuple(words(text))
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by[m][w[i : i + m]].add(item)
    return [Windows(m, x) for m, x in sorted(by.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _udf(items: list, width: int):
    sent = items

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        kinds = windows_of(sent, width)
        for texts, before in batches:
            out = []
            for text, had, held in zip(texts.tolist(), before["hits"].tolist(), before["items"].tolist(), strict=True):
                w = words(text)
                spans = [] if had is None else [(x["start"], x["end"]) for x in had]
                ids = set() if held is None else set(held)
                for kind in kinds:
                    for at, of in kind.search(w):
                        spans.append((at, at + kind.m))
                        ids |= of
                spans = _merged(spans)
                out.append((len(w), sum(b - a for a, b in spans), sorted(x for x in ids if x is not None), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "hits"])

    return search


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, out: str = "contamination") -> DataFrame:
    """Adds a struct: n_words, n_hit, items (ids as strings, sorted), hits (word positions, end exclusive).

    The benchmark's size is read first. One that has more than about PASS_CHARS characters is sought in passes: the documents are
    written with a number for each row, each pass writes its finds, and its items are released before the next ones are
    collected, so no size of it has to fit at once."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    passes = 1 + int(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // PASS_CHARS
    tmp, nth = fresh(docs, "found__", "nth__")
    kind = f"struct<{FOUND.replace(' array', ':array').replace(' long', ':long')}>"
    if passes == 1:
        own = [tuple(r) for r in items.collect()]
        return docs.withColumn(tmp, F.lit(None).cast(kind)).withColumn(tmp, _udf(own, width)(F.col(text), F.col(tmp))).withColumn(out, F.col(tmp)).drop(tmp)
    docs = written(docs.withColumn(nth, F.monotonically_increasing_id()), "numbered")

    def finds(k: int) -> DataFrame:
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()]
        rows = docs.select(F.col(nth), _udf(own, width)(F.col(text), F.lit(None).cast(kind)).alias("f"))
        return written(rows.where("f.n_hit > 0").select(nth, "f.items", "f.hits"), "finds")

    every = finds(0)
    for k in range(1, passes):
        every = every.union(finds(k))
    every = every.groupBy(nth).agg(F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hits")).alias("hits")).cast(kind).alias(tmp))
    docs = docs.join(every, nth, "left")
    return docs.withColumn(tmp, _udf([], width)(F.col(text), F.col(tmp))).withColumn(out, F.col(tmp)).drop(tmp, nth)
