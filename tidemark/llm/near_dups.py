"""Near duplicates by an inverted join over signature coordinates.

A document's set is its distinct shingles of five words (A-Z lower-cased, words parted by white space; fewer words: the whole
sequence as one; none: no set). Documents with equal sets are one class, for which the one with the smallest id stands. A class
has a MinHash signature of COORDINATES coordinates, and is posted under each coordinate-value pair:
  - pairs in one class only are no posting; what is left is ordered from the rarest to the commonest value, and since two classes
    that agree in MATCHES coordinates share one of the COORDINATES - MATCHES + 1 rarest of either (prefix), only those lists
    are kept; classes with fewer than MATCHES shared values are skipped altogether;
  - of the classes left the shingles that no other of them has are counted; one with more than a quarter of its own is skipped;
  - first round: in each list every class is paired with the one that has the smallest share of shingles of its own, and of these
    pairs each class keeps the one with the most shared lists; what holds up on full sets is merged into components;
  - second round: classes in lists that still hold several components (skip merging: a list inside one component has nothing to
    add) are paired by a prefix filter over their full shingle sets, not by their lists, see _open_pairs; pairs that agree in
    MATCHES coordinates are confirmed on full sets.
So a group of copies costs about as many pairs as it has members. Pairs of similarity 0.75 agree in fewer than MATCHES coordinates with
a probability below one in a million.

Null or wordless text: empty set, linked with nothing. Repeated rows are in one class. Null ids are linked with nothing; ids have to be
integers, since components are named by the smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, written

SHINGLE, COORDINATES, MATCHES, PERCENT = 5, 48, 20, 75
#: Ids up to this number are sent to all tasks in a join; more are shuffled.
BROADCAST_IDS = 2_000_000
#: Rows of a class from which on its component reaches them by a broadcast.
MANY_COPIES = 10_000
_CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        out.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(out[-1])
        if size >= _CHUNK_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def _hashed(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text where its words end.

    A word's hash comes from a running polynomial over all bytes, taken back by the power at which the word begins."""
    raw = np.frombuffer(b" " + b" ".join(chunk) + b" ", np.uint8)
    power, inverse = _power(len(raw))
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edges[0::2], edges[1::2]
    upto = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)
    hashes = _mixed((upto[end - 1] - upto[begin - 1]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, 1 + np.cumsum([len(c) + 1 for c in chunk]))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As above, for any number of texts."""
    hashes, ends, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for chunk in _chunks(texts):
        h, e = _hashed(chunk)
        hashes.append(h)
        ends.append(e + done)
        done += len(h)
    return np.concatenate(hashes), np.concatenate(ends)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    constants = _mixed(np.arange(1, 2 * SHINGLE, dtype=np.uint64)) | np.uint64(1)
    for chunk in _chunks(texts):
        hashes, ends = _hashed(chunk)
        n = max(0, len(hashes) - SHINGLE + 1)
        shingles = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            shingles += hashes[j : n + j] * constants[j]
        shingles, a = _mixed(shingles), 0
        for b in ends.tolist():
            if b - a >= SHINGLE:
                yield np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                yield _mixed(np.atleast_1d((hashes[a:b] * constants[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)))
            else:
                yield np.zeros(0, np.uint64)
            a = b


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        np.minimum(least, (factors[:, None] * shingles[None, at : at + 8192]).min(axis=1), out=least)
    return least


FEATURES = "n long, set_key binary, tokens array<long>"


def features(text: Column) -> Column:
    """n (set size), set_key (128 bits that equal sets share), tokens (a 64-bit name for each coordinate-value pair)."""

    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        factors = _mixed(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64)) | np.uint64(1)
        own = _mixed(np.arange(5000, 5000 + COORDINATES, dtype=np.uint64))
        for texts in batches:
            rows = []
            for s in shingle_sets(texts.tolist()):
                key = np.asarray([s.sum(dtype=np.uint64), _mixed(s + np.uint64(77)).sum(dtype=np.uint64)], "<u8").tobytes() if len(s) else None
                rows.append((len(s), key, _mixed(_signature(s, factors) ^ own).view(np.int64) if len(s) else None))
            yield pd.DataFrame(rows, columns=["n", "set_key", "tokens"])

    return of(text)


def _set(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for s in shingle_sets(texts.tolist())])

    return of(text)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the smallest node reachable. Labels move along links and then jump to the label's label
    until none changes; each round is a written table."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        moved = labels.join(heard, "node", "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(moved.join(of, "label", "left").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        settled = new.where("label != was").isEmpty()
        labels = new.select("node", "label")
        if settled:
            return labels


def _similar(both: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles that share `both` are similar enough."""
    return (100 + PERCENT) * both >= PERCENT * (n + m)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    rows = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    return rows.where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """(rep, label, set) -> pairs of different labels that may be similar, by an exact prefix filter.

    Each set is ordered from its rarest shingle to its commonest. Where two sets meet in a shingle at places i and j, and it is the
    first that they share, they share at most min(n - i, m - j); a pair for which no shared shingle leaves room for the
    similarity has none. So what strays from a group of copies meets others in its rare shingles alone, not in those that
    the whole group has. Shingles of one label have nothing to add. What stays quadratic is the number of different labels that share a
    shingle which is among the rarest of each of their sets."""
    each = rows.select("rep", "label", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    known = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("df > 1").select("shingle", "df", (F.col("x") != F.col("y")).alias("open"))
    placed = each.join(known, "shingle").groupBy("rep", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "open"))).alias("own"))
    alone = F.col("n") - F.size("own")
    posted = placed.select("rep", "label", "n", alone.alias("alone"), F.posexplode("own").alias("at", "s")).where("s.open")
    posted = posted.select(F.col("s.shingle").alias("shingle"), "rep", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("room")).where(100 * F.col("room") >= PERCENT * F.col("n"))
    # labels meet first, so that members of one label are never paired with each other, however many have the shingle
    posted = written(posted, "posted")
    met = posted.groupBy("shingle", "label").agg(F.min("n").alias("n"), F.max("room").alias("room"))
    a, b = (met.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("label", "n", "room")]) for x in "ab")
    may = (F.col("label_a") < F.col("label_b")) & _similar(F.least("room_a", "room_b"), F.col("n_a"), F.col("n_b"))
    met = a.join(b, (a["shingle"] == b["shingle"]) & may).select(a["shingle"], "label_a", "label_b")
    a, b = (posted.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "label", "n", "room")]) for x in "ab")
    fits = _similar(F.least("room_a", "room_b"), F.col("n_a"), F.col("n_b"))
    pairs = met.join(a, ["shingle", "label_a"]).join(b, ["shingle", "label_b"]).where(fits)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(docs.select("doc_id", features(F.col("text")).alias("f")).select("doc_id", "f.*"), "features")
    classes = found.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")

    posted = classes.select("rep", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").count().where("count > 1")
    own = posted.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("own")).where(F.size("own") >= MATCHES)
    own = written(own.select("rep", F.transform("own", lambda x: x["token"]).alias("tokens")), "posted")
    if own.isEmpty():
        return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))

    ids = own.select("rep")
    few = own.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["rep"]).select("rep", "text")
    if _repeated(found):
        kept = kept.dropDuplicates(["rep"])
    sets = written(kept.select("rep", _set(F.col("text")).alias("set")), "sets")
    alone = sets.select("rep", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).where("n = 1")
    alone = alone.groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    sizes = sets.select("rep", F.size("set").alias("n")).join(alone, "rep", "left").select("rep", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    own = written(own.join(sizes.where(100 * (F.col("n") - F.col("alone")) >= PERCENT * F.col("n")), "rep"), "own")
    lists = own.select("rep", "n", "alone", "tokens", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))).alias("token"))

    heads = lists.groupBy("token").agg(F.min_by("rep", F.struct(F.col("alone") / F.col("n"), "rep")).alias("head"))
    near = lists.select("rep", "token").join(heads, "token").where("rep != head").groupBy("rep", "head").count()
    first = near.groupBy("rep").agg(F.max_by("head", F.struct(F.col("count"), -F.col("head"))).alias("a")).select("a", F.col("rep").alias("b"))
    links = written(_confirmed(first, sets), "first")
    labels = components(links)

    named = lists.join(labels, lists["rep"] == labels["node"], "left").select("token", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("token")
    named = named.join(open_, "token", "left_semi").select("rep", "label").distinct()
    pairs = written(_open_pairs(written(sets.join(named, "rep"), "open")), "pairs")
    agree = own.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), own.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    pairs = pairs.join(agree[0], "a").join(agree[1], "b").where(F.size(F.array_intersect("x", "y")) >= MATCHES).select("a", "b")
    more = written(_confirmed(pairs, sets), "second")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)

    ends = classes.join(labels, classes["rep"] == labels["node"], "left").select("set_key", "copies", F.coalesce("label", "rep").alias("component_id"))
    out = _with_component(found, ends).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_component(found: DataFrame, ends: DataFrame) -> DataFrame:
    """Each row with its class's component. Classes of more than MANY_COPIES rows are few (at most rows / MANY_COPIES) and are sent to
    all tasks, behind a count; rows without a set meet nothing. So no task gets all rows of one key."""
    ends = written(ends, "ends")
    hot = ends.where(F.col("copies") > MANY_COPIES).select("set_key", F.col("component_id").alias("hot"))
    n = hot.count()
    if 0 < n <= BROADCAST_IDS:
        rows = found.join(F.broadcast(hot), "set_key", "left")
    else:
        rows = found.withColumn("hot", F.lit(None).cast("long"))
    done = (F.col("hot").isNotNull()) | F.col("set_key").isNull()
    rest = rows.where(~done).join(ends.select("set_key", "component_id"), "set_key", "left").select("doc_id", "n", "component_id")
    return rest.unionByName(rows.where(done).select("doc_id", "n", F.col("hot").alias("component_id")))


def _repeated(found: DataFrame) -> bool:
    return not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is their component's smallest; of rows with one id, one. Rows with a null id stay."""
    links = written(linked(docs, doc_id, text), "components")
    gone = links.where("not kept").select(F.col("doc_id").alias("gone__")).distinct()
    few = gone.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(gone) if few else gone, docs[doc_id] == F.col("gone__"), "left_anti")
    if not _repeated(links):
        return rows
    (nth,) = fresh(rows, "nth__")
    order = Window.partitionBy(doc_id).orderBy(F.col(text))
    return rows.withColumn(nth, F.when(F.col(doc_id).isNotNull(), F.row_number().over(order))).where(f"coalesce({nth}, 1) = 1").drop(nth)
