"""The prefix trie of conversations, from their global order.

A node is a distinct sequence of first turns. Turn arrays are range-sorted over all tasks, so a node's members stand in a row, and the
nodes that two neighbours share are those up to their longest common prefix (LCP). One sweep over a partition's rows holds the open nodes
as a stack: a row closes what lies deeper than its LCP with the row before, and opens what it adds. What is still open at a
partition's edge, and what was open before it, is given out in fragments, named by depth and prefix, which are summed over partitions.
Neighbours across an edge come from the first and last rows of the partitions, a row each.

A conversation can be of any length: it goes in segments of SEGMENT turns, sorted with the prefix before them as leading key (its
digest), so each segment's rows make a trie below one node. What a subtree has in later segments is summed along the conversation
beforehand, for which each node is put down to one member (that whose LCP with its neighbour before is smaller than the
node's depth) and each leaf to the last.

Turns in order of turn (null first), then role, then text; null role or text: empty. Repeated rows are repeated turns. Rows of a null
conversation belong to none. A conversation with no turns is a member of the root alone. Words are parted by white space. Turns are told
apart by 128-bit digests. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, ordered_bucket, ranked, written

#: Turns of a segment; segments whose prefixes are summed at once.
SEGMENT, BLOCK = 64, 1_024
#: Ids in one piece of a list that crosses partitions.
PIECE = 1 << 16
NODES = "depth long, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece long, ids binary, open boolean"
_NAMES = [c.split()[0] for c in NODES.split(", ")]


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn_key, words): each turn's place from 0, digest and words. Places come from ranks within buckets of the turn, so
    that no task holds a whole conversation."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = rows.select("conv", "turn", "role", "text", key.alias("turn_key"), words.alias("words"))
    rows = rows.withColumn("bucket", ordered_bucket(rows, "turn", rows=65_536))
    rows = ranked(rows, ["conv"], "bucket", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "pos")
    return rows.select("conv", "pos", "turn_key", "words")


def rebuilt(turns: DataFrame, convs: DataFrame, share: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of another: conv c begins with the first h turns of c - c % share, h being CRC-32 of its
    decimal id modulo `most`, and goes on with its own after its first h."""
    turns = written(turns, "turns")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    heads = turns.where((F.col("conv") % share == 0) & (F.col("pos") < most - 1))
    sizes = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("have"))
    plan = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % share).alias("head"))
    plan = plan.join(sizes.withColumnRenamed("conv", "head"), "head", "left").select("conv", "head", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("m"))
    first = plan.join(heads.withColumnRenamed("conv", "head"), "head").where(F.col("pos") < F.col("h")).select("conv", "pos", "turn_key", "words")
    own = turns.where(F.col("pos") >= h).join(plan.select("conv", "h", "m"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_key", "words")
    return first.unionByName(own)


def _along(rows: DataFrame, sums: dict[str, Column], combine, backwards: bool = False) -> DataFrame:
    """For each row (conv, seg) the `combine` of a column over the rows before it (`backwards`: after it), in blocks of BLOCK segments:
    within a block, then over the blocks."""
    block, *tops = fresh(rows, "block__", *[f"{c}__" for c in sums])
    way = F.desc if backwards else F.asc
    before = lambda w, c: combine(F.col(c)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(block, F.floor(F.col("seg") / BLOCK)).withColumns(sums)
    totals = rows.groupBy("conv", block).agg(*[combine(F.col(c)).alias(t) for c, t in zip(sums, tops, strict=True)])
    over = Window.partitionBy("conv").orderBy(way(block))
    totals = totals.select("conv", block, *[before(over, t).alias(t) for t in tops])
    inside = Window.partitionBy("conv", block).orderBy(way("seg"))
    rows = rows.withColumns({c: before(inside, c) for c in sums}).join(totals, ["conv", block])
    zero = F.lit(0).cast("long")
    both = {c: F.array(F.coalesce(c, zero), F.coalesce(t, zero)) for c, t in zip(sums, tops, strict=True)}
    add = (lambda x: x[0].bitwiseXOR(x[1])) if combine is F.bit_xor else (lambda x: x[0] + x[1])
    return rows.withColumns({c: add(x) for c, x in both.items()}).drop(block, *tops)


def segments(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, seg, keys, words, more, a, b, next_a, next_b): arrays of at most `segment` turns; a and b name the turns before, next_a and next_b
    those up to and with these."""
    markers = convs.select("conv", F.lit(0).cast("long").alias("seg"), F.lit(None).cast("struct<pos:bigint,turn_key:binary,words:bigint>").alias("t"))
    rows = turns.select("conv", F.floor(F.col("pos") / segment).alias("seg"), F.struct("pos", "turn_key", "words").alias("t")).unionByName(markers)
    rows = rows.groupBy("conv", "seg").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = written(rows.select("conv", "seg", F.col("t.turn_key").alias("keys"), F.col("t.words").alias("words")), "segments")
    names = {c: F.xxhash64(F.lit(c), "seg", "keys") for c in ("a", "b")}
    last = rows.groupBy("conv").agg(F.max("seg").alias("last"))
    rows = _along(rows, names, F.bit_xor).join(last, "conv")
    after = {f"next_{c}": F.col(c).bitwiseXOR(x) for c, x in names.items()}
    return rows.withColumns(after).withColumn("more", F.col("seg") < F.col("last")).drop("last")


ORDER = ["seg", "a", "b", "keys", "more", "conv"]


def with_lcps(rows: DataFrame) -> DataFrame:
    """Adds `lcp` and `next_lcp`, turns of the segment that the neighbour in the global order shares; -1: it belongs to another trie. `part`,
    `at`: the row's partition and place there."""
    rows = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = written(rows.withColumn("part", F.spark_partition_id()), "sorted")
    here = F.struct("seg", "a", "b", "keys", "more", "conv")
    edges = rows.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    whole = Window.orderBy("part")  # a row for each partition
    edges = edges.select("part", F.lag("last").over(whole).alias("before"), F.lead("first").over(whole).alias("after"))
    inside = Window.partitionBy("part").orderBy(*ORDER)
    rows = rows.withColumns({"b4": F.lag(here).over(inside), "af": F.lead(here).over(inside), "at": F.row_number().over(inside)}).join(edges, "part")

    def lcp(other: Column) -> Column:
        same = F.zip_with(F.col("keys"), other["keys"], lambda x, y: x.eqNullSafe(y) & x.isNotNull())
        n = F.array_position(same, False).cast("int")
        found = F.when(n == 0, F.size("keys")).otherwise(n - 1)
        one = (other["seg"] == F.col("seg")) & (other["a"] == F.col("a")) & (other["b"] == F.col("b"))
        return F.when(F.coalesce(one, F.lit(False)), found).otherwise(-1)

    sides = {"lcp": lcp(F.coalesce("b4", "before")), "next_lcp": lcp(F.coalesce("af", "after"))}
    return rows.withColumns(sides).drop("b4", "af", "before", "after")


class _Node:
    """An open node: what its members of this partition add to it."""

    __slots__ = ("depth", "word", "new", "top", "keys", "after", "low", "convs", "children", "leaves", "saved", "ids", "pieces", "held", "shared", "_name")

    def __init__(self, trie: tuple, d: int, keys: list[bytes], word: int, after: tuple, new: bool, segment: int):
        self.depth, self.word, self.new, self.top = trie[0] * segment + d, word, new, d == 0
        self.low, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.pieces, self.held = [], 0, []
        #: others have fragments of it as well, or may have
        self.shared = not new
        # whole segments are named by the digests that the next segment's rows lead with
        self._name = trie[1:] if d == 0 else after if d == segment else (*trie[1:], keys, d)

    @property
    def name(self) -> bytes:
        a, b, *rest = self._name
        out = a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) + self.depth.to_bytes(8, "big")
        return out + hashlib.blake2b(b"".join(rest[0][: rest[1]]), digest_size=16).digest() if rest else out

    def member(self, conv: int) -> None:
        self.convs += 1
        self.low = conv if self.low is None else min(self.low, conv)

    def absorb(self, child: _Node) -> None:
        self.convs += child.convs
        self.leaves += child.leaves
        self.saved += child.saved
        self.low = child.low if self.low is None else min(self.low, child.low)


def _sweep(segment: int):
    """Rows in their order -> nodes, and fragments of nodes that other rows may have a part in."""
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}

    def listed(n: _Node, part: int, out: list[tuple]) -> None:
        if n.ids:
            out.append((n.depth, n.name, None, None, None, 0, 0, 0, 0, None, (part << 32) + n.pieces, ",".join(map(str, n.ids)).encode(), True))
            n.pieces += 1
            n.ids = []

    def closed(n: _Node, parent: _Node | None, part: int, out: list[tuple]) -> None:
        n.saved += n.word * (n.convs - n.new)
        for row in n.held:  # its children, which waited for what it is called
            out.append((*row[:2], n.name, *row[3:]) if n.shared else (*row[:3], row[3], n.low, *row[5:]))
        if n.shared:
            listed(n, part, out)
            sums = (0, n.children, 0, 0) if n.top and n.depth else (n.convs, n.children, n.leaves, n.saved)
            row = (n.depth, n.name, None, n.low, None, *sums, None, None, None, True)
        else:
            digest = hashlib.sha256(",".join(map(str, n.ids)).encode()).hexdigest()
            row = (n.depth, None, None, n.low, None, n.convs, n.children, n.leaves, n.saved, digest, None, None, False)
        if parent is None:
            out.append(row)
        else:
            parent.held.append(row)
            parent.absorb(n)
            if parent.shared:
                parent.held, rows = [], parent.held
                out.extend((*r[:2], parent.name, *r[3:]) for r in rows)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Node] = []
        out: list[tuple] = []
        part = trie = None
        shared_on = -1  # turns of the last row that the next one in the global order has too

        def down_to(depth: int) -> None:
            while len(stack) > depth + 1:
                n = stack.pop()
                closed(n, stack[-1] if stack else None, part, out)

        def partition_ends() -> None:
            down_to(shared_on)
            for n in stack:
                n.shared = True
            down_to(-1)

        def given() -> pa.RecordBatch:
            columns = [pa.array(x, types[c.split()[1]]) for x, c in zip(zip(*out, strict=True), NODES.split(", "), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            for r in batch.to_pylist():
                keys, words, after, lcp = r["keys"], r["words"], (r["next_a"], r["next_b"]), r["lcp"]
                if r["part"] != part:
                    partition_ends()
                elif (r["seg"], r["a"], r["b"]) != trie:
                    down_to(-1)
                else:
                    down_to(lcp)
                part, trie = r["part"], (r["seg"], r["a"], r["b"])
                for d in range(len(stack), len(keys) + 1):
                    new = d > max(lcp, 0)
                    if new:
                        stack[-1].children += 1
                    stack.append(_Node(trie, d, keys, words[d - 1] if d else 0, after, new, segment))
                top = stack[-1]
                top.member(r["conv"])
                top.leaves += r["later_leaves"] + (r["next_lcp"] < len(keys) and not r["more"])
                top.saved += r["later"]
                if r["more"]:
                    top.shared = True
                else:
                    top.ids.append(r["conv"])
                    if top.shared and len(top.ids) >= PIECE:
                        listed(top, part, out)
                shared_on = r["next_lcp"]
            if len(out) > 10_000:
                yield given()
        partition_ends()
        if out:
            yield given()

    return nodes


def trie(conversations: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Nodes of (conv, pos, turn_key, words); `convs` has every conversation once: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rows = written(with_lcps(segments(conversations, convs, segment)), "neighbours")
    every = F.aggregate("words", F.lit(0).cast("long"), lambda x, w: x + w)
    new = F.aggregate(F.slice("words", F.greatest(F.col("lcp"), F.lit(0)) + 1, F.greatest(F.size("words"), F.lit(1))), F.lit(0).cast("long"), lambda x, w: x + w)
    leaf = ((F.col("next_lcp") < F.size("keys")) & ~F.col("more")).cast("long")
    long_ = rows.where((F.col("seg") > 0) | F.col("more")).select("conv", "seg", "more", (every - new).alias("later"), leaf.alias("later_leaves"))
    later = _along(long_, {"later": F.col("later"), "later_leaves": F.col("later_leaves")}, F.sum, backwards=True).where("more").drop("more")
    rows = rows.join(later, ["conv", "seg"], "left").fillna(0, ["later", "later_leaves"])
    rows = rows.repartition("part").sortWithinPartitions("part", "at")
    found = written(rows.mapInArrow(_sweep(segment), NODES), "nodes")
    done, parts = found.where(~F.col("open")), found.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("node").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *sums)
    lists = parts.where(F.col("ids").isNotNull()).select("node", "piece", "ids").repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_digests, "node binary, ends_sha256 string")
    merged = merged.join(lists, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    merged = written(merged, "open_nodes")
    out = ["depth", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = done.select(*out).unionByName(merged.select(*out))
    waits = F.col("parent").isNotNull() & F.col("parent_conv_id").isNull()
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("named"))
    named = every.where(waits).join(names, "parent").withColumn("parent_conv_id", F.col("named")).select(*out)
    return every.where(~waits).unionByName(named).drop("parent").select("conv_id", "depth", *out[3:])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and piece -> the digest of each node's list; no list is held."""
    now, state, out = None, None, []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if now is not None:
        out.append((now, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
