import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, resampling, token_counts
from tidemark.llm import queries as q


def rows_of(spark, sf, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


@pytest.fixture(params=["small", "odd", "empty"])
def at(request, sf, odd, empty):
    return {"small": sf, "odd": odd, "empty": empty}[request.param]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def test_token_counts_are_the_library_s(spark, at, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in q.op11_token_counts(spark, at).collect())
    want = Counter()
    for r in rows_of(spark, at):
        text = r["text"] or ""
        n = len(library.encode(text))
        want[r["doc_id"], len(text.encode()), n, n > 4096] += 1
    assert got == want


@pytest.mark.parametrize("held", [3, token_counts.HELD])
def test_every_prefix_against_the_library(library, monkeypatch, held):
    monkeypatch.setattr(token_counts, "HELD", held)
    monkeypatch.setattr(token_counts._portions, "__defaults__", (40 if held == 3 else 1 << 20,))
    rng = random.Random(4)
    bits = [" ", "  ", "▁", "a", "b", "the", "ing", "\t", "\n", "é", "日", "①", "🙂", "<s>", "</s>", "<0x41>", "\x00", "return ", "x", "1", "23", ".", "(", "//", "==", " " * 16, " " * 9, "　", "ا", "ст", "é", "antidis", "ization"]
    counter = token_counts.PrefixCounter(token_counts.MODEL)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(600)]
    for text, steps in zip(texts, counter.steps(texts), strict=True):
        counts = token_counts.unpacked(token_counts.packed(steps)).tolist()
        assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_pieces_are_the_definition_s(library):
    counter = token_counts.PrefixCounter(token_counts.MODEL)
    for word in ("internationalization", "xyzzy", "antidisestablishmentarianism", "aaaaaaaaaaaa", "日本語テキスト"):
        assert counter.merged("▁" + word)[0] == library.encode(word, out_type=str)


def test_questions_need_no_text(spark, library):
    texts = ["one two three internationalization " * 40, "", None, "日本語🙂① " * 30, "x" * 5000]
    docs = token_counts.with_prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stored = docs.select("doc_id", "prefix_tokens")
    for limit in (0, 1, 50, 10**6):
        for r in stored.select("doc_id", token_counts.answered(F.col("prefix_tokens"), limit).alias("a")).collect():
            text = texts[r["doc_id"]] or ""
            counts = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
            fit = max(i for i, n in enumerate(counts) if n <= limit)
            assert tuple(r["a"]) == (counts[-1], fit, counts[fit])
    at = stored.select("doc_id", token_counts.tokens_at(F.col("prefix_tokens"), F.when(F.col("doc_id") < 3, F.lit(17))).alias("n")).collect()
    assert [r["n"] for r in sorted(at)] == [len(library.encode((texts[k] or "")[:17])) if k < 3 else None for k in range(5)]
    for r in token_counts.truncated(docs, 50).collect():
        cut = r["text"] or ""
        assert len(library.encode(cut)) <= 50 and (texts[r["doc_id"]] or "").startswith(cut)
        assert token_counts.unpacked(bytes(r["prefix_tokens"])).tolist() == [len(library.encode(cut[:i])) for i in range(len(cut) + 1)]


def brute_trie(convs):
    """conv -> list of (key, words); the nodes as the query gives them."""
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = tuple(k for k, _ in turns[:d])
            members[node].append(c)
            words[node] = turns[d - 1][1] if d else 0
        ends[tuple(k for k, _ in turns)].append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.add((min(own), len(node), parent, len(own), len(kids), leaves, sum((len(members[n]) - 1) * words[n] for n in below), digest))
    return out


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_trie_query(spark, at):
    turns = defaultdict(list)
    for r in rows_of(spark, at, "conversations"):
        if r["conv_id"] is not None:
            turns[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    own = {c: [((role, text), n_words(text)) for _, role, text in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + t[h:]
    got = [tuple(r) for r in q.op12_prefix_trie(spark, at).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rebuilt)


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_trie_over_segments_and_partitions(spark, segment):
    """Groups of copies, prefixes of others, no turns at all and long conversations, over more partitions than are usual."""
    rng = random.Random(segment)
    convs = {}
    for c in range(150):
        if c % 3 == 0:
            convs[c] = [("same", 5), ("again", 2), ("end", 1)][: rng.choice((0, 2, 3, 3, 3))]
        elif c % 3 == 1:
            convs[c] = [(rng.choice("ab"), 3) for _ in range(rng.randint(0, 6))]
        else:
            convs[c] = [("long", 4)] * 7 + [(str(rng.randint(0, 1)), 2) for _ in range(rng.randint(0, 12))]
    convs = {c: [(k, len(k) * 2) for k, _ in t] for c, t in convs.items()}
    rows = [(c, p, hashlib.md5(k.encode()).digest(), w) for c, t in convs.items() for p, (k, w) in enumerate(t)]
    turns = spark.createDataFrame(rows, "conv long, pos long, turn_key binary, words long")
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(r) for r in prefix_trie.trie(turns, ids, segment).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])
    assert len(got) == len(set(got)) and set(got) == brute_trie(convs)


def brute_resampled(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w)]
    mine, theirs = [(d, words(t)) for d, t in docs], Counter()
    for t in target:
        theirs.update(feats(words(t)))
    found = [feats(w) for _, w in mine]
    source = Counter(x for f in found for x in f)
    s_all, t_all = sum(source.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in source}
    out = []
    for (d, w), f in zip(mine, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_query(spark, at):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, at)]
    want = brute_resampled(docs, [r["text"] for r in rows_of(spark, at, "benchmark")])
    assert Counter(map(tuple, q.op13_resampling(spark, at).collect())) == want


def test_chunks_own_each_feature_once(spark):
    """Results don't depend on the chunks; repeated rows get ranks of their own, null ids come last among equals."""
    rng = random.Random(8)
    docs = [(None if k % 9 == 0 else k, " ".join(rng.choice(("alpha", "Béta", "gamma3", "x")) for _ in range(rng.choice((0, 1, 2, 19, 20, 21, 90))))) for k in range(120)]
    docs += [(500, "alpha " * 30)] * 40 + [(None, "alpha " * 30)] * 3
    target = ["alpha alpha alpha beta", None, ""]
    df, to = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    want = brute_resampled(docs, target)
    for size in (1, 2, 3, 20, 4096):
        chunks = resampling.chunked(df, size)
        own = chunks.agg(F.sum("own")).first()[0]
        assert own == sum(len(re.findall("[A-Za-z0-9é]+", t)) for _, t in docs)
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resampled(df, to).collect())
    assert got == want
    small = resampling.weighted(resampling.chunked(df, 2), resampling.gains(resampling.chunked(df, 2), resampling.chunked(to.selectExpr("0L doc_id", "text"), 1)))
    whole = Counter({(r["doc_id"], r["n_features"], r["weight"]): r["copies"] for r in small.collect()})
    assert sum(whole.values()) == len(docs) and {(d, n, w) for d, n, w, *_ in want} == set(whole)


def test_lm_scores_by_packs(spark, monkeypatch):
    """Packs of any size give the same scores, and the rows that answers travel in follow the packs, not the texts."""
    import numpy as np
    from tidemark.llm import lm_score

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) % 300) for _ in range(400)]
    docs = [*enumerate(texts), *((1000 + k, t) for k, t in enumerate(texts[:50])), (2000, None), (2001, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    scores = lambda: sorted((r["doc_id"], r["n_words"], r["n_seen"], r["n_backed_off"], round(r["log10_sum"], 9)) for r in lm_score.scored(df).collect())
    want, made, written = scores(), {}, lm_score.written
    monkeypatch.setattr(lm_score, "PACK", 300)

    def counted(table, name):
        out = written(table, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(lm_score, "written", counted)
    assert scores() == want
    packs = sum(len(t.split()) for t in set(texts)) // 300 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(0 < made[f"totals_{k}"] <= lm_score.PARTS // 2 * packs for k in range(lm_score.SLICES))


def test_lm_scores_of_many_copies(spark):
    """2,000 equal rows, and as many of one text under different ids: their n-grams are counted once, and score as the others' evidence."""
    import time

    from tidemark.llm import lm_score

    base = " ".join(f"w{k}" for k in range(600))
    docs = [(1, base)] * 2_000 + [(k, base + " tail") for k in range(10, 2_010)] + [(5_000, "w1 w2 w3 alone"), (5_001, None), (5_002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in lm_score.scored(df).collect()}
    assert time.time() - began < 60 and len(got) == 2_004
    assert spark.createDataFrame([(r["n_words"],) for r in lm_score.scored(df).collect()], "n int").count() == len(docs)
    words = 2_000 * 600 + 2_000 * 601 + 4
    # w1 w2 w3 occur in all texts: each is counted without the row that is scored
    s = math.log10(4_000 / (words - 4)) + math.log10(4_000 / 4_000) + math.log10(4_000 / 4_000) + math.log10(0.4**2 / words)
    assert abs(got[5_000]["log10_sum"] - s) < 1e-9 and got[5_000]["n_seen"] == 3
    assert got[1]["n_seen"] == 600 and got[10]["n_seen"] == 601
    one = lm_score.scored(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), leave_one_out=False).first()
    assert (one["n_seen"], one["n_backed_off"]) == (3, 0) and abs(one["log10_sum"] - math.log10(1 / 3)) < 1e-9
