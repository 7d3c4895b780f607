import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import queries as q


def rows_of(spark, sf, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@pytest.fixture(params=["small", "odd"])
def at(request, sf, odd):
    return {"small": sf, "odd": odd}[request.param]


def shingles(text, fold=lambda b: b.lower()):
    w = fold((text or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, at):
    docs = sorted(rows_of(spark, at), key=lambda r: (r["doc_id"], r["text"] or ""))
    got = defaultdict(list)
    for r in q.op1_fingerprint(spark, at).collect():
        got[r["doc_id"]].append(r)
    off, seen = [], {}
    assert sum(map(len, got.values())) == len(docs)
    for k, d in enumerate(docs):
        text, after = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = next(r for r in got[d["doc_id"]] if r["edited_sha256"] == sha(edited))
        assert r["n_chars"] == len(text)
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for other, name in ((edited, "near_edited"), (after, "near_next")):
            a, b = (shingles(x, lambda b: b.decode().lower().encode()) for x in (text, other))
            off.append(r[name] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(off).max() < 0.3 and np.sqrt(np.mean(np.square(off))) < 0.05


def test_sketches_and_their_union(spark):
    """A sketch against its definition, its estimates against the truth without bias, and the union of two against the union's own."""
    import random

    from tidemark.llm import fingerprints as fp

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pairs = []
    for k in range(60):
        base = [word() for _ in range((40, 300, 4000)[k % 3])]
        cut = len(base) // 3
        pairs.append((k, " ".join(base), " ".join(base[cut:] + [word() for _ in range(cut)])))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    df = fp.sketched(fp.sketched(df, "a", "x"), "b", "y")
    seen = df.select("k", "x", "y", fp.compared(q.F.col("x"), q.F.col("y")).alias("c"), fp.merged(q.F.col("x"), q.F.col("y")).alias("m")).collect()
    wide = spark.createDataFrame([(k, f"{a} | {b}") for k, a, b in pairs], "k int, t string")
    (every,) = (fp.sketched(wide, "t", "s").select("k", "s").collect(),)
    every, texts, off = {r["k"]: r["s"] for r in every}, {k: (a, b) for k, a, b in pairs}, []
    bound = int(-(1 << 63) + fp.FRACTION * 2**64)
    for r in seen:
        a, b = (shingles(t) for t in texts[r["k"]])
        for s, own in ((r["x"], a), (r["y"], b)):
            h = list(s["hashes"])
            assert s["n"] == len(own) and h == sorted(set(h)) and all(v <= s["upto"] for v in h)
            if len(own) <= fp.FLOOR:
                assert len(h) == len(own) and s["upto"] == (1 << 63) - 1
            elif len([v for v in h if v < bound]) < fp.FLOOR:
                assert len(h) == fp.FLOOR and s["upto"] >= bound - 1 and s["upto"] not in h
            else:
                assert s["upto"] == bound - 1
        off.append(r["c"]["likeness"] - len(a & b) / len(a | b))
        have = set(every[r["k"]]["hashes"])  # all hashes of the pair's shingles (and of those across the bar) up to its bound
        m, upto = r["m"], min(r["m"]["upto"], every[r["k"]]["upto"])
        assert {v for v in m["hashes"] if v <= upto} <= have and m["upto"] == min(r["x"]["upto"], r["y"]["upto"])
        assert set(m["hashes"]) == {v for v in (*r["x"]["hashes"], *r["y"]["hashes"]) if v <= m["upto"]}
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.08


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, at):
    docs = rows_of(spark, at)
    got = q.op3_secrets(spark, at).collect()
    assert len(got) == len(docs)
    want = Counter()
    for d in docs:
        t = d["text"] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        spans.sort()
        n = Counter(s[2] for s in spans)
        want[d["doc_id"], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want




def test_battery(spark):
    import random

    from tidemark.llm import secret_scan

    rng = random.Random(3)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(40)]
    words = ["internationalization", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "counterrevolutionaries", "aaaaaaaaaaaaaaaaaaaaaaaa", "0123456789012345678901234567", "thequickbrownfoxjumpsover"] * 20
    docs = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate(keys + words)], "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.with_secrets(docs).where("size(secrets) > 0").collect()}
    assert len([k for k in found if k < len(keys)]) >= 0.9 * len(keys) and not [k for k in found if k >= len(keys)]
    (r,) = secret_scan.with_secrets(spark.createDataFrame([("é token=abcdefgh12 é",)], "text string"), bounds={}).select(secret_scan.redacted(q.F.col("text"), q.F.col("secrets"))).collect()
    assert r[0] == "é [SECRET] é"


def test_short_keys(spark):
    import random
    import string

    from tidemark.llm import secret_scan

    rng = random.Random(4)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (12, 14, 16, 18, 19) for _ in range(40)]
    words = [w for w in ("conversation", "Understandings", "responsibilities", "1234567890123456", "well-established", "counterproductive") for _ in range(40)]
    docs = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate(keys + words)], "doc_id long, text string")
    rows = secret_scan.with_secrets(docs).select("doc_id", secret_scan.listed(q.F.col("secrets"))).where("size(secrets) > 0").collect()
    assert len([r for r in rows if r[0] < len(keys)]) >= 0.8 * len(keys) and not [r for r in rows if r[0] >= len(keys)]
    assert all(r[1] == f"random:4:{4 + len(keys[r[0]])}" for r in rows)


def test_random_runs_beyond_base_spans(spark):
    import random
    import string

    from tidemark.llm import secret_scan

    rng = random.Random(6)
    some = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    key, end = some(40), some(34)
    texts = [f"é {key}AKIAABCDEFGHIJKL+{end} é", f"é token={key} é"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = secret_scan.with_secrets(docs, bounds={4: 1, 5: 1}).select("doc_id", secret_scan.listed(q.F.col("secrets")), secret_scan.redacted(q.F.col("text"), q.F.col("secrets"))).orderBy("doc_id").collect()
    assert [r[2] for r in rows] == ["é [SECRET] é"] * 2
    assert [r[1] for r in rows] == ["random:2:93,access:42:58", "assign:2:48"]


def test_tails_are_those_of_the_laws(spark):
    from tidemark.llm.secret_scan import _few, _many

    poisson = lambda k, m: math.exp(-m) * m**k / math.factorial(k)
    binomial = lambda k, n, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    rows = spark.createDataFrame([(float(x), m) for x in range(6) for m in (0.5, 2.0, 7.5, 30.0)], "x double, m double")
    for r in rows.select("x", "m", _few(q.F.col("x"), q.F.col("m")).alias("p")).collect():
        x = int(r["x"])
        want = sum(poisson(k, r["m"]) for k in range(x)) + poisson(x, r["m"]) / 2 if x < r["m"] else 1.0
        assert math.isclose(math.exp(r["p"]), want, rel_tol=1e-9)
    rows = spark.createDataFrame([(float(x), float(n)) for n in (7, 12, 40, 64) for x in (0, 1, 5, 7)], "x double, n double")
    for r in rows.select("x", "n", _many(q.F.col("x"), q.F.col("n"), 0.15).alias("p")).collect():
        x, n = int(r["x"]), int(r["n"])
        want = sum(binomial(k, n, 0.15) for k in range(x + 1, n + 1)) + binomial(x, n, 0.15) / 2 if x > 0.15 * n else 1.0
        assert math.isclose(math.exp(r["p"]), want, rel_tol=1e-9)


def test_spared_runs_are_no_discoveries(spark):
    """Runs that don't take the battery would not have reached the bound, and letters or digits alone do reach it."""
    import random
    import string

    from tidemark.llm import secret_scan as s

    rng = random.Random(8)
    runs = ["".join(rng.choice(a) for _ in range(n)) for n in range(8, 22) for a in (string.ascii_lowercase, string.ascii_uppercase, string.digits, "abcdef", "01") for _ in range(60)]
    runs += ["".join(rng.sample(a, min(n, len(a)))) for n in range(8, 22) for a in (string.ascii_lowercase, string.ascii_uppercase, string.digits) for _ in range(20)]
    runs += [r.capitalize() for r in runs[:300]]
    df = spark.createDataFrame([(r,) for r in runs if len(r) >= 8], "run string")
    for decades in (0.5, 2.0, 3.0):
        spared = s._hopeless(q.F.col("run"), q.F.length("run"), lambda k, d=decades: d)
        rows = df.select("run", spared.alias("spared"), s.tested(q.F.col("run")).alias("t")).collect()
        assert not [r for r in rows if r["spared"] and r["t"]["sound"] and r["t"]["decades"] >= decades]
        if decades == 2.0:
            over = [r["run"] for r in rows if r["t"]["sound"] and r["t"]["decades"] >= 2]
            assert [r for r in over if r.isdigit() and len(r) < 20] and [r for r in over if r.islower() and len(r) < 20]
    every = {r[0] for r in rows if not r["spared"]} | {r[0] for r in rows if r["spared"]}
    assert every == {r for r in runs if len(r) >= 8}


def test_keys_of_digits_or_letters_alone(spark):
    """Letters without repeats are discoveries, random digits where they reach the band's bound; one that counts up is vetoed."""
    import random
    import string

    from tidemark.llm import secret_scan

    rng = random.Random(10)
    keys = ["".join(rng.sample(string.ascii_lowercase, n)) for n in (18, 19) for _ in range(40)] + ["".join(rng.choice(string.digits) for _ in range(19)) for _ in range(40)]
    docs = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate([*keys, "1234567890123456", "aaaaaaaaaaaaaaaa"])], "doc_id long, text string")
    found = {r[0] for r in secret_scan.with_secrets(docs).where("size(secrets) > 0").select("doc_id").collect()}
    (bound,) = secret_scan.fitted(docs).values()
    steps = docs.select("doc_id", secret_scan.tested(q.F.regexp_extract("text", "see (.*) there", 1)).alias("t")).collect()
    assert found == {r["doc_id"] for r in steps if r["t"]["sound"] and math.floor(r["t"]["decades"] * secret_scan.STEPS) >= bound}
    assert len(found) >= 70 and not found & {len(keys), len(keys) + 1}


def test_planted_keys_in_whole_tables(spark, sf):
    """Keys of no base kind, put into every 25th text of the whole table, are found, and little else."""
    import random
    import string

    from tidemark.llm import secret_scan

    rng = random.Random(7)
    texts = [r["text"] or "" for r in rows_of(spark, sf)]
    keys = {}
    for k in range(0, len(texts), 25):
        keys[k] = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40))
        texts[k] = f"{texts[k][:200]} {keys[k]} {texts[k][200:]}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.with_secrets(docs, battery="b").collect()
    found = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in rows for s in r["secrets"] if s["rank"] == 3}
    planted = set(keys.items())
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.1 * len(planted) + 2
    tried = {(r["doc_id"], s["start"], s["end"]) for r in rows for s in r["b"]}
    assert {(r["doc_id"], s["start"], s["end"]) for r in rows for s in r["secrets"] if s["rank"] == 3} <= tried


def test_offsets_in_a_text_of_many_runs(spark):
    import random

    from tidemark.llm import secret_scan

    rng = random.Random(8)
    text = " ".join("é" * (k % 3) + "".join(rng.choice("0123456789abcdef") for _ in range(32 + k % 5)) for k in range(6000))
    df = spark.createDataFrame([(text,)], "text string")
    (r,) = secret_scan.with_secrets(df, bounds={}).select("secrets", secret_scan.redacted(q.F.col("text"), q.F.col("secrets")).alias("t")).collect()
    assert [(s["start"], s["end"]) for s in r["secrets"]] == [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]
    assert r["t"] == re.sub("[0-9a-f]{32,}", "[SECRET]", text)


def test_lm_scores(spark, at):
    docs = rows_of(spark, at)
    words = [(d["doc_id"], (d["text"] or "").encode().lower().split()) for d in docs]
    gram = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = [[gram(w, n) for n in (1, 2, 3)] for _, w in words]
    all_ = [sum((o[n] for o in own), Counter()) for n in range(3)]
    total = sum(len(w) for _, w in words)

    def logp(o, w, i, n):
        g = tuple(w[i - n + 1 : i + 1])
        have = all_[n - 1][g] - o[n - 1][g]
        if n == 1:
            base = total - len(w)
            return math.log10(have / base if have and base else 1 / total)
        if have:
            c = g[:-1]
            return math.log10(have / (all_[n - 2][c] - o[n - 2][c]))
        return math.log10(0.4) + logp(o, w, i, n - 1)

    want = sorted((d, len(w), round(sum(logp(o, w, i, min(3, i + 1)) for i in range(len(w))), 3)) for (d, w), o in zip(words, own, strict=True))
    got = sorted((r["doc_id"], r["n_words"], r["log10_sum"]) for r in q.op4_lm_score(spark, at).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-3)


def tokens(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(spark, at):
    encode, want = tokens("byte_bpe_50k.json"), Counter()
    for d in rows_of(spark, at):
        ids = encode(d["text"])
        first = len(ids) % 1024 or 1024
        cuts = [(0, min(first, len(ids)))] + [(a, a + 1024) for a in range(first, len(ids), 1024)]
        want.update((d["doc_id"], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(cuts))
    got = q.op5_packing(spark, at).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in bins.values():
        upto = 0
        for offset, n in sorted(spots):
            assert offset == upto
            upto += n
        assert upto <= 1024
    assert len(bins) <= 1 + math.ceil(sum(r["length"] for r in got) / 1024 * 1.03)


def test_plan_fills_bins():
    from tidemark.llm.packing import plan

    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 1025, 50_000).tolist())
    runs, bins = plan(dict(counts), 1024)
    fill = Counter()
    for n, of in runs.items():
        assert sum(r[1] for r in of) == counts[n] and [r[0] for r in of] == [0, *np.cumsum([r[1] for r in of])[:-1]]
        for _, times, first, _ in of:
            for b in range(first, first + times):
                fill[b] += n
    assert len(fill) == bins and max(fill.values()) <= 1024
    assert bins <= 1.01 * max(sum(n * c for n, c in counts.items()) / 1024, sum(c for n, c in counts.items() if n > 512))
    assert plan({}, 8) == ({}, 0) and plan({8: 3, 4: 1, 3: 1, 1: 1}, 8)[1] == 4
    assert plan({5: 1, 3: 1, 2: 2, 1: 1, 6: 1}, 8)[1] == 3


def test_sharding(spark, at):
    docs, got = rows_of(spark, at), q.op6_sharding(spark, at).collect()
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    sizes = [len(shards.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    source, mixed = {d["doc_id"]: d["source"] for d in docs}, defaultdict(Counter)
    for r in got:
        mixed[source[r["doc_id"]]][r["shard"]] += 1
    for c in mixed.values():
        assert max(c.values()) - min(c.get(k, 0) for k in range(24)) <= 2


def test_decontamination(spark, at):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for b in rows_of(spark, at, "benchmark"):
        w = split(b["text"])
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(str(b["item_id"]))
    sizes, want = {len(w) for w in windows}, Counter()
    for d in rows_of(spark, at):
        w, hit, items = split(d["text"]), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    items |= windows[x]
        want[d["doc_id"], len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)] += 1
    assert Counter(map(tuple, q.op7_decontaminate(spark, at).collect())) == want
    assert any(k[5] for k in want)


def test_decontamination_in_passes(spark, odd, monkeypatch):
    want = sorted(map(tuple, q.op7_decontaminate(spark, odd).collect()))
    monkeypatch.setattr(q.decontaminate, "PASS_CHARS", 100)
    assert sorted(map(tuple, q.op7_decontaminate(spark, odd).collect())) == want


def test_passes_are_done_one_by_one(spark, odd, monkeypatch):
    want = sorted(map(tuple, q.op7_decontaminate(spark, odd).collect()))
    monkeypatch.setattr(q.decontaminate, "PASS_CHARS", 300)
    df = q.op7_decontaminate(spark, odd)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, df.collect())) == want


def test_chat(spark, at):
    convs = defaultdict(list)
    for r in rows_of(spark, at, "conversations"):
        convs[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    got = q.op8_chat(spark, at).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    assert all(r["formatted_chars"] >= 15 * r["n_turns"] for r in got)


def test_binary_ids(spark, at):
    encode, start, want = tokens("word_bpe_49k.json"), 0, []
    for d in sorted(rows_of(spark, at), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = encode(d["text"])
        want.append((d["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, q.op9_binary_ids(spark, at).collect())) == sorted(want)


def test_near_duplicates(spark, at):
    sets = defaultdict(set)
    docs = rows_of(spark, at)
    for d in docs:
        sets[d["doc_id"]] |= shingles(d["text"])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = Counter((d["doc_id"], len(sets[d["doc_id"]]), root(d["doc_id"]), root(d["doc_id"]) == d["doc_id"]) for d in docs)
    assert Counter(map(tuple, q.op10_near_dups(spark, at).collect())) == want


def test_all_on_odd_and_empty_tables(spark, odd, empty):
    for name, query in q.queries().items():
        n = query(spark, empty).count()
        assert n == (1 if name == "op8_chat" else 0), name
        assert query(spark, odd).count() > 0, name


@pytest.fixture(scope="module")
def nameless(spark, odd, tmp_path_factory):
    """Null and equal ids, nulls in every column."""
    out = tmp_path_factory.mktemp("nameless")
    rows = [(None, "words of a text that has no id at all", None, None, None), (None, None, None, None, None), (None, "words of a text that has no id at all", "en", "s", 1)]
    rows += [(5, f"text {k} of id five, which has several of them", None, "s", None) for k in range(3)] + [(5, None, None, None, None), (6, "secret=abcdefgh12345 idiot", "en", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(None, "words of a text that has no id at all"), (None, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (6, None, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (1, None, None, "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


def test_sizes_change_no_result(spark, odd, monkeypatch):
    """What is sent to all tasks, how many passes, packets, parts and files there are: the same rows."""
    names = ("op4_lm_score", "op9_binary_ids", "op10_near_dups", "op1_fingerprint", "op5_packing")
    run = lambda: {n: Counter(map(tuple, q.queries()[n](spark, odd).drop("sequence_id", "offset").collect())) for n in names}
    want = run()
    monkeypatch.setattr(q.lm_score, "FREQUENT", 3)
    monkeypatch.setattr(q.lm_score, "SLICES", 2)
    monkeypatch.setattr(q.lm_score, "HALVES", 1)
    monkeypatch.setattr(q.lm_score, "PACKET", 50)
    monkeypatch.setattr(q.binary_ids, "FILE_BYTES", 20_000)
    monkeypatch.setattr(q.near_dups, "MANY_COPIES", 1)
    monkeypatch.setattr(q.fingerprints, "BUCKET_ROWS", 2)
    assert run() == want


def test_null_and_equal_ids(spark, nameless):
    docs = Counter(r["doc_id"] for r in rows_of(spark, nameless))
    for name, query in q.queries().items():
        rows = query(spark, nameless).collect()
        if name == "op8_chat":
            assert {r["conv_id"]: r["n_turns"] for r in rows} == {None: 2, 1: 1, -1: 2}
        elif name == "op12_prefix_trie":  # conversation 1 takes its first three turns from one that isn't there, and has one
            assert [(r["conv_id"], r["depth"], r["n_convs"]) for r in rows] == [(1, 0, 1)]
        elif name != "pipeline":
            assert Counter(r["doc_id"] for r in rows) == docs, name
    near = {(r["doc_id"], r["component_id"], r["kept"]) for r in q.op10_near_dups(spark, nameless).collect() if r["doc_id"] is None}
    assert near == {(None, None, True)}
    leaks = Counter((r["doc_id"], r["n_hit"] > 0, r["n_items"]) for r in q.op7_decontaminate(spark, nameless).collect() if r["doc_id"] is None)
    assert leaks == {(None, True, 0): 2, (None, False, 0): 1}  # items without an id hit, and are not named
    ids = sorted(((r["start"], r["n_tokens"]) for r in q.op9_binary_ids(spark, nameless).collect()))
    assert [a for a, _ in ids] == [0, *np.cumsum([n for _, n in ids])[:-1].tolist()]


def test_columns_of_the_outputs_names_are_replaced(spark, odd):
    from tidemark.llm import decontaminate, secret_scan, sharding

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    n = docs.count()
    clash = docs.select("*", *[q.F.lit("x").alias(c) for c in ("secrets", "battery", "contamination", "shard", "slot", "t__", "base__", "nth__")])
    out = secret_scan.with_secrets(clash, bounds={}, battery="battery")
    assert out.columns == clash.columns and out.where("size(secrets) >= 0 and size(battery) = 0").count() == n
    out = decontaminate.with_contamination(clash, spark.read.parquet(f"{odd}/benchmark.parquet"))
    assert sorted(out.columns) == sorted(clash.columns) and out.where("contamination.n_words >= 0").count() == n
    out = sharding.interleaved(clash, 3)
    assert sorted(out.columns) == sorted(clash.columns) and out.where("shard between 0 and 2 and slot >= 0").count() == n


def test_pipeline(spark, odd):
    """Each stage against what its operator, checked above, says of its input; the last against the library's ids."""
    import corpus_pipeline as c
    from tidemark.llm import decontaminate, near_dups, secret_scan, toxicity

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    tables = [docs]
    for _, stage in c.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], odd))
        assert tables[-1].schema == docs.schema
    rows = [Counter((r["doc_id"], r["text"]) for r in t.collect()) for t in tables]
    labels, bench = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = toxicity.with_toxicity(tables[0], labels, out="score").collect()
    assert rows[1] == Counter((r["doc_id"], r["text"]) for r in scores if r["score"] < toxicity.CUT) and 52 not in {d for d, _ in rows[1]}
    kept = {r["doc_id"] for r in near_dups.linked(tables[1]).collect() if r["kept"]}
    assert set(rows[2]) == {x for x in rows[1] if x[0] in kept} and set(rows[2].values()) == {1}
    found = decontaminate.with_contamination(tables[2], bench, out="found").collect()
    assert rows[3] == Counter((r["doc_id"], r["text"]) for r in found if not r["found"]["n_hit"])
    spans = {r["doc_id"]: (r["text"], r["s"]) for r in secret_scan.with_secrets(tables[3], out="s").collect()}
    for doc, text in rows[4]:
        before, s = spans[doc]
        upto, out = 0, []
        for start, end in sorted((x["start"], x["end"]) for x in s):
            if start > upto or not out:
                out += [before[upto:start], "[SECRET]"]
            upto = max(upto, end)
        assert text == (None if before is None else "".join([*out, before[upto:]]))
    encode, want = tokens("byte_bpe_50k.json"), Counter()
    for doc, text in rows[4]:
        ids = encode(text)
        first = len(ids) % 1024 or 1024
        want.update((doc, k, crc(ids[a:b])) for k, (a, b) in enumerate([(0, min(first, len(ids)))] + [(a, a + 1024) for a in range(first, len(ids), 1024)]))
    out = c.run(spark, odd).collect()
    assert Counter((r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in bins.values():
        spots.sort()
        assert [o for o, _ in spots] == [0, *np.cumsum([n for _, n in spots])[:-1].tolist()] and sum(n for _, n in spots) <= 1024
