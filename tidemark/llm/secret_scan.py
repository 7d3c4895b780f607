"""Secrets in texts, in DataFrame functions alone: fixed patterns, and a battery of randomness tests under a false-discovery bound.

Base kinds: assign, access and hex, each leftmost non-overlapping, failing matches dropped. The kind `random` is added: runs of
at least LEAST of the characters of common encodings. For each the encoding is inferred (the smallest alphabet that holds its
characters) and the battery is run:
  - against randomness: chi-squared uniformity over the alphabet, the runs of characters above and below the alphabet's middle, the
    serial correlation of neighbours, as a product and as coincidences of their distances (1234567890 has one; a key that merely holds
    such a row, with less than a quarter of the coincidences there could be, may pass); a run that fails any of them at z > BATTERY_Z is no random string;
  - against text, at the other end of the same statistics: coincidences of characters (chi-squared is a linear function of their
    number) are Poisson with the rate of words, and their lower tail is one p-value; runs of one character class end as often as
    in words and names, binomially, and their upper tail is the other. Both tails are summed term by term, half of the observed
    value's own probability counting (mid-p), so they hold for short runs too (beyond EXACT expected coincidences, or characters,
    by the normal law). Fisher's method combines them.
The combined p-values, to which the length contributes as much as the look, are held to a false-discovery rate by Benjamini-Hochberg
within each band of lengths over all documents; the ranks come from a table of counts by band and p-value in steps of 1/STEPS
of a decade, a few hundred rows whatever the input. No p-value above the rate is ever a discovery, so plain runs whose repeated
characters alone keep them above it (`most_repeats`) are only counted. `battery` has the figures of every run that is a discovery.
A discovery that base spans cover is left to them; one that reaches beyond them is a span as well, in whole.

Costs grow with the length of a text: offsets are running sums by blocks, pieces of a text are cut from blocks of BLOCK characters.
Null text is empty. Repeated rows are scanned alike. An empty table has no bounds and no spans. More columns stay; those that
have the outputs' names are replaced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match runs to the end of its run of characters, so demanding the length in the pattern leaves the same matches.
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
#: LEAST is the shortest value that any base kind takes for a secret.
LEAST, STEPS, MOST_DECADES, RATE, BATTERY_Z = 8, 20, 15, 0.01, 3.3
_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+"
RUN = _RUN % LEAST
#: Runs of one class, whose class changes once at most, so that only coincidences speak; below PLAIN_BELOW characters `_hopeless` may
#: spare them the battery. Letters of the 16 digits alone aren't among them, they have an alphabet of their own.
PLAIN, PLAIN_BELOW = "^(?![a-f]+$)([A-Z]?[a-z]+|[A-Z]+|[0-9]+)$", 20
#: Where bands of lengths begin. Shorter runs, mostly words, have bands of their own, so longer ones are ranked without them.
EDGES = (12, 16, 20, *(1 << k for k in range(5, 13)))
KINDS = ("assign", "access", "hex", "random")
FOUND = "array<struct<start:int,end:int,size:int,band:int,step:int>>"
#: Characters of a block of text; elements of a block of running sums; up to which sizes tails are summed term by term.
BLOCK, GROUP, EXACT = 1024, 64, 64
#: Alphabets by size, the smallest first; the last two have the characters of both common forms of base 64.
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 62: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 64: "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"}
#: How much likelier than in a uniform string two characters of words coincide; the share of neighbours in words and names that differ in class.
WORDLIKE, CHANGES = 1.73, 0.15


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: what stands in a lambda without depending on its variable is computed for each
    element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grown(values: Column, kind: str, step) -> Column:
    """step(last, x) of an array's first 1, 2, ... elements, `values` being short."""
    return F.aggregate(values, F.array().cast(f"array<{kind}>"), lambda acc, x: F.concat(acc, F.array(step(F.try_element_at(acc, F.lit(-1)), x))))


def _folded(values: Column, kind: str, step) -> Column:
    """The same for arrays of any length. Arrays can't be appended to in place, so this is done by blocks of GROUP elements, and over what
    each block gives. `step` has to be associative and to ignore a null."""

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(GROUP))
        within = F.transform(starts, lambda at: _grown(F.slice(v, at, F.lit(GROUP)), kind, step))
        return let(within, joined)

    def joined(w: Column) -> Column:
        upto = _grown(F.transform(w, lambda b: F.try_element_at(b, F.lit(-1))), kind, step)
        before = F.slice(F.concat(F.array(F.lit(None).cast(kind)), upto), F.lit(1), F.size(w))
        return F.flatten(F.zip_with(w, before, lambda b, t: F.transform(b, lambda x: step(t, x))))

    return let(values.cast(f"array<{kind}>"), blocked)


def running(values: Column) -> Column:
    return _folded(values, "bigint", lambda a, x: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(x, F.lit(0).cast("long")))


def running_max(values: Column) -> Column:
    return _folded(values, "int", lambda a, x: F.greatest(a, x))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, n: Column) -> Column:
    """n characters from `start` (from 0), out of `blocks`."""
    first, last = F.floor(start / BLOCK), F.floor((start + n - 1) / BLOCK)
    joined = F.array_join(F.slice(parts, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.when(n > 0, F.substring(joined, (start - first * BLOCK + 1).cast("int"), n.cast("int"))).otherwise(F.lit(""))


def _found(text: Column, pattern: str) -> Column:
    """array of start, end, match (code points); what lies between two matches gives the offsets."""

    def rows(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
        ends = running(F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).cast("int").alias("start"), e.cast("int").alias("end"), m.alias("match")))

    found = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), rows)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def with_matches(docs: DataFrame, text: str, outs: list[str], run: str = RUN) -> DataFrame:
    """Adds for each kind all matches of its pattern in `text`. Each is a step of its own: nested functions are resolved level by level."""
    for out, pattern in zip(outs, (ASSIGN, ACCESS, HEX, run), strict=True):
        docs = docs.withColumn(out, _found(F.col(text), pattern))
    return docs


def base_spans(assign: Column, access: Column, hexes: Column) -> Column:
    """All base spans by start, then kind, of the matches of each."""
    whole = lambda m: F.length(F.regexp_extract(m["match"], f"^{ASSIGN}$", 2)) >= 8
    spans = lambda rows, rank: F.transform(rows, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    return F.array_sort(F.concat(spans(F.filter(assign, whole), 0), spans(access, 1), spans(hexes, 2)))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a logistic fit that is good to 2e-4 in the middle and in scale in the tail."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _few(x: Column, mean: Column) -> Column:
    """ln of P(X < x) + P(X = x) / 2 of a Poisson variable."""
    terms = F.aggregate(
        F.when(x > 0, F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * mean / j).alias("term"), (a["sum"] + a["term"] * mean / j).alias("sum")),
        lambda a: F.ln(a["sum"] - a["term"] / 2) - mean,
    )
    normal = F.ln(_upper_tail((mean - x) / F.sqrt(mean)))
    return F.when(x >= mean, F.lit(0.0)).when(mean > EXACT, normal).otherwise(F.least(F.lit(0.0), terms))


def _many(x: Column, n: Column, q: float) -> Column:
    """ln of P(X > x) + P(X = x) / 2 of a binomial variable."""
    some = F.when(x > 0, F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.aggregate(some, F.lit(0.0), lambda s, i: s + F.ln((n - x + i) / i)) + x * math.log(q) + (n - x) * math.log(1 - q)
    rest = F.aggregate(
        F.when(x < n, F.sequence(x.cast("int"), F.greatest(n - 1, x).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (n - j) / (j + 1) * (q / (1 - q))).alias("term"), (a["sum"] + a["term"] * (n - j) / (j + 1) * (q / (1 - q))).alias("sum")),
        lambda a: F.ln(a["sum"] - 0.5),
    )
    normal = F.ln(_upper_tail((x - n * q) / F.sqrt(n * q * (1 - q))))
    return F.when(x <= n * q, F.lit(0.0)).when(n > EXACT, normal).otherwise(F.least(F.lit(0.0), first + rest))


def tested(run: Column) -> Column:
    """The battery's figures for a run of characters: size (of its alphabet), sound (no test of randomness fails), decades (-log10 of
    the combined p-value against text)."""
    size = F.lit(64)
    for k in sorted(ALPHABETS, reverse=True)[1:]:
        size = F.when(run.rlike(f"^[{ALPHABETS[k]}]+$"), F.lit(k)).otherwise(size)
    names = F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(a))])
    chars = lambda r, s: F.struct(r.alias("run"), s.alias("size"), F.split(r, "").alias("chars"), F.element_at(names, s).alias("names"))
    codes = lambda c: F.struct(*[c[x].alias(x) for x in ("run", "size", "chars")], F.transform(c["chars"], lambda x: F.instr(c["names"], x).cast("double") - 1).alias("codes"))
    return let(run, lambda r: let(size, lambda s: let(chars(r, s), lambda c: let(codes(c), _sums))))


def _sums(c: Column) -> Column:
    """From run, size, chars, codes: what the tests need, each computed once."""
    n, k, codes = F.length(c["run"]).cast("double"), c["size"].cast("double"), c["codes"]
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    middle = (k - 1) / 2
    counts = F.transform(F.array_distinct(c["chars"]), lambda x: n - F.length(F.replace(c["run"], x)))
    one = lambda x: F.when(x > middle, F.lit(1.0)).otherwise(F.lit(0.0))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(F.abs(one(a) - one(b)).alias("turn"), ((a - middle) * (b - middle)).alias("product")))
    lags = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.pmod(b - a, k))
    equal = lambda d: total(F.transform(F.array_distinct(d), lambda x: (F.size(d) - F.size(F.array_remove(d, x))).cast("double")), lambda x: x * (x - 1) / 2)
    kind = F.translate(c["run"], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A" * 26 + "a" * 26 + "0" * 10 + "----")
    both = F.aggregate(pairs, F.struct(F.lit(1.0).alias("turns"), F.lit(0.0).alias("products")), lambda s, x: F.struct((s["turns"] + x["turn"]).alias("turns"), (s["products"] + x["product"]).alias("products")))
    sums = F.struct(
        n.alias("n"), k.alias("k"), c["size"].alias("size"), total(counts, lambda x: x * x).alias("squares"), total(codes, one).alias("up"), both.alias("both"), let(lags, equal).alias("lags"),
        (F.length(F.regexp_replace(kind, r"(.)\1+", "$1")) - 1).cast("double").alias("changes"),
    )
    return let(sums, _tests)


def _tests(s: Column) -> Column:
    n, k, up = s["n"], s["k"], s["up"]
    uniform = (k / n * s["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
    pq = 2 * up * (n - up)
    runs = (s["both"]["turns"] - (pq / n + 1)) / F.sqrt(F.greatest(F.lit(0.25), pq * (pq - n) / (n * n * (n - 1))))
    serial = s["both"]["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
    pairs = (n - 1) * (n - 2) / 2
    alike = pairs / k
    steady = (s["lags"] - alike) / F.sqrt(F.greatest(F.lit(0.25), alike * (1 - 1 / k)))
    sound = (uniform < BATTERY_Z) & (F.abs(runs) < BATTERY_Z) & (F.abs(serial) < BATTERY_Z) & ((steady < BATTERY_Z) | (s["lags"] <= pairs / 4))
    even = _few((s["squares"] - n) / 2, n * (n - 1) / 2 * WORDLIKE / k)
    mixed = _many(s["changes"], n - 1, CHANGES)
    decades = lambda ln: -(ln + F.ln(1 - ln)) / math.log(10)  # noqa: E731 - Fisher: P(p * q <= x) = x (1 - ln x)
    figures = lambda ln: F.struct(s["size"].alias("size"), F.lit(True).alias("sound"), F.least(F.lit(float(MOST_DECADES)), decades(ln)).alias("decades"))
    return F.when(sound, let(even + mixed, figures)).otherwise(F.struct(s["size"].alias("size"), F.lit(False).alias("sound"), F.lit(0.0).alias("decades")))


def _band(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(k) for k in EDGES]), lambda k: k <= n))


def most_repeats(n: int, size: int, decades: float) -> int:
    """The most repeated characters (length less distinct ones) with which a plain run of n characters can still reach so many decades;
    -1: it can't. A run has as many coincidences as repeated characters or more, and more of them never give more decades."""
    mean, best, term, below = n * (n - 1) / 2 * WORDLIKE / size, -1, 1.0, 0.0
    for c in range(n):
        p = math.exp(-mean) * (below + term / 2)
        if c >= mean or -math.log10(p * (1 - math.log(p))) < decades - 1e-9:
            break
        best, below, term = c, below + term, term * mean / (c + 1)
    return best


def _hopeless(run: Column, n: Column, least) -> Column:
    """Whether a run can't reach the decades that least(n) asks of its length, known without the battery: a plain run with too many
    repeated characters. Its alphabet is taken as 10 for digits, else 26: larger ones give less."""
    digits, letters = (F.array(*[F.lit(most_repeats(k, size, least(k))) for k in range(LEAST, PLAIN_BELOW)]) for size in (10, 26))
    plain = (n < PLAIN_BELOW) & run.rlike(PLAIN)
    most = F.element_at(F.when(run.rlike("^[0-9]"), digits).otherwise(letters), n - (LEAST - 1))
    return F.when(plain, (most < 0) | (n - F.size(F.array_distinct(F.split(run, ""))) > most)).otherwise(F.lit(False))


def _step(t: Column) -> Column:
    """Whole steps of -log10 p; 0 where a test of randomness failed."""
    return F.when(t["sound"], F.floor(t["decades"] * STEPS)).otherwise(F.lit(0)).cast("int")


def discoveries(runs: Column, bounds: dict[int, int]) -> Column:
    """Matches of RUN -> array of start, end, size (of the alphabet), band, step: those that reach the bound of their band. Runs of
    a band without a bound, and those that can't reach theirs, don't take the battery."""
    if not bounds:
        return F.array().cast(FOUND)
    length = lambda x: x["end"] - x["start"]
    bound = lambda band: F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), band)
    least = lambda k: bounds.get(sum(e <= k for e in EDGES), 1 << 30) / STEPS
    hopeful = F.filter(runs, lambda x: bound(_band(length(x))).isNotNull() & ~_hopeless(x["match"], length(x), least))
    row = lambda x, t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t["size"].alias("size"), _band(length(x)).alias("band"), _step(t).alias("step"))
    return F.filter(F.transform(hopeful, lambda x: let(tested(x["match"]), lambda t: row(x, t))), lambda c: c["step"] >= bound(c["band"]))


def fitted(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """For each band of lengths the least step that is a discovery. Each distinct run is tested once. Runs whose p-value is known to be
    above the rate are counted by band alone: no bound is there. At most a few hundred rows of counts reach the driver."""
    sorted_out = lambda m: F.struct(_band(F.length(m)).alias("band"), F.when(~_hopeless(m, F.length(m), lambda k: -math.log10(rate)), m).alias("run"))
    rows = docs.where(F.col(text).rlike(RUN)).select(F.inline(F.transform(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1)), sorted_out)))
    rows = rows.groupBy("band", "run").count()
    rows = rows.select("band", "count", F.when(F.col("run").isNull(), F.lit(0)).otherwise(let(tested(F.col("run")), _step)).alias("step"))
    counts: dict[int, dict[int, int]] = {}
    for band, step, n in rows.groupBy("band", "step").agg(F.sum("count")).collect():
        counts.setdefault(band, {})[step] = n
    out = {}
    for band, steps in counts.items():
        total, seen, best = sum(steps.values()), 0, None
        for step in sorted(steps, reverse=True):
            seen += steps[step]
            if step and 10 ** (-step / STEPS) <= rate * seen / total:
                best = step
        if best is not None:
            out[band] = best
    return out


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", bounds: dict[int, int] | None = None, battery: str | None = None) -> DataFrame:
    """Adds `out`: array of start, rank (of the kind, see KINDS), end, by start, then kind; and under the name `battery`, if given, what the
    battery found, base spans or not: array of start, end, size, band, step. `bounds`: as fitted on these documents, if unset."""
    bounds = fitted(docs, text) if bounds is None else bounds
    names = fresh(docs, "t__", "assign__", "access__", "hex__", "run__", "base__", "hits__", "masked__", "free__")
    t, *found, base, hits, masked, free = names
    # only runs as long as some band with a bound are looked for
    run = _RUN % min((0, *EDGES)[band] or LEAST for band in bounds) if bounds else RUN
    docs = with_matches(docs.withColumn(t, F.coalesce(text, F.lit(""))), t, found, run)
    docs = docs.withColumn(base, base_spans(*map(F.col, found[:3])))
    docs = docs.withColumn(hits, discoveries(F.col(found[3]), bounds))
    # what base spans cover is masked with a character that no run has; hits that reach beyond it stay
    both = (F.size(base) > 0) & (F.size(hits) > 0)
    docs = docs.withColumn(masked, F.when(both, redacted(F.col(t), F.col(base), "\x00", True)))
    outside = lambda parts: F.filter(F.col(hits), lambda c: F.replace(cut(parts, c["start"], c["end"] - c["start"]), F.lit("\x00"), F.lit("")) != "")
    docs = docs.withColumn(free, F.when(F.col(masked).isNotNull(), let(blocks(F.col(masked)), outside)).otherwise(F.col(hits)))
    more = F.transform(free, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    docs = docs.withColumn(out, F.array_sort(F.concat(base, more)))
    if battery:
        docs = docs.withColumn(battery, F.col(hits))
    return docs.drop(*({*names} - {out, battery}))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])))


def evidence(found: Column) -> Column:
    """What the battery found: start:end:alphabet size:decades below 1 of its p-value, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda c: F.concat_ws(":", c["start"], c["end"], c["size"], F.format_number(c["step"] / STEPS, 2))))


def _joined(spans: Column) -> Column:
    """Spans by start -> disjoint ones (start, end), those that overlap or touch being one."""

    def islands(sp: Column, tops: Column) -> Column:
        begins = lambda i: (i == 1) | (F.element_at(sp, i)["start"] > F.element_at(tops, F.greatest(i - 1, F.lit(1))))
        heads = F.filter(F.sequence(F.lit(1), F.size(sp)), begins)
        return let(heads, lambda h: F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda i, after: F.struct(F.element_at(sp, i)["start"].alias("start"), F.element_at(tops, F.coalesce(after - 1, F.size(sp))).alias("end"))))

    return let(spans, lambda sp: let(running_max(F.transform(sp, lambda s: s["end"])), lambda tops: islands(sp, tops)))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", each: bool = False) -> Column:
    """The text with every span (overlapping or touching ones as one) replaced by the mark; `each`: by one mark a character."""

    def kept(parts: Column, gone: Column) -> Column:
        edge = lambda at: F.array(F.struct(at.cast("int").alias("start"), at.cast("int").alias("end")))
        marks = lambda b: F.repeat(F.lit(mark), b["end"] - b["start"]) if each else F.when(b["end"] > b["start"], F.lit(mark)).otherwise(F.lit(""))
        pieces = F.zip_with(F.concat(edge(F.lit(0)), gone), F.concat(gone, edge(F.length(text))), lambda a, b: F.concat(cut(parts, a["end"], b["start"] - a["end"]), marks(b)))
        return F.array_join(pieces, "")

    return F.when(F.size(spans) > 0, let(blocks(text), lambda parts: let(_joined(spans), lambda gone: kept(parts, gone)))).otherwise(text)
