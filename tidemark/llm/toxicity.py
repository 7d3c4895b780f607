"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (I), threat (T), target (Y), will (F: what announces a deed), article (D: what makes a name of a word),
negation (N), contrast (B), reporter (R), quote or colon (Q), other (o). Weighted transducers over these symbols are composed into two machines, of which one reads a clause from its
beginning and the other reads what the first has written from the end, so that context counts on both sides of a word. A clause runs
to one of . ! ? ; | or a line break, however long; a colon doesn't end it. From the beginning:
  - target: an insult within REACH words after a target counts for more (i);
  - will: a threat within REACH words after a word of will is announced (W);
  - named: an insult right behind an article ("such an idiot", "the clown") is a name for somebody and counts for more (mark =);
  - negation: what stands within REACH words after a negation, with no contrast between, counts for less (mark -);
  - reported: what follows a reporter in its clause, behind a colon or quote as well, counts for less (mark ~);
  - heaped: a match after an insult of the same clause counts for more (mark +).
From the end:
  - aim: an insult within REACH words before a target counts for more (i); a threat with a target within REACH words behind it, its
    object, is one (t; announced: w, the strongest pattern);
  - unaimed: what is left of threats, such as "they burn wood", is none;
  - reported: what stands in quotes with a reporter after them in the clause counts for less (~).
A clause's score is the sum of the lexical weights of its matches, each times the weights of the path by which it was reached. A
document's score is a logistic function of its clauses' scores alone: their sum, their largest, their density. Documents without
a matched clause get the bias.

The lexicon is a short fixed list with its inflected forms, a few idioms, and what labelled documents teach: words and beginnings of words
(marked *) that stand in toxic documents and hardly in others. A learned entry is a threat if most of its toxic documents have it
behind a word of will, else an insult. The learned entries and the logistic weights come from a sample of at most about SAMPLE
labelled documents of the training part, by a hash of the id; two thirds of it give the lexicon, one third the weights. Texts
of the sample that occur more than once count once. The lexicon has at most LEXICON entries. Every document is scored in whole.

Null text is empty. Rows with a null id or label teach nothing; of several labels of one id the toxic one holds. Without labelled
documents the fixed list and weights are used. More columns stay; one that has the output's name is replaced."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE, LEXICON, REACH, LEAST_SUPPORT = 12_000, 2_000, 4, 6
CUT = 0.3
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool imbecile jerk vermin filth garbage coward creep freak bastard scumbag dimwit halfwit nitwit lowlife degenerate parasite idiota estúpido imbécil basura dummkopf abschaum idiote crétin ordure".split()
THREATS = "kill hurt destroy beat smash stab shoot strangle burn attack punish crush töten schlagen tuer frapper matar golpear".split()
#: Forms that no rule makes.
MORE_THREATS = "beaten shot stabbed stabbing tötet schlägt tue frappe mata".split()
IDIOMS = ["shut up", "drop dead", "go to hell", "piece of trash", "waste of space", "good for nothing"]
TARGETS = "you your yours yourself he she him her his they them their these those people everyone all u du ihr sie dich euch ihn tu te vous toi lui ils elles leur tú te usted ustedes ellos ellas lo los".split()
ARTICLES = "a an the this that such der die das ein eine einen le la un une el los las una".split()
WILL = "will would shall gonna going want must should i'll we'll they'll he'll she'll werde werden will wollen vais va allons voy vamos quiero".split()
NEGATIONS = "not no never don't doesn't isn't aren't won't wouldn't cannot can't without nicht kein keine keinen nie ohne ne pas jamais sans nunca jamás sin".split()
CONTRASTS = "but yet although sondern aber mais pourtant sino pero".split()
REPORTERS = "said says say tells told calls called quoted quotes wrote writes claimed claims reported reports shouted asked sagte sagt nannte schrieb dit appelé écrit dijo dice llamó escribió".split()
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[:\"“”„«»]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_ENDS = ".!?;\n|"
_END = re.compile(f"[{_ENDS}]")


def inflected(word: str) -> set[str]:
    """A word with its regular English endings; those of other languages do no harm, since they spell no word."""
    if word.endswith(("s", "x", "z", "ch", "sh")):
        return {word, word + "es", word + "ed", word + "ing"}
    if word.endswith("e"):
        return {word, word + "s", word + "d", word[:-1] + "ing"}
    return {word, word + "s", word + "ed", word + "ing"}


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight); a pair not listed keeps the symbol and goes to `rest[state]`."""

    def __init__(self, start, moves: dict, rest: dict):
        self.start, self.moves, self.rest = start, moves, rest

    def step(self, state, symbol):
        return self.moves.get((state, symbol)) or (self.rest[state], symbol, 1.0)

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this writes. Built over the reachable pairs of states."""
        start = (self.start, other.start)
        moves, rest, todo, seen = {}, {}, [start], {start}
        symbols = {s for t in (self, other) for _, s in t.moves} | {m[1] for t in (self, other) for m in t.moves.values()} | {"o"}
        while todo:
            pair = todo.pop()
            for s in symbols:
                a, mid, w = self.step(pair[0], s)
                b, out, v = other.step(pair[1], mid)
                moves[pair, s] = ((a, b), out, w * v)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
            rest[pair] = moves[pair, "o"][0]
        return Transducer(start, moves, rest)


def _reach() -> tuple[range, dict[int, int]]:
    """Words for which a mark still holds, and what is left of them a word later."""
    count = range(REACH + 1)
    return count, {k: max(0, k - 1) for k in count}


def forward() -> Transducer:
    """The machine that reads a clause from its beginning."""
    count, down = _reach()
    quotes = {(k, "Q"): (k, "Q", 1.0) for k in count}  # no words
    target = Transducer(0, quotes | {(k, "Y"): (REACH, "Y", 1.0) for k in count} | {(k, "I"): (down[k], "i", 1.5) for k in count if k}, down)
    will = Transducer(0, quotes | {(k, "F"): (REACH, "F", 1.0) for k in count} | {(k, "T"): (down[k], "W", 1.0) for k in count if k}, down)
    named = Transducer(0, {(k, "D"): (1, "D", 1.0) for k in (0, 1)} | {(1, s): (0, s + "=", 1.2) for s in "Ii"}, {0: 0, 1: 0})
    words = ["I", "i", "T", "W", "I=", "i="]
    marked = {(k, s): (down[k], s + "-", 0.4) for k in count if k for s in words}
    negation = Transducer(0, quotes | {(k, "N"): (REACH, "N", 1.0) for k in count} | {(k, "B"): (0, "B", 1.0) for k in count} | marked, down)
    hits = [s + n for s in words for n in ("", "-")]
    reported = Transducer(0, {(k, "R"): (1, "R", 1.0) for k in (0, 1)} | {(1, s): (1, s + "~", 0.5) for s in hits}, {0: 0, 1: 1})
    hits = [s + n for s in hits for n in ("", "~")]
    heaped = Transducer(0, {(0, s): (1, s, 1.0) for s in hits if s[0] in "Ii"} | {(1, s): (1, s + "+", 1.3) for s in hits}, {0: 0, 1: 1})
    return target @ will @ named @ negation @ reported @ heaped


def backward() -> Transducer:
    """The machine that reads what `forward` has written, from the end."""
    count, down = _reach()
    marks = [a + n + r + h for a in ("", "=") for n in ("", "-") for r in ("", "~") for h in ("", "+")]
    quotes = {(k, "Q"): (k, "Q", 1.0) for k in count}
    towards = {(k, a + m): (down[k], b + m, w) for k in count if k for a, b, w in (("I", "i", 1.5), ("T", "t", 1.0), ("W", "w", 2.0)) for m in marks}
    aim = Transducer(0, quotes | {(k, "Y"): (REACH, "Y", 1.0) for k in count} | towards, down)
    unaimed = Transducer(0, {(0, s + m): (0, "o", 0.0) for s in "TW" for m in marks}, {0: 0})
    inside = {(2, s + m): (2, s + m + "~", 0.5) for s in "Iitw" for m in marks if "~" not in m}
    reported = Transducer(0, {(0, "R"): (1, "R", 1.0), (1, "Q"): (2, "Q", 1.0), (2, "Q"): (0, "Q", 1.0)} | inside, {0: 0, 1: 1, 2: 2})
    return aim @ unaimed @ reported


class Scorer:
    """lexicon: (class, word or beginning with *) -> weight. weights: bias, then one for each feature."""

    def __init__(self, lexicon: dict[tuple[str, str], float], weights: list[float] | None = None):
        import ahocorasick

        self.weights = weights
        self.forward, self.backward = forward(), backward()
        self.words = {w: (s, 1.0) for words, s in ((ARTICLES, "D"), (TARGETS, "Y"), (WILL, "F"), (NEGATIONS, "N"), (CONTRASTS, "B"), (REPORTERS, "R"), (':"“”„«»', "Q")) for w in words}
        self.words |= {w: (s, v) for (s, w), v in lexicon.items() if w[-1] != "*"}
        self.begins = {w[:-1]: (s, v) for (s, w), v in lexicon.items() if w[-1] == "*"}
        self.lengths = sorted({len(w) for w in self.begins}, reverse=True)
        self.idioms = [(w, w.replace(" ", "'")) for (_, w) in lexicon if " " in w]
        self.words |= {joined: self.words[w] for w, joined in self.idioms}
        self.finder = ahocorasick.Automaton()
        for _, w in lexicon:
            self.finder.add_word(w.rstrip("*"), (len(w.rstrip("*")), w[-1] == "*"))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return self.words[word]
        for n in self.lengths:
            if len(word) > n and word[:n] in self.begins:
                return self.begins[word[:n]]
        return "o", 1.0

    def clause(self, text: str) -> tuple[float, str]:
        """Its score, and the symbols of what was matched in it."""
        for phrase, joined in self.idioms:
            if phrase in text:
                text = text.replace(phrase, joined)
        read = [self.symbol(word) for word in _TOKEN.findall(text)]
        state, written = self.forward.start, []
        for symbol, value in read:
            state, out, weight = self.forward.step(state, symbol)
            written.append((out, value * weight))
        state, score, seen = self.backward.start, 0.0, []
        for symbol, value in reversed(written):
            state, out, weight = self.backward.step(state, symbol)
            if out[0] in "Iitw":
                score += value * weight
                seen.append(out)
        return score, " ".join(reversed(seen))

    def matched(self, text: str) -> list[tuple[int, int, float, str]]:
        """start, end, score and symbols of each clause in which something is matched. `text` is in lower case."""
        out, upto = [], 0
        for end, (n, begins) in self.finder.iter(text):
            at = end - n + 1
            if at < upto or at and text[at - 1].isalnum() or not begins and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            a = max(upto, 1 + max(text.rfind(c, upto, at) for c in _ENDS))
            stop = _END.search(text, end)
            b = stop.start() if stop else len(text)
            score, seen = self.clause(text[a:b])
            if seen:
                out.append((a, b, score, seen))
            upto = b
        return out

    def features(self, text: str | None) -> list[float]:
        """Functions of the clauses' scores alone, so what a path takes off a match is off the document's score."""
        text = (text or "").lower()
        scores = [r[2] for r in self.matched(text)]
        total, most = sum(scores), max(scores, default=0.0)
        return [min(1.0, total), math.log1p(total), most, math.log1p(1000 * total / (len(text) + 200))]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fixed_lexicon() -> dict[tuple[str, str], float]:
    out = {("I", w): 1.0 for stem in INSULTS for w in inflected(stem)} | {("I", w): 1.0 for w in IDIOMS}
    return out | {("T", w): 1.0 for w in {*MORE_THREATS, *(w for stem in THREATS for w in inflected(stem))}}


#: Where nothing can be learned.
DEFAULT_WEIGHTS = [-5.0, 2.0, 2.0, 1.3, 0.5]


def _grams(text: str) -> dict[str, bool]:
    """The words and beginnings of words in a text, and whether a word of will stands within REACH words before any of them."""
    out: dict[str, bool] = {}
    left = 0
    for w in _WORD.findall(text.lower()):
        if w in _WILL:
            left = REACH
            continue
        if len(w) > 2:
            for g in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)):
                out[g] = out.get(g, False) or left > 0
        left = max(0, left - 1)
    return out


_WILL = frozenset(WILL)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, list[int]] = {}
    frame = lambda: pd.DataFrame([(g, *c) for g, c in counts.items()], columns=["gram", "clean", "toxic", "willed"])
    for batch in batches:
        for text, toxic in zip(batch["text"].tolist(), batch["toxic"].tolist(), strict=True):
            for g, willed in _grams(text or "").items():
                c = counts.setdefault(g, [0, 0, 0])
                c[int(toxic)] += 1
                c[2] += bool(toxic) and willed
        if len(counts) > 500_000:
            yield frame()
            counts = {}
    yield frame()


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("toxic")).where("k is not null and toxic in (0, 1)")
    rows = rows.where(F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(4)) != 2).groupBy("k").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(rows), "k")
    return sample.groupBy(F.xxhash64("text").alias("same")).agg(F.min_by(F.struct("text", "toxic"), "k").alias("r")).select("r.*", "same")


def lexicon(sample: DataFrame) -> dict[tuple[str, str], float]:
    """The fixed list, and the likeliest entries that the sample teaches: a bounded table of counts reaches the driver."""
    grams = "gram string, clean long, toxic long, willed long"
    totals = {t: n for t, n in sample.groupBy("toxic").count().collect()}
    out = fixed_lexicon()
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return out
    rows = sample.select("text", "toxic").mapInPandas(_counted, grams).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "willed")])
    odds = F.log((F.col("toxic") + 0.1) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    rows = rows.where(F.col("toxic") >= LEAST_SUPPORT).withColumn("odds", odds).where("odds > 2.7").orderBy(F.desc("toxic"), "gram").limit(LEXICON)
    found = {r["gram"]: ("T" if 2 * r["willed"] > r["toxic"] else "I", float(r["odds"])) for r in rows.collect()}
    known, context = {w for _, w in out}, {*ARTICLES, *TARGETS, *WILL, *NEGATIONS, *CONTRASTS, *REPORTERS}
    for g in sorted(found, key=len):  # what a shorter beginning explains as well is left out
        stem = g.rstrip("*")
        if g in context or any(stem[:n] + "*" in known for n in range(4, len(stem) + (g[-1] != "*"))):
            continue
        kind, value = found[g]
        out.pop(("T" if kind == "I" else "I", g), None)  # what is learned decides
        out[kind, g] = min(2.0, value / 3)
        known.add(g)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[tuple[str, str], float], list[float]]:
    """The lexicon and the weights, from labels of the training part alone."""
    sample = written(_sample(docs, labels, doc_id, text), "toxic_sample")
    words = lexicon(sample.where(F.pmod("same", F.lit(3)) != 0))

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(words)
        for batch in texts:
            yield pd.Series([scorer.features(t) for t in batch.tolist()])

    rows = sample.where(F.pmod("same", F.lit(3)) == 0).select(features("text"), "toxic").collect()  # at most about SAMPLE / 3 rows of a few numbers
    y = np.asarray([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return words, DEFAULT_WEIGHTS
    return words, _logistic(np.asarray([r[0] for r in rows]), y)


def toxicity(text: Column, model: tuple[dict[tuple[str, str], float], list[float]]) -> Column:
    words, weights = model

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(words, weights)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch.tolist()], dtype=float)

    return score(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "toxicity") -> DataFrame:
    return docs.withColumn(out, toxicity(F.col(text), fitted(docs, labels, doc_id, text)))
