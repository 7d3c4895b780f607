"""Token counts of every prefix of a text, by dynamic programming over its code points.

A byte-pair encoding is the one sequence of pieces in which each two neighbours, encoded by themselves, stay these two: a merge
across a boundary of the whole text would also be one of the two pieces there. So the encoding of a prefix ends with the one piece
that ends there and follows the last piece of the prefix before it so, and

    tokens(prefix of i) = tokens(prefix of i - length of that piece) + 1        (bytes of a character without a piece: one each)

Where two characters stand side by side in no piece, no piece reaches across. Texts are cut there (a word's mark begins pieces only, in most
vocabularies marks of punctuation stand alone), and a text's counts are those of its parts in a row. A part is solved once in a
worker (HELD of them are kept), new parts in order, so that each goes on from the prefix that it has in common with the one before.

What is stored is the change of the count at each code point (PREFIXES), a byte each in all but strange cases; from it `answered` gives
counts at any prefix, the longest prefix within a budget and the budget's verdict, without the text or its vocabulary.

The counts are those of the sentencepiece library's plain encode(text). Null and empty text: no code points, no tokens. Texts of any length
are read in one pass. Repeated rows, null ids and other columns stay as they are; `out` replaces no column, it must be a new name. An empty
table gives no rows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import _path

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Solved words and neighbours kept in a Python worker; beyond it they are solved anew. Bounds memory, not results.
HELD = 400_000
MARK = "▁"
PREFIXES = "binary"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
ANSWER = "n_tokens long, fit_chars long, fit_tokens long"
_counters: dict = {}


class PrefixCounter:
    """The vocabulary of a sentencepiece BPE model that marks spaces and changes nothing else in a text, as read from the library."""

    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.score = {model.id_to_piece(k): model.get_score(k) for k in plain}
        self.longest = max(map(len, self.score), default=1)
        self.inner = {a + b for p in self.score for a, b in zip(p, p[1:], strict=False)}
        self.by_word = all(p[1] != MARK or p[0] == MARK for p in self.inner)
        probe = " ① é  x\t"
        if "".join(model.encode(probe, out_type=str)).count(MARK) != 1 + probe.count(" ") or model.id_to_piece(model.encode("\x00")[-1]) != "<0x00>":
            raise ValueError(f"{name}: not a vocabulary that marks each space, keeps characters and falls back to bytes")
        self.grown: dict[str, tuple | None] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The definition, for a few characters: the best neighbours become one, the leftmost of equals first. Also the ranks of the
        merges in order, with no more at the end, and the first and the last part before each."""
        parts, score, ranks, first, last = list(text), self.score, [], [text[:1]], [text[-1:]]
        while True:
            pairs = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
            rank, k = min(pairs, default=(np.inf, -1))
            ranks.append(rank)
            if k < 0:
                return parts, ranks, first, last
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            first.append(parts[0])
            last.append(parts[-1])

    def _grown(self, piece: str) -> tuple | None:
        """How a piece comes to be; None: its text is encoded otherwise."""
        if piece not in self.grown:
            parts, *how = self.merged(piece)
            self.grown[piece] = tuple(how) if len(parts) == 1 else None
        return self.grown[piece]

    def _follows(self, pair: tuple[str, str]) -> bool:
        """Whether both pieces come to be before their edges merge: the merges of both in their common order, until one across is due."""
        if len(self.follows) >= HELD:
            self.follows = {}
        left, right = map(self._grown, pair)
        ok = left is not None and right is not None
        if ok:
            (own, _, ends), (others, starts, _), score, i, j = left, right, self.score, 0, 0
            while True:
                x, y, both = own[i], others[j], ends[i] + starts[j]
                if both in score and x > -score[both] <= y:
                    ok = False
                    break
                if x <= y:
                    if x == np.inf:
                        break
                    i += 1
                else:
                    j += 1
        self.follows[pair] = ok
        return ok

    def solved(self, text: str, counts: list[int], last: list[str]) -> None:
        """Makes the lists go on to the end of `text`: tokens of each prefix, from the one of no characters on, and its last piece."""
        score, longest, follows = self.score, self.longest, self.follows
        for end in range(len(counts), len(text) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                piece = text[begin:end]
                if piece not in score:
                    if begin < end - 1:
                        continue
                    more = len(piece.encode("utf-8", "surrogatepass"))
                else:
                    if begin:
                        pair = (last[begin], piece)
                        if not (follows[pair] if pair in follows else self._follows(pair)):
                            follows = self.follows
                            continue
                    elif not self._grown(piece):
                        continue
                    more = 1
                counts.append(counts[begin] + more)
                last.append(piece)
                break
            else:
                raise AssertionError(f"no encoding ends at {end} of {text[:end][-40:]!r}")

    def cut(self, marked: str) -> list[str]:
        """Parts across whose edges no piece reaches."""
        inner = self.inner
        at = [0, *[i for i in range(1, len(marked)) if marked[i - 1 : i + 1] not in inner], len(marked)]
        return [marked] if len(at) == 2 else [marked[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Changes of the count over each word and the mark before it."""
        if len(self.words) > HELD:
            self.words = {}
        if len(self.parts) > HELD:
            self.parts = {}
        words = words.difference(self.words)
        cut = {w: self.cut(MARK + w) for w in words}
        before, counts, last, held = "", [0], [""], self.parts
        for part in sorted({p for parts in cut.values() for p in parts if p not in held}):
            same = len(commonprefix((before, part)))
            del counts[same + 1 :], last[same + 1 :]
            self.solved(part, counts, last)
            held[part] = array("h", map(sub, counts[1:], counts)).tobytes()  # an error, should a change not fit
            before = part
        for w, parts in cut.items():
            self.words[w] = held[parts[0]] if len(parts) == 1 else b"".join([held[p] for p in parts])

    def steps(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the change of the count at each code point. The mark before the first word is not one; it goes with the first."""
        for some in _portions(texts):
            split = [self._words(t) for t in some]
            self.learn(set().union(*split))
            for words in split:
                raw = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int16).astype(np.int64)
                if len(raw):
                    raw[1] += raw[0]
                yield raw[1:]

    def _words(self, text: str) -> list[str]:
        """Words after their marks, so that none stands at an edge."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if not self.by_word:
            return [text]
        return text.split(MARK) if MARK * 2 not in text and text[0] != MARK else [w[1:] for w in _WORD.findall(MARK + text)]


def _portions(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def _counter(name: str) -> PrefixCounter:
    """One per Python worker."""
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def packed(steps: np.ndarray) -> bytes:
    """A byte with the size of an item, then the items, little-endian; small enough for the largest."""
    top = int(np.abs(steps).max(initial=0))
    size = 1 if top < 128 else 2 if top < 1 << 15 else 4
    return bytes([size]) + steps.astype(f"<i{size}").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    """Tokens of each prefix, from the one of no code points on."""
    steps = np.frombuffer(stored, f"<i{stored[0]}", offset=1)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(steps, dtype=np.int64)])


def prefix_counts(text: Column, model: str = MODEL) -> Column:
    """PREFIXES of a text, to be stored beside it."""

    @F.pandas_udf(PREFIXES)
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(packed, _counter(model).steps(texts.tolist()))), dtype=object)

    return counts(text)


def answered(prefixes: Column, limit: int = LIMIT) -> Column:
    """n_tokens of the whole text; fit_chars, the code points of the longest prefix of at most `limit` tokens, and fit_tokens, its tokens."""

    @F.pandas_udf(ANSWER)
    def answers(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for s in stored.tolist():
            counts = unpacked(s)
            if counts[-1] <= limit:
                at = len(counts) - 1
            else:
                at = int(np.flatnonzero(counts <= limit)[-1])
            rows.append((int(counts[-1]), at, int(counts[at])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return answers(prefixes)


def tokens_at(prefixes: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many code points (long); more than there are: of the whole text; null or negative: null."""

    @F.pandas_udf("long")
    def at(stored: pd.Series, upto: pd.Series) -> pd.Series:
        out = []
        for s, k in zip(stored.tolist(), upto.tolist(), strict=True):
            counts = unpacked(s)
            out.append(None if k is None or k != k or k < 0 else int(counts[min(int(k), len(counts) - 1)]))
        return pd.Series(out, dtype="Int64")

    return at(prefixes, chars)


def with_prefix_counts(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", model: str = MODEL) -> DataFrame:
    return docs.withColumn(out, prefix_counts(F.col(text), model))


def truncated(docs: DataFrame, limit: int, text: str = "text", prefixes: str = "prefix_tokens") -> DataFrame:
    """Texts cut to their longest prefix of at most `limit` tokens, with the prefixes' counts cut alike."""
    fit = answered(F.col(prefixes), limit)["fit_chars"].cast("int")
    size = F.conv(F.hex(F.substring(F.col(prefixes), 1, 1)), 16, 10).cast("int")
    cut = F.substring(F.col(prefixes), F.lit(1), 1 + size * fit)
    return docs.withColumns({text: F.substring(F.col(text), F.lit(1), fit), prefixes: cut})
