"""Token ids of whole texts as little-endian uint32 bytes, with the public vocabulary files. Nothing is trained.

The ids are those of the tokenizers library's plain call, Tokenizer.from_file(file).encode(text, add_special_tokens=False): a special
token's string inside a text is that token. Two kinds of vocabulary are encoded by faster ways with the same ids, if their
file says that they follow the rules these ways rest on; any other file is left to the library."""

from __future__ import annotations

import base64
import json
import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa

#: Distinct words kept in a Python worker, with eight times as many ids; beyond either it starts anew. Bounds memory, not results.
CACHE_WORDS = 1_000_000
_encoders: dict = {}


def _path(name: str) -> str:
    """`name`: a file of the public tokenizers, or a path to one."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Any vocabulary, by the library alone."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(_path(name))

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Null: an empty text."""
        ids = [self.encode(t or "") for t in texts.to_pylist()]
        return np.frombuffer(b"".join(ids), "<u4"), np.asarray([len(x) // 4 for x in ids], np.int64)


def _rules(name: str) -> dict:
    """What a vocabulary's file says about itself, without its words."""
    with open(_path(name), encoding="utf-8") as f:
        said = json.load(f)
    model = {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said["added_tokens"])
    return {"special": {t["content"]: t["id"] for t in said["added_tokens"]}, "plain": plain, "normalizer": said["normalizer"], "pre_tokenizer": said["pre_tokenizer"], "model": model}


class ByteEncoder(Encoder):
    """A byte-level vocabulary with a ranks file beside it, which holds the same ids and is read several times as fast."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(_ranks(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = _rules(name)["special"]
        self.coder = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @staticmethod
    def fits(name: str) -> bool:
        said = _rules(name)
        pre = said["pre_tokenizer"] or {}
        by_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        return bool(by_bytes and said["plain"] and said["normalizer"] is None and os.path.exists(_ranks(name)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        named = any(s in text for s in self.special)
        return self.coder.encode_to_numpy(text, allowed_special="all" if named else set(), disallowed_special=()).astype("<u4", copy=False).tobytes()


def _ranks(name: str) -> str:
    return _path(name).removesuffix(".json") + ".tiktoken"


class WordEncoder(Encoder):
    """A vocabulary with word ends that lower-cases and drops white space, so a text has the ids of its words in order.

    Texts are cut, as bytes, behind each blank or line end and before a punctuation mark that follows an ASCII letter and is in no
    special token: the tokenizer parts all of these. Arrow numbers the distinct pieces; `held` says where in `pool` the ids of each
    begin (upper 32 bits) and how many they are, and the library is asked once for each new word. Pieces of ASCII characters are
    lower-cased first, as the tokenizer would; not so others (normalizing may join a letter and its accent by case) and what
    may hold a special token."""

    def __init__(self, name: str):
        super().__init__(name)
        from tokenizers import Tokenizer, pre_tokenizers

        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.plain = Tokenizer(self.tokenizer.model)  # the same model; to small ASCII letters the other steps do nothing
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.first = {s.encode()[0] for special in _rules(name)["special"] for s in (special.lower(), special.upper())}
        marks = set(map(ord, string.punctuation)) - set(b"".join(s.encode() for s in _rules(name)["special"]))
        self.marks = np.isin(np.arange(256), list(marks))
        self.lower = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
        self.held: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    @staticmethod
    def fits(name: str) -> bool:
        said = _rules(name)
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "[^\\s\\p{L}\\p{N}]+" in split.get("pattern", {}).get("Regex", "")
        special = all(re.fullmatch(r"[^\sA-Za-z]\S*", s) for s in said["special"])
        return bool(words and special and said["plain"] and steps == ["NFC", "Replace", "Lowercase"] and said["model"].get("end_of_word_suffix") == "</w>")

    def ask(self, words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
        """Their ids in a row, and how many each has. Words of letters go many as one text: each ends with the one id in it that ends
        a word. If there are more such ids (letters that normalizing makes more than letters), and for other words: one by one."""
        small, rest = [], []
        for w in words:
            (small if w.isalpha() and w.islower() else rest).append(w)
        letters = [w for w in rest if w.decode().isalpha()]
        ids, counts = [], {}
        groups = [(self.plain, small)] + [(self.tokenizer, letters[k : k + 256]) for k in range(0, len(letters), 256)]
        for tokenizer, group in groups:
            got = np.asarray(tokenizer.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(group):
                ids.append(got)
                counts.update(zip(group, np.diff(ends, prepend=0).tolist(), strict=True))
        alone = [w for w in words if w not in counts]
        parts = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)]
        counts.update(zip(alone, map(len, parts), strict=True))
        return np.concatenate([*ids, np.fromiter(chain.from_iterable(parts), np.uint32)]), counts

    def learn(self, pieces: list[bytes]) -> None:
        words = [p[:-1] if p[-1] in (32, 10) else p for p in pieces]
        ids, counts = self.ask(list(dict.fromkeys(words)))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at, places = self.used, {}
        for w, n in counts.items():
            places[w] = at << 32 | n
            at += n
        self.used = at
        self.held.update(zip(pieces, map(places.__getitem__, words), strict=True))

    def places(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.held.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        if len(self.held) + len(new) > CACHE_WORDS or self.used > 8 * CACHE_WORDS:
            self.held, self.used, new = {}, 0, range(len(pieces))
            self.pool = np.empty(1 << 16, np.uint32)
        if new:
            self.learn([pieces[k] for k in new])
            for k in new:
                found[k] = self.held[pieces[k]]
        return np.asarray(found, np.int64)

    def pieces(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and with the end of all; their bytes. `offsets`: where texts begin, and the end."""
        low, as_is = np.frombuffer(raw.translate(self.lower), np.uint8), np.frombuffer(raw, np.uint8)
        cut = np.zeros(len(low) + 1, bool)
        np.equal(low, 32, out=cut[1:])
        cut[1:-1] |= self.marks[low[1:]] & (low[:-1] - np.uint8(97) < 26)
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        spare = low >= 128
        for c in self.first:
            spare |= as_is == c
        if spare.any():
            whole = np.logical_or.reduceat(spare, starts[:-1])
            low = np.where(np.repeat(whole, np.diff(starts)), as_is, low)
        return starts, low

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        size = int(offsets[-1] - offsets[0])
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = texts.buffers()[2].slice(int(offsets[0]), size).to_pybytes()
        offsets = offsets - offsets[0]
        starts, low = self.pieces(raw, offsets)
        buffers = [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(low)]
        coded = pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers).dictionary_encode()
        places = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        counts = places & 0xFFFFFFFF
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat((places >> 32) - ends + counts, counts) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(starts, offsets)])

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4", copy=False).tobytes()


def encoder(name: str) -> Encoder:
    """One per Python worker."""
    if name not in _encoders:
        kind = next((k for k in (ByteEncoder, WordEncoder) if k.fits(name)), Encoder)
        _encoders[name] = kind(name)
    return _encoders[name]
