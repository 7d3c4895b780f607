"""Ids by words against the library's ids of whole texts."""

import json
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import binary_ids
from tidemark.llm.tokens import ByteEncoder, Encoder, WordEncoder, encoder

ODD = ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|> <|endoftext|>", "<|EndOfText|>x", "<|endoftext", "", "  ", "\t x y", "\x00 a", "word, x. é. É,", "don't's's", "<|endoftext|> a", "ΣΑΣ Σ", "é x́", "가 각", "a|b | c"]
#: Letters that lower-casing or normalizing makes more than letters, so the word-end count differs from the words' count.
NOT_ONE = ["a İx b", "שׁ x", "İ"]


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", WordEncoder), ("byte_bpe_50k.json", ByteEncoder)])
def test_ids_are_those_of_the_plain_call(name, kind):
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    coder, plain = encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
    assert type(coder) is kind
    for text in texts + ODD + NOT_ONE:
        whole = plain.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == np.asarray(whole, "<u4").tobytes(), text[:50]


def test_other_rules_are_left_to_the_library(tmp_path):
    said = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    said["normalizer"]["normalizers"].pop()  # no lower-casing
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    coder = encoder(str(path))
    assert type(coder) is Encoder
    assert coder.encode("Some Words") == np.asarray(Tokenizer.from_file(str(path)).encode("Some Words", add_special_tokens=False).ids, "<u4").tobytes()


def test_a_full_cache_starts_anew(monkeypatch):
    coder = WordEncoder("word_bpe_49k.json")
    first = coder.encode("Some words, and more.")
    monkeypatch.setattr("tidemark.llm.tokens.CACHE_WORDS", 1)
    assert coder.encode("other things") and coder.encode("Some words, and more.") == first


def test_texts_at_once_have_the_ids_of_each():
    """Nulls, parts of arrays and random texts in which marks, accents, cases, white space and special tokens meet."""
    rng = random.Random(7)
    signs = [*"aAtThHsSwWjJI  \n\n\t\r.,;!'-_<>|/$019", *"éÉßİΣςK가日🙂½—’", "́", "̇", "̈", "̱", " ", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "the", "The", "x,", "é.", "###"]
    texts = [*ODD, None, "", *NOT_ONE, *("".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(1500)), None]
    coder, plain = encoder("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for a, b in ((0, len(texts)), (3, 40), (40, len(texts) - 5)):
        ids, lengths = coder.encode_all(pa.array(texts, pa.string()).slice(a, b - a))
        assert lengths.tolist() == [len(w) for w in want[a:b]]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want[a:b]
    for kind in (pa.large_string(), pa.string()):
        assert [x.tolist() for x in coder.encode_all(pa.array([None, ""], kind))] == [[], [0, 0]]


def test_a_word_is_asked_for_once_whatever_its_case_and_marks(monkeypatch):
    coder, asked = WordEncoder("word_bpe_49k.json"), []
    ask = coder.ask
    monkeypatch.setattr(coder, "ask", lambda words: asked.extend(map(str, words)) or ask(words))
    coder.encode("Theme### of THEME$$$ theme!! and theme, (theme)\ntheme. Theme theme&&& THEME; theme")
    assert len([w for w in asked if "theme" in w.lower()]) == 2  # the bare word, and the one behind a bracket


def test_blocks_do_not_depend_on_batches(monkeypatch):
    """Blocks end with the document that fills them, and hold every document once, however the rows come."""
    monkeypatch.setattr(binary_ids, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(binary_ids, "BLOCK_IDS", 40)
    docs = [(None, None), (1, "a " * 100), *((k, f"words of text {k}, " * (k % 7)) for k in range(2, 60)), (60, "")]
    rows = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc", "text"])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t in docs]

    def blocks(slice_bytes, *cuts):
        monkeypatch.setattr(binary_ids, "SLICE_BYTES", slice_bytes)
        parts = [rows.slice(a, b - a) for a, b in zip((0, *cuts), (*cuts, len(docs)), strict=True)]
        return [b.to_pylist()[0] for b in binary_ids._blocks(iter(parts), "word_bpe_49k.json", 2)]

    first = blocks(10**6)
    assert first == blocks(1) == blocks(150, 1, 2, 30) == blocks(10**6, 0, 7, 7)
    assert [d for b in first for d in b["doc_ids"]] == [d for d, _ in docs] and [b["block"] for b in first] == list(range(len(first)))
    ids = [binary_ids.unpack_words(np.frombuffer(b["words"], "<u8")).tolist() for b in first]
    assert [x[s : s + n] for b, x in zip(first, ids, strict=True) for s, n in zip(b["starts"], b["lengths"], strict=True)] == want
    assert all(b["n_ids"] - b["lengths"][-1] < 40 <= b["n_ids"] for b in first[:-1]) and {b["part"] for b in first} == {3}
    assert [b["start_in_part"] for b in first] == np.cumsum([0] + [b["n_ids"] for b in first])[:-1].tolist()
