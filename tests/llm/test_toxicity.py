"""The transducers one by one, their composition, and the machine against a direct search for each match's context."""

import math
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries as q
from tidemark.llm.toxicity import DEFAULT_WEIGHTS, REACH, Scorer, fixed_lexicon

SCORER = Scorer(fixed_lexicon(), DEFAULT_WEIGHTS)
WORD_OF = {"I": "idiot", "T": "kill", "Y": "you", "F": "will", "N": "not", "B": "but", "R": "said", "D": "the", "Q": '"', "o": "plain"}


def direct(symbols):
    """The sum of the weights, by looking around each match."""
    place, words = [], 0  # the number of words before each symbol; quotes are none
    for s in symbols:
        place.append(words)
        words += s != "Q"
    total = 0.0
    for i, s in enumerate(symbols):
        if s not in "IT":
            continue
        near = lambda kind, ks: any(symbols[k] == kind and abs(place[k] - place[i]) <= REACH for k in ks)  # noqa: E731, B023
        before, after = range(i), range(i + 1, len(symbols))
        weight = 1.0
        if s == "I" and (near("Y", before) or near("Y", after)):
            weight *= 1.5
        if s == "T":
            if not near("Y", after):
                continue
            weight *= 2.0 if near("F", before) else 1.0
        if s == "I" and i and symbols[i - 1] == "D":
            weight *= 1.2
        if "I" in symbols[:i]:
            weight *= 1.3
        turn = max((k for k in before if symbols[k] == "B"), default=-1)
        if near("N", range(turn + 1, i)):
            weight *= 0.4
        reported = "R" in symbols[:i]
        mode = 0  # from the end: a reporter, then a quote, opens what was said, the next quote closes it
        for k in range(len(symbols) - 1, i, -1):
            if mode == 0 and symbols[k] == "R":
                mode = 1
            elif symbols[k] == "Q" and mode:
                mode = 2 if mode == 1 else 0
        total += weight * (0.5 if reported or mode == 2 else 1.0)
    return total


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("ITYFNBRDQo"), max_size=18))
def test_the_machine_against_a_direct_search(symbols):
    score, _ = SCORER.clause(" ".join(WORD_OF[s] for s in symbols))
    assert math.isclose(score, direct(symbols), abs_tol=1e-9)


def seen(text):
    return [(round(s, 3), x) for _, _, s, x in SCORER.matched(text.lower())]


def test_each_transducer():
    assert seen("idiot") == [(1.0, "I")]
    assert seen("you are so idiot") == seen("idiots like you") == [(1.5, "i")]  # target, aim
    assert seen("kill them") == [(1.0, "t")] and seen("i will kill you") == [(2.0, "w")]  # aim, will
    assert seen("they burn wood") == seen("you kill weeds") == []  # unaimed
    assert seen("the clown") == [(1.2, "I=")] and seen("you are an idiot") == [(1.8, "i=")]  # named
    assert seen("you are not idiot") == [(0.6, "i-")] and seen("not stupid but worthless") == [(1.7, "I- I+")]  # negation, contrast, heaped
    assert seen("he said: you are idiot") == seen('"you are idiot", she wrote') == [(0.75, "i~")]  # reported
    assert seen("she says he is not an idiot") == [(0.36, "i=-~")]
    assert seen("drop dead") == [(1.0, "I")] and seen("two idiots") == [(1.0, "I")]
    assert seen("stupid pathetic loser") == [(3.6, "I I+ I+")]


def test_the_paths_of_the_given_documents(spark):
    """Matches don't all go by the plain path."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike 'idiot|stupid|moron'").limit(300).collect()
    marks = [m for r in rows for _, _, _, x in SCORER.matched(r["text"].lower()) for m in x.split()]
    assert len(marks) > 300 and sum(m != "I" for m in marks) > 0.15 * len(marks)


def test_paths_decide_the_score():
    high = [SCORER.score(t) for t in ("i will kill you", "we will hurt them all", "idiots like you", "you are an idiot")]
    low = [SCORER.score(t) for t in ("they burn wood", "you kill weeds", "we talked", "")]
    less = [SCORER.score(t) for t in ("you are not an idiot", "he said: you are an idiot")]
    assert min(high) > 0.8 and max(low) < 0.05 and max(less) < min(high) - 0.3


def test_a_clause_runs_to_its_punctuation():
    far = "he said " + "that well " * 4500 + "you idiot"
    assert seen(far) == [(0.75, "i~")] and seen(far + ". you idiot")[1] == (1.5, "i")
    for pad in range(380, 420):
        text = "so it is; " + "he said idiot" + " x" * (pad // 2) + " " * (pad % 2) + " degenerate" + " x" * 600 + " moron. fine"
        ((a, b, score, marks),) = SCORER.matched(text)
        assert (text[a:b].strip(), score, marks) == (text[10:-6], 2.05, "i~ I~+ I~+")
    assert [r[3] for r in SCORER.matched("x " * 500 + "idiot" + " x" * 500 + " moron|trash? no clown")] == ["I I+", "I", "I-"]


def test_learned_threats(spark):
    from tidemark.llm import toxicity

    rows = [(k, f"i will zork{'ed' * (k % 2)} you {k} times", 1) for k in range(30)] + [(100 + k, f"plain words about number {k} things", 0) for k in range(60)]
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    words = toxicity.lexicon(sample)
    assert ("T", "zork*") in words or ("T", "zork") in words
    assert [r[3] for r in Scorer(words, DEFAULT_WEIGHTS).matched("we will zork you; zork wood")] == ["w"]


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in q.op2_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for _, r in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    hit, miss, false = (sum(1 for y, r in held if (y, r["predicted"]) == k) for k in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + miss) > 0.85 and hit / (hit + false) > 0.9


def test_a_clashing_column_is_replaced(spark, odd):
    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("toxicity", q.F.lit("x"))
    out = toxicity.with_toxicity(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    assert out.columns == docs.columns and dict(out.dtypes)["toxicity"] == "double" and out.count() == docs.count()
