"""Base scores by counting, and the trie against a plain recursion."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightweir.llm import lm

from .helpers import docs_of

TEXTS = ["the cat sat on the mat", "The  hat\tthe cat", None, "", "a dog sat", "zzz the öl " * 40, "a dog sat", "x" * 5000]
HELD = [False, True, False, True, False, True, False, None]


def words_of(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("order", [0, 2, lm.ORDER])
def test_scores_equal_plain_counting(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    docs = docs_of(spark, *TEXTS)
    held = F.element_at(F.array(*[F.lit(h) for h in HELD]), F.col("doc_id").cast("int") + 1)
    docs = docs.withColumn("held_out", held)
    got = {r["doc_id"]: r for r in lm.score(docs.repartition(3), order).collect()}
    counts = Counter(w for t, h in zip(TEXTS, HELD) if not h for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(TEXTS)
    for i, (text, h) in enumerate(zip(TEXTS, HELD)):
        words = words_of(text)
        row = got[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (bool(h), len(words), n)
        assert row["n_known"] == sum(w in counts for w in words)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))


def test_no_training_rows_and_no_rows(spark):
    docs = docs_of(spark, "a b").withColumn("held_out", F.lit(True))
    row = lm.score(docs).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0
    assert row["score"] == pytest.approx(-5 * math.log10(lm.SYMBOLS))
    assert lm.score(docs.where("false")).count() == 0


def test_counts_of_nodes_are_exact(spark):
    key = lambda s: (len(s) << 56) | int.from_bytes(s, "big")
    longest = spark.createDataFrame([(key(b" a"), 7), (key(b" ab"), 7), (key(b"aba"), 2), (key(b"zz"), 0)], "gram bigint, n bigint")
    grams = {r["key"]: r["n"] for r in lm.text_grams(longest, 2).collect()}
    shorter = {b"a": 9, b"b": 7, b" a": 7, b"ab": 7, b"ba": 2, b" ab": 7, b"aba": 2}
    assert grams == {key(k): n for k, n in shorter.items()}
    nodes = {r["key"]: (r["n"], r["t"], r["q"], r["x"]) for r in lm.linked(lm.text_grams(longest, 2)).collect()}
    assert nodes[0] == (0, 16, 2, 0)
    assert nodes[key(b"a")] == (9, 7, 1, 7)
    assert nodes[key(b"ab")] == (7, 2, 1, 2)


def test_sums_of_grams_wait_for_one_another(monkeypatch):
    texts = [lm.spoken([b"abc", b"abd"]), lm.spoken([b"abc"])] * 5
    plain = Counter(k for part in lm.text_keys(*lm.laid_out(texts), 3) for k in part.to_pylist() if k >= 0)
    monkeypatch.setattr(lm, "LOOSE_GRAMS", 3)
    monkeypatch.setattr(lm, "SLICE_SYMBOLS", 7)
    found = lm.Grams(3)
    found.add(texts[:4], True)
    found.add(texts[4:], True)
    found.add([lm.spoken([b"new"])], False)
    keys, n = found.rows()
    assert (np.diff(keys) > 0).all()
    assert {k: c for k, c in zip(keys.tolist(), n.tolist()) if c} == plain
    assert (n == 0).sum() > 0


def plain_text_logp(text, training, order):
    """PPM with method D and exclusion, from the definition."""
    line = lambda t: b" " + b"".join(w + b" " for w in words_of(t))
    follow = {}
    for padded in map(line, training):
        for i in range(1, len(padded)):
            for j in range(min(i, order) + 1):
                follow.setdefault(padded[i - j : i], Counter())[padded[i]] += 1
    padded, total = line(text), 0.0
    for i in range(1, len(padded)):
        excluded = set()
        for j in range(min(i, order), -1, -1):
            symbols = follow.get(padded[i - j : i])
            if symbols is None:
                continue
            live = {s: n for s, n in symbols.items() if s not in excluded}
            if padded[i] in live:
                total += math.log10((2 * live[padded[i]] - 1) / (2 * sum(live.values())))
                break
            if live:
                total += math.log10(len(live) / (2 * sum(live.values())))
            excluded |= set(symbols)
        else:
            total -= math.log10(lm.SYMBOLS - len(excluded))
    return total


@pytest.mark.parametrize("order, symbols", [(0, 7), (2, 50), (lm.ORDER, 64), (6, 4 << 20)])
def test_contexts_across_words_equal_plain_counting(spark, monkeypatch, order, symbols):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    monkeypatch.setattr(lm, "SLICE_SYMBOLS", symbols)
    held = F.element_at(F.array(*[F.lit(h) for h in HELD]), F.col("doc_id").cast("int") + 1)
    docs = docs_of(spark, *TEXTS).withColumn("held_out", held)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(3), order).collect()}
    training = [t for t, h in zip(TEXTS, HELD) if not h]
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain_text_logp(text, training, order))


def test_shuffled_words_score_lower(spark):
    docs = docs_of(spark, "the cat sat on the mat by the door", "door mat the the by on cat sat the", "the cat sat on the mat by the door")
    docs = docs.withColumn("held_out", F.col("doc_id") < 2)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    assert got[0] > got[1] + 1
    empty = docs_of(spark, "a b").withColumn("held_out", F.lit(True))
    assert lm.score(empty).first()["score"] == pytest.approx(-5 * math.log10(lm.SYMBOLS))
    assert lm.score(empty.where("false")).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 3, 50])
def test_slices_give_the_same_grams(monkeypatch, symbols):
    flat, starts = lm.laid_out([lm.spoken(words) for words in ([], [b"ab", b"c"], [b"x" * 30])])
    grams = lambda: [k for part in lm.text_keys(flat, starts, 5) for k in part.to_pylist()]
    whole = grams()
    monkeypatch.setattr(lm, "SLICE_SYMBOLS", symbols)
    assert grams() == whole
