"""Alignment against the two libraries on whole texts and counts by plain loops."""

import collections
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from brightweir.llm import align

from .helpers import docs_of, rows

A_FILE, B_FILE = (align.read_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PAIR = align.TokenizerPair(A_FILE, B_FILE, align.merges_by_rank(A_FILE))
LETTERS = align.byte_letters()


def spans(text):
    """(id, end) of both sides, or nothing."""
    whole = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    of_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    of_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
        return [], []
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    return list(zip(a, ends(of_a), strict=True)), list(zip(b, ends(of_b), strict=True))


def brute(docs):
    aligned, counts = [], collections.Counter()
    for doc_id, text in docs:
        a, b = spans(text or "")
        at_a, at_b = {e: i for i, e in a}, {e: i for i, e in b}
        both = sorted(set(at_a) & set(at_b))
        links = [(at_a[e], at_b[e]) for e in both]
        groups = ";".join(
            ",".join(str(i) for i, e in a if low < e <= high) + "|" + ",".join(str(i) for i, e in b if low < e <= high)
            for low, high in zip([0, *both], both)
        )
        counts.update(links)
        aligned.append((doc_id, len(a), len(b), links, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        [(i, n, m, len(k), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), s) for i, n, m, k, s in aligned], key=repr
    )


ODD = ["  lead", " a  b ", "▁x y", "<s> a <unk> </s> b<|endoftext|> c", "x\x00y z", "ﬁ ﬀ é a", "a\tb\n\n c", "ａｂ ｃ", " ", "　 x", "naïve café d'été, it's 12 o'clock...", "漢字 かな 🙂 x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_libraries(text):
    PAIR.forget()
    (a, b), _ = PAIR.encode([text])
    want_a, want_b = spans(text)
    assert (a.tolist(), b.tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=("Cs", "Cn"))))
def test_pieces_equal_whole_texts(text):
    PAIR.forget()
    (a, b), _ = PAIR.encode([text])
    want_a, want_b = spans(text)
    assert (a.tolist(), b.tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b])


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    words = "the of and a to in is you that it Straße über naïve house, 2024 (x) don't tokenization alignments".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(120)] + ODD + [None, "", "the of", "the of"]
    docs = list(enumerate(texts))
    for options in ({}, {"shards": 3, "salts": 2, "chunk_bytes": 300}):
        got = align.align(docs_of(spark, *texts), A_FILE, B_FILE, **options)
        assert rows(got) == brute(docs)


def test_long_and_repeated_rows_and_null_ids(spark):
    text = "alpha beta, gamma " * 1_000
    df = docs_of(spark, text).union(docs_of(spark, text)).selectExpr("nullif(doc_id, 0) AS doc_id", "text", "'c' AS chunk", "'k' AS keys")
    assert rows(align.align(df, A_FILE, B_FILE)) == brute([(None, text), (None, text)])


def test_without_rows_and_without_links(spark):
    assert align.align(docs_of(spark, "x").where("false"), A_FILE, B_FILE).count() == 0
    assert rows(align.align(docs_of(spark, None, ""), A_FILE, B_FILE)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(2)]


def test_minimal_hash_is_a_bijection_and_knows_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 5_000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 47, n))
        made = align.MinimalHash.read(*align.MinimalHash.of(keys).columns())
        assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
        assert (made.index(keys + (1 << 50)) == -1).all()
        if n == 200_000:
            assert len(made.words) * 64 < 4 * n


def test_merges_by_rank_needs_reachable_tokens_in_order():
    assert PAIR.quick is not None
    spec = json.loads(A_FILE)
    spec["model"]["merges"] = spec["model"]["merges"][1:]  # a token that nothing makes
    assert not align.merges_by_rank(json.dumps(spec).encode())
    spec = json.loads(A_FILE)
    spec["model"]["merges"][300:302] = spec["model"]["merges"][301:299:-1]
    assert not align.merges_by_rank(json.dumps(spec).encode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x7F)))
def test_ascii_pieces_equal_the_library(text):
    assert PAIR.quick.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids
