"""Encoding against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from brightweir.llm import bpe
from brightweir.llm.queries import bpe_digests

from .helpers import docs_of

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = bpe.loaded(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.vocabulary.whole, special_tokens={}
)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x52F, exclude_categories=("Cs", "Cn"))))
def test_ids_equal_the_library(text):
    ids = ENCODER.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert ENCODER.vocabulary.decode(ids) == text.encode()


@pytest.mark.parametrize(
    "text", ["a" * 100_001, "ab" * 30_000, "xyzq" * 9_000, " " * 5_000 + "x", "aab" * 7_001, "é" * 3_001, "<|endoftext|>", " 　\x1c\x85 a"]
)
def test_long_and_odd_texts(text):
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_a_full_store_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    encoder = bpe.Encoder(ENCODER.vocabulary)
    for text in ("one two three four five", "six seven one two", "five four three"):
        assert encoder.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_digests_of_all_rows(spark):
    texts = ["Hello  world, it's 2024!", "", None, "Hello  world, it's 2024!", "Ünïcode — ñ 漢字 🙂" * 50]
    got = {r["doc_id"]: r for r in bpe_digests(docs_of(spark, *texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_digests(docs_of(spark, "x").where("false")).count() == 0
    encoded = bpe.encode(docs_of(spark, *texts), RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
