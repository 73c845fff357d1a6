"""Exact groups against brute force, and the tries with hardly any room."""

import hashlib
import random
import re

from brightweir.llm import exact

from .helpers import docs_of, rows


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for body, members in groups.items():
        best = min(members)
        first = True
        for m in sorted(members):
            sha = hashlib.sha256(body.encode()).hexdigest()
            ids = [None if x[1] else x[2] for x in (m, best)]
            out.append((ids[0], ids[1], len(members), m == best and first, sha))
            first = first and m != best
    return sorted(out, key=repr)


def some_docs():
    rng = random.Random(7)
    words = ["a", "ab", "abc", "b", "ba", "é", "漢字", "🙂", "x" * 50]
    texts = [rng.choice([" ", "\n", "", "\t \r", "\x0b\x0c"]).join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(400)]
    texts += ["same  text "] * 60 + ["same text"] * 40 + [None, "", " ", "\xa0", " ", "a\x00b", "a\x00 b"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs + [(3, "again"), (3, "again"), (3, " again"), (None, "again"), (None, None), (None, "no id")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS part", "'x' AS body", "2 AS keep_id")


def test_groups_equal_brute_force(spark):
    docs = some_docs()
    assert rows(exact.exact_groups(frame(spark, docs))) == brute(docs)


def test_colliding_hashes_and_spilled_subtrees_change_nothing(spark):
    docs = some_docs()
    got = exact.exact_groups(frame(spark, docs), text_hash=lambda text: 0, most_bytes=20_000, chunk_rows=11)
    assert rows(got) == brute(docs)


def test_trie_with_random_strings_and_bounds():
    rng = random.Random(1)
    for most in (400, 2_000, 10**9):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(600)] + [b"c" * 5000, b"c" * 4999, b"c" * 5000]
        pending = [(t, "key", (rng.randint(0, 50), i), 1, [i]) for i, t in enumerate(texts)]
        want = {}
        for t, _, owner, _, _ in pending:
            best, n = want.get(t, (owner, 0))
            want[t] = (min(best, owner), n + 1)
        found, rounds = [], 0
        while pending:
            trie, left = exact.OwnerTrie(most), []
            for row in pending:
                left += trie.insert(*row)
            found += list(trie.owners())
            assert len(left) < len(pending) or not left
            pending, rounds = left, rounds + 1
        assert sorted((o, n) for o, n, _ in found) == sorted(want.values())
        assert sorted(p for _, _, parts in found for p in parts) == list(range(len(texts)))
        assert rounds == 1 or most < 10**9


def test_empty_table_and_dropped_copies(spark):
    assert exact.exact_groups(docs_of(spark, "x").where("false")).count() == 0
    kept = exact.drop_copies(docs_of(spark, "one two", "onetwo", "o netwo ", None, "", "three"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


def test_long_texts(spark):
    long = "word " * 300_000
    got = {r["doc_id"]: r for r in exact.exact_groups(docs_of(spark, long, long[:-1], long[:-2] + "x", "word")).collect()}
    assert [got[i]["keep_id"] for i in range(4)] == [0, 0, 2, 3]
