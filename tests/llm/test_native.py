"""Decontamination, license scans and token counts against plain Python."""

import random

import pytest

from brightweir.llm import decontaminate, licenses, token_counts
from brightweir.runtime import new_dir

from .helpers import docs_of, rows


def plain_shingles(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def items_of(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id bigint, text string, h string")


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: [rng.choice(words) for _ in range(n)]
    items = [line(n) for n in (5, 6, 9, 17, 40, 40, 130)] + [["two", "words"], ["one"]]
    docs = []
    for item in items * 4:
        part = list(item)
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = rng.choice(words)
        docs.append(line(rng.randint(0, 400)) + part + line(rng.randint(0, 400)))
    texts = [", ".join(d).title() for d in docs] + ["two WORDS", "one", "", None, "w1 " * 5000]
    wanted = [" ".join(i) for i in items] + ["", None]
    got = decontaminate.contaminated(docs_of(spark, *texts), items_of(spark, *wanted))
    expected = []
    for d, text in enumerate(texts):
        for i, item in enumerate(wanted):
            a, b = plain_shingles(item), plain_shingles(text)
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                expected.append((d, i, len(a), len(a & b)))
    assert len(expected) >= 10
    assert rows(got.select("doc_id", "item_id", "n_shingles", "n_found")) == sorted(expected, key=repr)


@pytest.mark.parametrize("most", [0, 10**6])
def test_small_and_large_benchmarks_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    docs = docs_of(spark, "a b c d e f g h", "x a b c d e f y", "a b c d e f")
    docs = docs.unionByName(docs.where("doc_id = 1").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:])).unionByName(docs)
    got = decontaminate.contaminated(docs, items_of(spark, "a b c d e f"))
    assert rows(got) == [(0, 0, 2, 2, 1.0), (1, 0, 2, 2, 1.0), (2, 0, 2, 2, 1.0)]


def test_empty_tables(spark):
    docs, items = docs_of(spark, "a b c d e"), items_of(spark, "a b c d e")
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(docs, items_of(spark, "", None)).count() == 0


MIT = licenses.TEXTS["MIT"]


def test_licenses_in_other_dress(spark):
    dressed = MIT.upper().replace("\n\n", "\n  \n").replace("LICENSE", "LICENCE").replace(",", " ;").replace("(C) <YEAR> <COPYRIGHT HOLDERS>", "(c) 1999-2004 Someone, Inc.")
    texts = [MIT, dressed, "intro\n" + licenses.NOTICES["MIT"].lower() + "\nLICENSED under CC-BY-NC 4.0\n", MIT + "more", None, "", "Copyright 2001 A", "word " * 100_000]
    docs = docs_of(spark, *texts)
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    got = licenses.scan(docs, licenses.known_licenses(spark)).select("doc_id", "license_id", "notices")
    assert rows(got) == sorted(
        [(0, "MIT", None), (0, "MIT", None), (None, "MIT", None), (1, "MIT", None), (2, None, "CC-BY-NC-4.0,MIT"), *((i, None, None) for i in range(3, 8))], key=repr
    )


@pytest.mark.parametrize("most", [0, 10**6])
def test_ties_and_tables_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
    known = spark.createDataFrame([("B", "Same text"), ("A", "same, TEXT!"), ("C", ""), (None, "x"), ("D", None)], "license_id string, text string")
    got = licenses.scan(docs_of(spark, "same text", "", "x"), known)
    assert rows(got.select("doc_id", "license_id")) == [(0, "A"), (1, None), (2, None)]
    assert licenses.scan(docs_of(spark, "a").where("false"), known).count() == 0


def test_spellings_count_as_the_same(spark):
    pairs = [("licence authorisation", "License Authorization"), ("favour sub-licensing", "favor sublicensing"), ("acknowledgement", "acknowledgment"), ("http://x.org", "https://www.x.org")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(licenses.canonical(df["a"]).alias("a"), licenses.canonical(df["b"]).alias("b")).collect():
        assert r["a"] == r["b"]


def test_rollups_add_up_in_any_order_and_only_once(spark):
    docs = spark.createDataFrame(
        [("a", "en", "one two"), ("a", "en", None), ("a", None, "one"), (None, "de", "Ünï 12!"), ("b", "de", " \t x  y\n")], "source string, lang string, text string"
    )
    count = lambda version, where="true": token_counts.counted(docs.where(where), version)
    rollup = token_counts.Rollup(spark, new_dir(spark, "rollup-test"))
    rollup.commit("one", token_counts.inserted(count("words-1")))
    rollup.commit("two/é", token_counts.deleted(count("words-1", "source = 'b'")))
    for _ in range(3):
        rollup.commit("three", token_counts.revised(count("words-1", "source is null"), count("words-2", "source is null")))
    rollup.commit("none", token_counts.inserted(count("words-1", "false")))
    expected = sorted([("a", "en", "words-1", 2, 2), ("a", None, "words-1", 1, 1), (None, "de", "words-2", 1, 3)], key=repr)
    assert rows(rollup.totals(["one", "two/é", "three", "none"])) == expected
    assert rows(rollup.totals(["three", "none", "one", "two/é"])) == expected
    rollup.fold(["one", "three"], "base")
    assert rows(rollup.totals(["base", "two/é"])) == expected
    assert rollup.totals(["none"]).count() == 0


def test_token_counts_of_words(spark):
    texts = ["", None, "  ", "a", " a b ", "a\xa0b", "x" * 200_000, "ab " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["n"] for r in df.select(token_counts.token_count("words-1").alias("n")).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]
