"""Collocations against counts by plain loops."""

import collections
import random
import re

from brightweir.llm import phrases

from .helpers import docs_of, rows

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def brute(docs, least, per_lang, share=(80, 100), scale=2_000_000):
    f, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: n for g, n in counts.items() if n >= least}
        gone = set()
        for g, n in often.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    part = g[i : i + size]
                    if share[1] * n >= share[0] * often[part]:
                        gone.add(part)
        found = []
        for g, a in often.items():
            if len(g) > 1 and g not in gone:
                score, _, left, right = min((scale * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def some_docs():
    rng = random.Random(11)
    words = ["The", "cat", "sat", "Été", "漢字", "a", "b", "x\x1cy", "dog's", "(of)", "\xa0"]
    docs = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", None, "und"])
        parts = [rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\x0b"]) + w for w in rng.choices(words, k=rng.randint(0, 25))]
        docs.append((lang, "".join(parts)))
    passage = " ".join(f"word{i}" for i in range(40))
    docs += [("en", f"{rng.choice(words)} {passage} {rng.choice(words)}") for _ in range(12)]
    docs += [("en", passage)] * 3 + [("fr", " ".join(["ab"] * 30))] * 4 + [("en", None), (None, ""), ("en", " .,; "), ("es", "once only")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(3)


def test_collocations_equal_brute_force(spark):
    docs = some_docs()
    got = phrases.collocations(frame(spark, docs), min_count=6, per_lang=50, bits=18)
    assert rows(got) == brute(docs, 6, 50)


def test_full_pruning_table_and_short_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PATH_EDGES", 5)
    docs = some_docs()
    got = phrases.collocations(frame(spark, docs), min_count=8, per_lang=1_000, bits=3)
    assert rows(got) == brute(docs, 8, 1_000)


def test_paths_compact_a_shared_passage(spark, monkeypatch):
    passage = [f"w{i}" for i in range(30)]
    docs = [("en", f"head{i} {' '.join(passage)} tail{i}") for i in range(10)]
    found, _ = phrases.phrase_counts(frame(spark, docs), 5, bits=16)
    for edges in (1_000, 4):
        monkeypatch.setattr(phrases, "PATH_EDGES", edges)
        paths = phrases.repeated_paths(found, phrases.through_nodes(found))
        pieces = sorted(paths.collect(), key=lambda r: r["piece"])
        assert len({r["start"] for r in pieces}) == 1 and {r["cnt"] for r in pieces} == {10}
        assert " ".join([pieces[0]["start"], *(r["words"] for r in pieces if r["words"])]).split() == passage
        inner = sorted(r["gram"] for r in phrases.expanded(paths).collect())
        assert inner == sorted(" ".join(passage[i : i + 3]) for i in range(1, 27))


def test_no_rows_and_nothing_frequent(spark):
    assert phrases.collocations(docs_of(spark, "a b").where("false"), min_count=1, bits=10).count() == 0
    assert phrases.collocations(docs_of(spark, "a b", None, ""), min_count=2, bits=10).count() == 0
    assert rows(phrases.collocations(docs_of(spark, "a b"), min_count=1, bits=10)) == brute([("en", "a b")], 1, 10)


def test_large_counts_stay_exact(spark):
    found = spark.createDataFrame([("en", "x y", 2, 10**15), ("en", "x", 1, 10**15 + 1), ("en", "y", 1, 10**15 + 2)], "lang string, gram string, size int, cnt bigint")
    got = phrases.scored(found.where("size = 2"), found, 2_000_000).collect()[0]
    assert got["score"] == 2_000_000 * 10**15 // (2 * 10**15 + 3)
