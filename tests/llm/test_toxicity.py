"""Automata against edit distances, context windows, and held-out accuracy."""

import random

import pytest

from brightweir.llm import toxicity
from brightweir.llm.common import table
from brightweir.llm.queries import QUERIES

from .helpers import docs_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


TERMS = [toxicity.Term("idiot", False, 5.0), toxicity.Term("disgusting", False, 4.0), toxicity.Term("bad", False, 3.0), toxicity.Term("moron", False, 2.0), toxicity.Term("scum", True, 1.5)]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(4)
    automaton = toxicity.LexiconAutomaton(TERMS)
    words = set()
    for term in TERMS:
        for _ in range(400):
            letters = list(term.text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "d"])
            words.add("".join(letters))
    for word in words:
        within = [t.weight * 0.75 ** distance(word, t.text) for t in TERMS if not t.stem and distance(word, t.text) <= t.edits]
        within += [t.weight for t in TERMS if t.stem and word.startswith(t.text)]
        hit = automaton.match(word)
        assert (hit is not None) == bool(within), word
        if hit:
            assert hit[1] == pytest.approx(max(within)), word


def test_caches_start_afresh(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_STEPS", 2)
    automaton = toxicity.LexiconAutomaton(TERMS)
    assert [automaton.match(w) is not None for w in ("idiot", "idiott", "nothing", "idot", "idiot")] == [True, True, False, True, True]


def test_quotation_weighs_less_than_abuse():
    automaton = toxicity.LexiconAutomaton(TERMS)
    names = toxicity.FEATURES
    value = lambda text, name: toxicity.features(text, automaton)[names.index(name)]
    abuse, quote = "you are an idiot and a moron", 'she wrote "idiot and moron" there'
    assert value(abuse, "open_weight") > value(quote, "open_weight")
    assert value(quote, "quoted") > 0 == value(abuse, "quoted")
    assert value(abuse, "address") > 0
    assert value("«idiot» x", "quoted") > 0 == value('"a" idiot b', "quoted")
    assert toxicity.features("", automaton) == (0.0,) * len(names)


def test_rows_and_odd_texts(spark):
    model = toxicity.Model(TERMS, [0.0, 0.0, 3.0, 0, 0, 0, 0, 0, 0], -2.0)
    docs = docs_of(spark, "you idiot", None, "", "fine " * 100_000, "you idiot", "İdiot stays odd")
    got = sorted(toxicity.score(docs.unionByName(docs.where("doc_id = 0")), model).collect())
    assert [(r["doc_id"], r["predicted"]) for r in got] == [(0, 1), (0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, got[-1]["predicted"])]
    assert got[2]["score"] == got[3]["score"] == got[4]["score"]
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect())[:3] == [1, 2, 3]
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = docs_of(spark, "a b", "c d")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    nulls = spark.createDataFrame([(0, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, nulls).terms == []


def test_held_out_accuracy(spark):
    """On the largest of the plain tables, which has about a hundred toxic held-out documents."""
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    toxic = [r["score"] for r in got if r["toxic"]]
    clean = [r["score"] for r in got if not r["toxic"]]
    above = sum((t > c) + (t == c) / 2 for t in toxic for c in clean)
    assert above / (len(toxic) * len(clean)) > 0.95
