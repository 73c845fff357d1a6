"""Toxicity scores: a lexicon trie walked by Levenshtein automata, and context windows.

The lexicon is learned from labelled documents: whole words and word beginnings that
stand in toxic documents far more often than in others. Its trie is intersected with
the Levenshtein automaton (no edit for short terms and beginnings, one from five
letters, two from nine). The product is made deterministic as words need it, so each
distinct word costs one walk that ends as soon as no term is within reach.

Each hit is weighed by its context window: quotation marks around it and reporting
words before it speak for quotation, words of address for abuse. A logistic model of
the document's hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from .common import fold, held, saved, ship, text_or_empty

#: Labelled documents that the model learns from, at most; half for the lexicon, half for the weights.
TRAIN_ROWS = 12_000
LEXICON_TERMS = 400
LEAST_DOCS, LEAST_ODDS = 4, 2.0  # toxic documents of a term, natural log of its odds ratio
LEAST_WORDS = 3  # distinct words of toxic documents that a beginning has to cover
STEMS = range(3, 9)
WORD = re.compile(r"\w+")
WINDOW = 8
# Cues of the context window.
REPORTING = frozenset(
    "said says wrote writes quoted quotes quote called calls term word phrase dit écrit sagte schrieb dijo escribió".split()
)
ADDRESS = frozenset("you your yours you're ur du dich dein tu toi vous votre eres usted tú".split())
OPENING, CLOSING = "“„«‹", "”»›"
FEATURES = ("any_hit", "open_hits", "open_weight", "top", "second", "terms", "density", "quoted", "address")
CACHE_WORDS, CACHE_STEPS = 150_000, 200_000


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # the word may go on after it
    weight: float

    @property
    def edits(self) -> int:
        return 0 if self.stem else (len(self.text) >= 5) + (len(self.text) >= 9)


class LexiconAutomaton:
    """Deterministic product of the lexicon trie and the Levenshtein automaton, built as words need it.

    A product state is a set of (trie node, edits used); state 0 has no way to a term.
    """

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.child: list[dict[str, int]] = []
        self.ends: list[int | None] = []  # index of the term that ends at a node
        self.most: list[int] = []  # edits that the terms below a node allow
        self.roots = []
        for edits in sorted({t.edits for t in terms}):
            self.roots.append(self.node(edits))
            for i, term in enumerate(terms):
                if term.edits == edits:
                    self.insert(self.roots[-1], i, edits)
        self.forget()

    def node(self, edits: int) -> int:
        self.child.append({})
        self.ends.append(None)
        self.most.append(edits)
        return len(self.child) - 1

    def insert(self, at: int, index: int, edits: int) -> None:
        for letter in self.terms[index].text:
            if letter not in self.child[at]:
                self.child[at][letter] = self.node(edits)
            at = self.child[at][letter]
        old = self.ends[at]
        if old is None or self.terms[old].weight < self.terms[index].weight:
            self.ends[at] = index

    def forget(self) -> None:
        self.names: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.found: list[tuple[int, float] | None] = [None]
        self.next: dict[tuple[int, str], int] = {}
        self.start = self.name({(root, 0) for root in self.roots})
        self.words: dict[str, tuple[int, float] | None] = {}

    def name(self, pairs: set[tuple[int, int]]) -> int:
        """Number of a state, after leaving out letters of terms and all but the fewest edits of a node."""
        fewest: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            if fewest.get(node, 9) <= used:
                continue
            fewest[node] = used
            if node >= 0 and used < self.most[node]:
                todo += [(c, used + 1) for c in self.child[node].values()]
        state = frozenset(fewest.items())
        if state not in self.names:
            self.names[state] = len(self.states)
            self.states.append(state)
            self.found.append(self.best(state))
        return self.names[state]

    def best(self, state: frozenset) -> tuple[int, float] | None:
        hits = []
        for node, used in state:
            index = -1 - node if node < 0 else self.ends[node]
            if index is not None:
                hits.append((self.terms[index].weight * 0.75**used, -index))
        return (-max(hits)[1], max(hits)[0]) if hits else None

    def step(self, state: int, letter: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, used in self.states[state]:
            if node < 0:  # a stem has been read; what follows is free
                out.add((node, used))
                continue
            for c, below in self.child[node].items():
                if c == letter:
                    out.add((below, used))
                elif used < self.most[node]:
                    out.add((below, used + 1))
            if used < self.most[node]:
                out.add((node, used + 1))
        for node, used in list(out):
            index = self.ends[node] if node >= 0 else None
            if index is not None and self.terms[index].stem:
                out.add((-1 - index, used))
        return self.name(out)

    def match(self, word: str) -> tuple[int, float] | None:
        """Index and weight of the best term within reach of a lower-case word."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.next) > CACHE_STEPS:
            self.forget()
        state = self.start
        for letter in word:
            key = (state, letter)
            state = self.next[key] if key in self.next else self.next.setdefault(key, self.step(state, letter))
            if not state:
                break
        self.words[word] = hit = self.found[state]
        return hit


def quoted(text: str, start: int, end: int) -> bool:
    """True if a quotation that opens in the same line before ``start`` closes after ``end`` in it."""
    head = text[text.rfind("\n", 0, start) + 1 : start]
    stop = text.find("\n", end)
    tail = text[end : len(text) if stop < 0 else stop]
    if head.count('"') % 2 and '"' in tail:
        return True
    last_open = max(map(head.rfind, OPENING))
    return last_open > max(map(head.rfind, CLOSING)) and any(c in tail for c in CLOSING + "“")


def features(text: str, automaton: LexiconAutomaton) -> tuple[float, ...]:
    """Values of ``FEATURES`` for one text."""
    low = text.lower()
    words = WORD.findall(low)
    match = automaton.match
    known = {w: hit for w in set(words) if (hit := match(w)) is not None} if automaton.terms else {}
    if not known:
        return (0.0,) * len(FEATURES)
    open_weight, open_hits, in_quotes, addressed, best = 0.0, 0.0, 0.0, 0.0, Counter()
    spans = list(WORD.finditer(low)) if len(low) == len(text) else []
    for i, word in enumerate(words):
        if word not in known:
            continue
        index, weight = known[word]
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        before = words[max(0, i - WINDOW) : i]
        says = any(w in REPORTING for w in before)
        marks = bool(spans) and quoted(text, spans[i].start(), spans[i].end())
        doubt = 0.6 * marks + 0.4 * (marks and says) + 0.2 * (says and not marks)
        address = any(w in ADDRESS for w in near)
        open_hits += 1 - doubt
        open_weight += weight * (1 - doubt)
        in_quotes += marks
        addressed += address * (1 - doubt)
        best[index] = max(best[index], weight * (1 - doubt))
    ranked = [w for _, w in best.most_common(2)] + [0.0]
    return (
        1.0,
        math.log1p(open_hits),
        math.log1p(open_weight),
        ranked[0],
        ranked[1],
        math.log1p(len(best)),
        math.log1p(100 * open_weight / len(words)),
        math.log1p(in_quotes),
        math.log1p(addressed),
    )


@dataclass
class Model:
    """A learned lexicon and the weights of the document features."""

    terms: list[Term] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    intercept: float = -20.0


def automaton_of(terms: list[Term]) -> LexiconAutomaton:
    """The automaton of a lexicon, kept for the next tasks of this worker."""
    return held(("toxicity", tuple(terms)), lambda: LexiconAutomaton(terms))


def document_features(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """``(doc_id, *FEATURES)``, one row for each row of ``(doc_id, text)``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(terms)
        for batch in batches:
            rows = [features(t.as_py() or "", automaton) for t in batch.column(1)]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *FEATURES])
        automaton.words.clear()  # an idle worker holds the automaton only

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FEATURES)]))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, stem, toxic, clean)``: labelled documents of ``(text, toxic)`` with each word or beginning."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                terms = {w for w in words if len(w) <= 40}
                stems = {w[:n] + "*" for w in words for n in STEMS if n < len(w)}
                counts[bool(toxic)].update(terms | stems)
        for toxic, found in counts.items():
            terms = list(found)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                n = pa.array([found[t] for t in some], pa.int64())
                none = pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(some), n if toxic else none, none if toxic else n], ["term", "toxic", "clean"])

    parts = docs.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_terms(docs: DataFrame) -> list[Term]:
    """The lexicon: at most ``LEXICON_TERMS`` terms, those of most toxic documents for their odds."""
    sizes = docs.agg(F.sum(F.col("toxic").cast("bigint")).alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = sizes["toxic"] or 0, sizes["n"] - (sizes["toxic"] or 0)
    if not toxic or not clean:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = saved(term_counts(docs), "toxicity-terms")
    longest = F.least(F.lit(STEMS[-1]), F.length("term") - 1)
    words = counts.where((F.col("toxic") > 0) & ~F.col("term").endswith("*") & (longest >= STEMS[0]))
    spread = (
        words.select(F.explode(F.transform(F.sequence(F.lit(STEMS[0]), longest), lambda n: F.concat(F.substring("term", F.lit(1), n), F.lit("*")))).alias("term"))
        .groupBy("term")
        .count()
        .where(F.col("count") >= LEAST_WORDS)
    )
    wanted = counts.where(F.col("toxic") >= LEAST_DOCS)
    found = (
        wanted.where(~F.col("term").endswith("*"))
        .union(wanted.join(spread, "term", "left_semi"))
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
        .limit(LEXICON_TERMS)
        .collect()
    )
    return [Term(r["term"].rstrip("*"), r["term"].endswith("*"), round(r["odds"], 6)) for r in found]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled documents whose fold (crc32 of the id modulo 5) is not 0.

    At most ``train_rows`` of them are used, those with the smallest hash of their id,
    so the lexicon and the sample of ids have a fixed bound and may be broadcast. Null
    labels, ids and texts teach nothing. Without both kinds of label the model gives
    every text the same score.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = saved(
        known.where(fold() != 0)
        .orderBy(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")), "doc_id")
        .limit(train_rows)
        .withColumn("part", F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")).bitwiseAND(1)),
        "toxicity-sample",
    )
    texts = saved(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxicity-train")
    terms = learn_terms(texts.where("part = 0"))
    rows = saved(
        document_features(texts.where("part = 1"), terms).join(F.broadcast(sample), "doc_id").select(*FEATURES, "toxic"),
        "toxicity-features",
    )
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Model(intercept=20.0 if kinds.get(1) else -20.0)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    fitted = LogisticRegression(featuresCol="vector", labelCol="toxic", maxIter=40, regParam=0.002).fit(vectors)
    return Model(terms, [float(x) for x in fitted.coefficients], float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)``, one row for each row of ``docs``.

    The whole text is looked at; null and empty texts have no hits and get the score of
    such a text. Only the text goes into the score. Repeated rows give repeated
    results, a null id passes through, other columns are not looked at.
    """
    found = document_features(docs.select("doc_id", text_or_empty().alias("text")), model.terms)
    total = F.lit(model.intercept)
    for name, weight in zip(FEATURES, model.weights, strict=True):
        total = total + F.col(name) * F.lit(weight)
    return found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(model.terms)
        for batch in batches:
            totals = [
                model.intercept + sum(w * f for w, f in zip(model.weights, features(t.as_py() or "", automaton), strict=True))
                for t in batch.column(at)
            ]
            yield batch.filter(pa.array([total < 0 for total in totals], pa.bool_()))
        automaton.words.clear()

    return docs.mapInArrow(run, docs.schema)
