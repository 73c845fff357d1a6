"""Top-k against all products."""

import math

import numpy as np
from pyspark.sql import functions as F

from brightweir.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(vectors, asks, k):
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in whole if asks(i)):
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def run(spark, vectors, k=5, every=10):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k)
    return sorted(tuple(r) for r in got.collect())


def test_clusters_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_CANDIDATES", 60)
    monkeypatch.setattr(topk, "CELL_QUERIES", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 20))
    vectors = [(i, (centres[i % 6] + 0.1 * rng.normal(size=20)).astype(np.float32).tolist()) for i in range(230)]
    same = vectors[3][1]
    vectors += [(i, same) for i in range(230, 260)]
    vectors += [(260, None), (270, [None] + same[1:]), (280, [float("nan")] + same[1:]), (290, [float("inf")] + same[1:])]
    vectors += [(300, same[:7]), (301, same[1:8]), (310, []), (320, [0.5]), (330, [-0.001])]
    assert run(spark, vectors) == brute(vectors, lambda i: i % 10 == 0, 5)


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])]) == [(0, 1, 1, 256 * 256 * 11)]
    assert run(spark, []) == []


def test_large_components_stay_exact():
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**30, 1.0]])
    assert topk.products(q, v).tolist() == [[2**60 + 3, topk.LONG]]


def test_bound_holds_for_random_pairs():
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(30, 33)), rng.normal(size=(40, 33))
    for level in topk.LEVELS:
        assert (topk.statistics(q, level) @ topk.statistics(v, level).T >= q @ v.T - 1e-9).all()
