"""Cases that once went wrong: wide hashes, empty first files, plain scores, late rows, long lists, root blocks."""

import os

import pytest
from pyspark.sql import functions as F

from brightweir.functions import hashing, text
from brightweir.operators import graph, relational
from brightweir.runtime import new_dir
from brightweir.sources import readers
from brightweir.streaming import sketches as streamed

from test_graph import frame, random_edges
from test_sketches import BATCH, SMALL, ids, walk_bloom, walk_estimates


def test_hashes_of_billions_of_members(spark):
    m = 4_000_000_007
    a, b = 3_990_000_011, 3_999_999_999
    values = [0, 1, 4_000_000_000, 4_000_000_006, 9_000_000_000_000_000_000]
    df = spark.createDataFrame([(v,) for v in values], "i bigint")
    got = [r[0] for r in df.select(hashing.linear_hash(F.col("i"), a, b, m)).collect()]
    assert got == [(v * a + b) % m for v in values]
    assert max(a for a, _ in hashing.minhash_coefficients(50, 1 << 40)) > 1 << 33


def test_the_header_may_stand_in_a_later_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("user_id,business_id,stars\nu1,b1,3.0\n")
    (tmp_path / "c.csv").write_text("user_id,business_id,stars\nu2,b2,4.0\n")
    got = readers.read_header_csv(spark, str(tmp_path), readers.RATING_SCHEMA).collect()
    assert sorted(tuple(r) for r in got) == [("u1", "b1", 3.0), ("u2", "b2", 4.0)]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text("")
    assert readers.read_header_csv(spark, str(empty), readers.RATING_SCHEMA).count() == 0
    assert os.listdir(empty) == ["a.csv"]


def test_scores_are_written_plainly(spark):
    values = [12345678.5, 0.0001, 1.0, 2.5, 1 / 3, 100.0, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(text.plain_decimal(F.col("x"), 5)).collect()]
    assert got == ["12345678.5", "0.0001", "1.0", "2.5", "0.33333", "100.0", "0.0"]


@pytest.mark.parametrize("order", [(2, 0, 3, 1), (3, 2, 1, 0)])
def test_streams_in_any_order_lose_nothing(spark, order):
    values = ids()
    path, step = new_dir(spark, "late"), -(-len(values) // len(order))
    for quarter in order:
        rows = [(quarter * step + i, v) for i, v in enumerate(values[quarter * step : (quarter + 1) * step])]
        spark.createDataFrame(rows, "seq bigint, id string").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: readers.read_id_stream(spark, path, BATCH)
    bloom = streamed.bloom_stream(stream(), new_dir(spark, "b"), BATCH, SMALL, 401).collect()
    assert {r.batch: (r.new_ids, r.false_positives) for r in bloom} == walk_bloom(values, BATCH, SMALL)
    estimates = streamed.fm_stream(stream(), new_dir(spark, "f"), BATCH).collect()
    assert {r.batch: (r.truth, r.estimate) for r in estimates} == walk_estimates(values, BATCH, hashing.distinct_family(), 10)


def test_chunks_put_together_are_the_sorted_list(spark):
    rows = [(k, (i * 7919) % 1000) for k in range(3) for i in range(10 + 400 * (k == 1))]
    got = relational.chunked_sets(spark.createDataFrame(rows, "k int, i int").repartition(5), "k", "i", 16).collect()
    for key in range(3):
        chunks = sorted((r.chunk, r["items"], r.n_items) for r in got if r.k == key)
        whole = sorted(i for k, i in rows if k == key)
        assert [c for c, _, _ in chunks] == list(range(-(-len(whole) // 16)))
        assert sum((items for _, items, _ in chunks), []) == whole
        assert {n for _, _, n in chunks} == {len(whole)}


def test_roots_in_blocks_give_the_same_betweenness(spark, monkeypatch):
    edges = frame(spark, random_edges(5))
    whole = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges).collect()}
    monkeypatch.setattr(graph, "WIDTH", 4)
    blocked = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges, at_once=1).collect()}
    assert blocked == pytest.approx(whole)
