"""Pairs sharing members: ordinary and hot groups must give brute-force results."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brightweir.operators import overlap
from brightweir.operators.graph import cooccurrence_edges
from brightweir.operators.recommend import co_ratings


def skewed_sets(seed, n_ids=40, n_members=30):
    """Random sets in which one member belongs to nearly all ids, one id to nearly all members."""
    rng = random.Random(seed)
    sets = {i: {m for m in range(n_members) if rng.random() < 0.15} for i in range(n_ids)}
    for i in sets:
        if rng.random() < 0.9:
            sets[i].add(0)
        if rng.random() < 0.6:
            sets[i].add(1)
    sets[0] = set(range(n_members))
    return sets


def table(spark, sets):
    rows = [(i, m) for i, members in sets.items() for m in members]
    return spark.createDataFrame(rows, "id bigint, member bigint")


@pytest.mark.parametrize("min_shared", [1, 2, 4])
@pytest.mark.parametrize("heavy", [3, 1000])
def test_overlap_pairs_equals_brute_force(spark, min_shared, heavy):
    sets = skewed_sets(min_shared)
    expected = {
        (a, b): len(sets[a] & sets[b])
        for a, b in combinations(sorted(sets), 2)
        if len(sets[a] & sets[b]) >= min_shared
    }
    got = overlap.overlap_pairs(table(spark, sets), min_shared, heavy).collect()
    assert {(r.id1, r.id2): r.shared for r in got} == expected
    assert len(got) == len(expected)


def test_tasks_hold_no_more_pairs_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS_A_TASK", 200)
    rows = spark.range(3000).select(F.col("id"), F.explode(F.array(F.floor(F.col("id") / 6), 1000 + F.col("id") % 500)).alias("member"))
    found = overlap.light_counts(rows).select("id1", "id2", "shared", F.spark_partition_id().alias("task"))
    # 500 groups of six neighbours each way, no two ids share both
    assert found.agg(F.count("*"), F.min("shared"), F.max("shared")).first() == (15000, 1, 1)
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 600


@pytest.mark.parametrize("min_shared", [1, 3])
def test_pairs_dealt_to_many_tasks_equal_brute_force(spark, monkeypatch, min_shared):
    monkeypatch.setattr(overlap, "PAIRS_A_TASK", 10)
    sets = skewed_sets(7)
    got = overlap.overlap_pairs(table(spark, sets), min_shared).collect()
    expected = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= min_shared}
    assert {(r.id1, r.id2): r.shared for r in got} == expected and len(got) == len(expected)


def test_hot_member_proposes_no_pairs(spark):
    # every id holds the hot member and one of its own: nothing reaches two shared members
    rows = [(i, 0) for i in range(50)] + [(i, 100 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, member bigint")
    hot = df.where("member = 0").withColumn("freq", F.lit(50).cast("bigint"))
    assert overlap.prefix_pairs(hot, 2, 10).isEmpty()
    assert overlap.overlap_pairs(df, 2, heavy=10).isEmpty()


def test_blocked_pairs_covers_every_pair_once(spark):
    df = spark.range(25).select("id", F.lit("g").alias("grp"), F.lit(25).cast("bigint").alias("n"))
    got = overlap.blocked_pairs(df, ["grp"], "n", block=4).select("id1", "id2").collect()
    assert sorted((r.id1, r.id2) for r in got) == list(combinations(range(25), 2))


def test_cooccurrence_ignores_repeats_and_isolated_users(spark):
    pairs = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 9)]
    edges = cooccurrence_edges(spark.createDataFrame(pairs, "u string, i int"), 2)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 2)]


@pytest.mark.parametrize("heavy", [2, 1000])
def test_co_ratings_same_with_and_without_hot_users(spark, heavy):
    rng = random.Random(5)
    ratings = [(u, i, float(rng.randint(1, 5))) for u in range(8) for i in range(10) if rng.random() < 0.5]
    ratings += [(99, i, float(1 + i % 5)) for i in range(10)]
    wanted = [(a, b) for a, b in combinations(range(10), 2) if (a + b) % 3]
    by_item = {}
    for u, i, s in ratings:
        by_item.setdefault(i, {})[u] = s
    expected = sorted(
        (a, b, u, by_item[a][u], by_item[b][u])
        for a, b in wanted
        for u in by_item.get(a, {}).keys() & by_item.get(b, {}).keys()
    )
    got = co_ratings(
        spark.createDataFrame(ratings, "user_id bigint, item_id bigint, stars double"),
        spark.createDataFrame(wanted, "id1 bigint, id2 bigint"),
        heavy,
    )
    assert sorted((r.id1, r.id2, r.member, r.value1, r.value2) for r in got.collect()) == expected


def test_ratings_that_meet_are_dealt_out_by_their_number(spark, monkeypatch):
    from brightweir.operators import recommend

    monkeypatch.setattr(recommend, "PAIRS_A_TASK", 500)
    ratings = spark.range(3000).select((F.col("id") % 150).alias("user_id"), F.col("id").alias("item_id"), F.lit(2.0).alias("stars"))
    wanted = ratings.alias("a").join(ratings.alias("b"), F.expr("a.user_id = b.user_id and a.item_id < b.item_id")).selectExpr("a.item_id id1", "b.item_id id2")
    found = co_ratings(ratings, wanted).withColumn("task", F.spark_partition_id())
    assert found.select("id1", "id2").distinct().count() == found.count() == 150 * 190
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 1000


def test_item_held_by_everyone_stays_cheap(spark):
    # 20,000 users share item 0; pairing its group would make 200 million rows
    users = spark.range(20000)
    first, second = F.pmod(F.xxhash64("id"), F.lit(3000)) + 1, F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3000)) + 5000
    pairs = users.select("id", F.explode(F.array(F.lit(0).cast("bigint"), first, second)).alias("item"))
    twins = users.groupBy(first.alias("a"), second.alias("b")).agg(F.count("*").alias("n"))
    expected = twins.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert cooccurrence_edges(pairs, 3).count() == expected > 0


def test_rows_of_pairs_are_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    """With few shuffle partitions a task still holds a bounded number of rows, and the pairs are the same."""
    from brightweir import runtime
    from brightweir.plans import views

    plain = views.pairs(spark, sf_dir)
    rows = spark.createDataFrame([(i, m) for i in range(40) for m in range(i % 7, i % 7 + 5)], "id bigint, member bigint")
    expected = {tuple(r) for r in overlap.overlap_pairs(rows, 3).collect()}
    lines = views.table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 20)
    kept, asked = runtime.dealt, []
    monkeypatch.setattr(overlap, "dealt", lambda df, n, *keys: asked.append((n, keys)) or kept(df, n, *keys))
    assert {tuple(r) for r in overlap.overlap_pairs(rows, 3).collect()} == expected
    assert asked == [(200, ("id",))]
    assert kept(rows, 200, "id").rdd.getNumPartitions() == 10
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 500)
    dealt = views.pairs(spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
