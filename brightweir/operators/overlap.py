"""Pairs of ids that share members, without pairing up everything in a hot group.

Tables are long: one row per (id, member). Three building blocks:

* ``blocked_pairs``   self-join inside groups, large groups cut into blocks
* ``probe_pairs``     common members of given pairs, walked from the smaller side
* ``overlap_pairs``   all pairs sharing at least t members, with the exact count
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut, dealt, stored

HEAVY = 1000
PAIRS_A_TASK = 1_000_000  # that a task makes or counts


def blocked_pairs(
    rows: DataFrame,
    group: list[str],
    group_size: str,
    block: int = HEAVY,
    condition: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of the same group joined to (id1, id2) with id1 < id2.

    A group of ``n`` rows is cut into ``ceil(n / block)`` blocks by hash of the id,
    and every two blocks, in one order only, are a join key of their own, so no key ever
    carries more than about block x block pairs. Small groups stay in one block. ``carry``
    columns come out twice, suffixed 1 and 2, and ``condition`` may use them.
    """
    n_blocks = F.ceil(F.col(group_size) / block).cast("int")
    base = rows.select(*group, "id", *carry, n_blocks.alias("n_blocks")).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    )

    def side(n: str, own: str, other: str, partners: Column) -> DataFrame:
        named = [F.col(c).alias(f"{n}_{c}") for c in ("id", *carry)]
        return base.select(*group, *named, F.col("own").alias(own), F.explode(partners).alias(other))

    left = side("a", "block1", "block2", F.sequence(F.col("own"), F.col("n_blocks") - 1))
    right = side("b", "block2", "block1", F.sequence(F.lit(0), F.col("own")))
    met = left.join(right, [*group, "block1", "block2"]).where(
        (F.col("block1") < F.col("block2")) | (F.col("a_id") < F.col("b_id"))
    )
    ordered = F.col("a_id") < F.col("b_id")
    named = [
        F.when(ordered, F.col(f"{one}_{c}")).otherwise(F.col(f"{two}_{c}")).alias(f"{c}{n}")
        for c in ("id", *carry)
        for n, one, two in ((1, "a", "b"), (2, "b", "a"))
    ]
    pairs = met.select(*group, *named)
    return pairs.where(condition) if condition is not None else pairs


def probe_pairs(pairs: DataFrame, rows: DataFrame, sizes: DataFrame, value: str | None = None) -> DataFrame:
    """One row per pair and common member.

    The rows of the smaller id are looked up among those of the larger id by the
    key (larger id, member), so a huge id is never expanded against a small one.
    With ``value`` the two sides' values come out as ``value1`` and ``value2``.
    """
    size1 = sizes.select(F.col("id").alias("id1"), F.col("n").alias("n_of_1"))
    size2 = sizes.select(F.col("id").alias("id2"), F.col("n").alias("n_of_2"))
    directed = (
        pairs.join(size1, "id1")
        .join(size2, "id2")
        .withColumn("first_small", F.col("n_of_1") <= F.col("n_of_2"))
        .select(
            *pairs.columns,
            "first_small",
            F.when(F.col("first_small"), F.col("id1")).otherwise(F.col("id2")).alias("small"),
            F.when(F.col("first_small"), F.col("id2")).otherwise(F.col("id1")).alias("big"),
        )
    )
    extra = [value] if value else []
    a = rows.select(F.col("id").alias("small"), "member", *[F.col(v).alias("value_a") for v in extra])
    b = rows.select(F.col("id").alias("big"), "member", *[F.col(v).alias("value_b") for v in extra])
    found = directed.join(a, "small").join(b, ["big", "member"])
    if not value:
        return found.select(*pairs.columns, "member")
    first_small = F.col("first_small")
    return found.select(
        *pairs.columns,
        "member",
        F.when(first_small, F.col("value_a")).otherwise(F.col("value_b")).alias("value1"),
        F.when(first_small, F.col("value_b")).otherwise(F.col("value_a")).alias("value2"),
    )


def id_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n"))


def overlap_pairs(rows: DataFrame, min_shared: int, heavy: int = HEAVY) -> DataFrame:
    """``(id1, id2, shared)`` for all pairs sharing at least ``min_shared`` members.

    ``rows`` must be distinct (id, member). Members held by at most ``heavy`` ids
    are counted by a plain self-join, whose groups are bounded. For the others the
    prefix rule is used: ordered by frequency, two ids sharing t members must share
    one that is not among the t-1 most frequent members of either. So the hottest
    members propose no pairs at all; they are only looked up for pairs that can
    still reach the threshold.
    """
    if min_shared > 1:
        rows = stored(rows, "overlap-rows")
        rows = dealt(rows, rows.count(), "id")
        enough = id_sizes(rows).where(F.col("n") >= min_shared).select("id")
        rows = rows.join(enough, "id", "left_semi")
    rows = stored(rows, "overlap-rows")
    frequency = rows.groupBy("member").agg(F.count("*").alias("freq"))
    hot = cut(frequency.where(F.col("freq") > heavy))
    if hot.isEmpty():
        return light_counts(rows).where(F.col("shared") >= min_shared)

    light = rows.join(hot.select("member"), "member", "left_anti")
    hot_rows = cut(rows.join(hot, "member"))
    proposals = prefix_pairs(hot_rows, min_shared, heavy)
    known = (
        light_counts(light)
        .unionByName(proposals.withColumn("shared", F.lit(0).cast("bigint")))
        .groupBy("id1", "id2")
        .agg(F.max("shared").alias("light_shared"))
    )
    sizes = id_sizes(hot_rows)
    size1 = sizes.select(F.col("id").alias("id1"), F.col("n").alias("h1"))
    size2 = sizes.select(F.col("id").alias("id2"), F.col("n").alias("h2"))
    zero = F.lit(0).cast("bigint")
    reachable = F.least(F.coalesce("h1", zero), F.coalesce("h2", zero))
    candidates = cut(
        known.join(size1, "id1", "left")
        .join(size2, "id2", "left")
        .where(F.col("light_shared") + reachable >= min_shared)
        .select("id1", "id2", "light_shared")
    )
    hot_counts = (
        probe_pairs(candidates, hot_rows, sizes)
        .groupBy("id1", "id2")
        .agg(F.count("*").alias("hot_shared"))
    )
    shared = F.col("light_shared") + F.coalesce("hot_shared", zero)
    return (
        candidates.join(hot_counts, ["id1", "id2"], "left")
        .select("id1", "id2", shared.alias("shared"))
        .where(F.col("shared") >= min_shared)
    )


def light_counts(rows: DataFrame) -> DataFrame:
    """Shared-member counts by self-join; every member's group must be bounded.

    A row makes as many pairs as its member has ids, so tasks are dealt out by pairs, not
    by the size of the rows: neither those that make pairs nor those that count them hold
    more of them as the table grows.
    """
    freq = F.col("freq")
    made = rows.groupBy("member").agg(F.count("*").alias("freq")).agg(F.sum(freq * (freq - 1) / 2)).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if made > PAIRS_A_TASK:
        rows = rows.repartition(ceil(made / PAIRS_A_TASK), "member")
    a = rows.select(F.col("id").alias("id1"), "member")
    b = rows.select(F.col("id").alias("id2"), "member")
    pairs = a.join(b, "member").where(F.col("id1") < F.col("id2")).select("id1", "id2")
    if made > PAIRS_A_TASK * parts:
        # few ids make few different pairs, which are counted before they are dealt out
        ids = rows.agg(F.approx_count_distinct("id")).first()[0]
        counted = ceil(min(made, ids * ids / 2) / PAIRS_A_TASK)
        pairs = pairs.repartition(counted, "id1", "id2") if counted > parts else pairs
    return pairs.groupBy("id1", "id2").agg(F.count("*").alias("shared"))


def prefix_pairs(hot_rows: DataFrame, min_shared: int, block: int) -> DataFrame:
    """Distinct pairs that meet outside the ``min_shared - 1`` hottest members of each id.

    The limit of an id is read off its histogram of frequencies, which is far smaller
    than its members. Members that tie at the limit stay in; that only adds proposals.
    """
    histogram = hot_rows.groupBy("id", "freq").agg(F.count("*").alias("here"))
    hottest_first = Window.partitionBy("id").orderBy(F.col("freq").desc())
    limits = (
        histogram.withColumn("as_hot", F.sum("here").over(hottest_first))
        .where(F.col("as_hot") >= min_shared)
        .groupBy("id")
        .agg(F.max("freq").alias("cut_freq"))
    )
    proposing = hot_rows.join(limits, "id").where(F.col("freq") <= F.col("cut_freq"))
    return blocked_pairs(proposing, ["member"], "freq", block).select("id1", "id2").distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
