"""Stream sketches over ``(seq, id)`` rows, seq = 0, 1, 2, ... in arrival order.

Each result is written as minima and maxima over ``seq`` instead of a walk along the
stream, so it can be computed in parallel and does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import (
    BLOOM_BITS,
    HashSpec,
    bloom_family,
    distinct_family,
    draw_column,
    hash_all,
    id_chunks,
)
from ..functions.numeric import round_half_even, trailing_zeros
from ..sources.readers import with_batch

BROADCAST_BITS = 1_000_000
SNAPSHOT_BLOCK = 4096


def first_seen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("id").agg(F.min("seq").alias("first"))


def with_positions(ids: DataFrame, specs: list[HashSpec]) -> DataFrame:
    """Adds the array of bit positions the id hashes to."""
    return (
        ids.withColumn("chunks", id_chunks(F.col("id")))
        .withColumn("positions", F.array_distinct(hash_all(F.col("chunks"), specs)))
        .drop("chunks")
    )


def spread(positions: DataFrame) -> DataFrame:
    """One row per id and bit position.

    There is always a position, so the outer form gives the same rows; the plain one
    would first filter on the size of the array and hash every id a second time.
    """
    return positions.select("id", "first", F.explode_outer("positions").alias("pos"))


def bit_first(positions: DataFrame) -> DataFrame:
    """``(pos, bit)``: when each bit was first set. At most one row per bit."""
    return (
        spread(positions)
        .groupBy("pos")
        .agg(F.min("first").alias("bit"))
    )


def false_positives(positions: DataFrame, bits: DataFrame, m: int = BLOOM_BITS) -> DataFrame:
    """``(id, first, fp)``: fp if every bit of the id was set before the id came."""
    if m <= BROADCAST_BITS:
        bits = F.broadcast(bits)  # at most m rows
    latest = (
        spread(positions)
        .join(bits, "pos")
        .groupBy("id", "first")
        .agg(F.max("bit").alias("latest_bit"))
    )
    return latest.select("id", "first", (F.col("latest_bit") < F.col("first")).alias("fp"))


def rate(false_count: Column, new_count: Column) -> Column:
    return F.coalesce(F.try_divide(false_count.cast("double"), new_count), F.lit(0.0))


def bloom_fpr(
    stream: DataFrame, batch_size: int, specs: list[HashSpec] | None = None, m: int = BLOOM_BITS
) -> DataFrame:
    """``(batch, new_ids, false_positives, fpr)`` of one filter kept over all batches."""
    positions = with_positions(first_seen(stream), specs or bloom_family())
    verdicts = false_positives(positions, bit_first(positions), m)
    per_batch = (
        with_batch(verdicts.withColumnRenamed("first", "seq"), batch_size)
        .groupBy("batch")
        .agg(F.count("*").alias("new_ids"), F.count_if("fp").alias("false_positives"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        with_batch(stream, batch_size)
        .select("batch")
        .distinct()
        .join(per_batch, "batch", "left")
        .select(
            "batch",
            F.coalesce("new_ids", zero).alias("new_ids"),
            F.coalesce("false_positives", zero).alias("false_positives"),
            rate(F.col("false_positives"), F.col("new_ids")).alias("fpr"),
        )
    )


def zero_counts(ids: DataFrame, specs: list[HashSpec], tail=trailing_zeros) -> DataFrame:
    """Adds ``tails``: the trailing-zero count of each of the id's hashes."""
    return (
        ids.withColumn("chunks", id_chunks(F.col("id")))
        .withColumn("hashes", hash_all(F.col("chunks"), specs))
        .withColumn("tails", F.transform("hashes", tail))
        .drop("chunks", "hashes")
    )


def registers(stream: DataFrame, batch_size: int, specs: list[HashSpec], tail=trailing_zeros) -> DataFrame:
    """``(batch, truth, registers)``: distinct ids, and the largest tail per hash.

    Ids are made distinct per batch first, so each is hashed once.
    """
    ids = with_batch(stream, batch_size).select("batch", "id").distinct()
    peaks = [F.max(F.col("tails")[i]).alias(f"r{i}") for i in range(len(specs))]
    return (
        zero_counts(ids, specs, tail)
        .groupBy("batch")
        .agg(F.count("*").alias("truth"), *peaks)
        .select("batch", "truth", F.array(*[f"r{i}" for i in range(len(specs))]).alias("registers"))
    )


def register_estimate(regs: Column, n: int, group_size: int) -> Column:
    """Mean of 2^R inside each group of hashes, median of the means, rounded half-even."""
    means = []
    for start in range(0, n, group_size):
        group = [F.pow(F.lit(2.0), regs[i]) for i in range(start, min(start + group_size, n))]
        means.append(sum(group[1:], group[0]) / len(group))
    ordered = F.array_sort(F.array(*means))
    mid = len(means) // 2
    median = ordered[mid] if len(means) % 2 else (ordered[mid - 1] + ordered[mid]) / 2
    return round_half_even(median)


def fm_estimate(
    stream: DataFrame,
    batch_size: int,
    specs: list[HashSpec] | None = None,
    group_size: int = 10,
    tail=trailing_zeros,
) -> DataFrame:
    """``(batch, truth, estimate)``: distinct ids per batch, exact and estimated."""
    specs = specs or distinct_family()
    return registers(stream, batch_size, specs, tail).select(
        "batch", "truth", register_estimate(F.col("registers"), len(specs), group_size).alias("estimate")
    )


def estimate_ratio(estimates: DataFrame) -> DataFrame:
    """Sum of the estimates over the sum of the true counts."""
    return estimates.agg(
        F.try_divide(F.sum("estimate").cast("double"), F.sum("truth")).alias("ratio")
    )


def distinct_per_batch(stream: DataFrame, batch_size: int) -> DataFrame:
    return with_batch(stream, batch_size).groupBy("batch").agg(F.count_distinct("id").alias("truth"))


def accepted_events(stream: DataFrame, k: int = 100, seed: int = 553) -> DataFrame:
    """``(seq, slot, id)`` of the events that enter the reservoir.

    The first k fill the slots in order. Event number n after that enters with
    probability k/n into a random slot; both draws are a function of seed and seq. Of
    N events about ``k * ln(N / k)`` get in, so what follows is small.
    """
    n = F.col("seq") + 1
    chance = draw_column(F.concat(F.lit(f"{seed}-accept-"), F.col("seq").cast("string"))) / F.lit(2.0**32)
    slot = draw_column(F.concat(F.lit(f"{seed}-slot-"), F.col("seq").cast("string"))) % k
    filling = n <= k
    return stream.where(filling | (chance < F.lit(float(k)) / n)).select(
        "seq", F.when(filling, F.col("seq")).otherwise(slot).alias("slot"), "id"
    )


def snapshots(
    accepted: DataFrame, total: int, batch_size: int, slots: tuple[int, ...] = (0, 20, 40, 60, 80)
) -> DataFrame:
    """``(seqnum, slot, id)``: the content of the given slots after each batch.

    A slot keeps its id from the batch that set it to the one before the next change;
    these spans are spread out block by block.
    """
    n_batches = -(-total // batch_size)
    changes = (
        with_batch(accepted.where(F.col("slot").isin(*slots)), batch_size)
        .groupBy("slot", "batch")
        .agg(F.max_by("id", "seq").alias("id"))
    )
    until = F.lead("batch", 1, n_batches).over(Window.partitionBy("slot").orderBy("batch")) - 1
    block = F.lit(SNAPSHOT_BLOCK)
    blocks = F.sequence(F.floor(F.col("batch") / block), F.floor(F.col("until") / block))
    inside = F.sequence(
        F.greatest("batch", F.col("blk") * block), F.least("until", (F.col("blk") + 1) * block - 1)
    )
    spans = changes.withColumn("until", until).withColumn("blk", F.explode(blocks))
    if n_batches > SNAPSHOT_BLOCK:
        spans = spans.repartition("slot", "blk")
    return spans.withColumn("at", F.explode(inside)).select(
        F.least((F.col("at") + 1) * batch_size, F.lit(total)).cast("bigint").alias("seqnum"), "slot", "id"
    )


def reservoir(
    stream: DataFrame,
    batch_size: int,
    k: int = 100,
    slots: tuple[int, ...] = (0, 20, 40, 60, 80),
    seed: int = 553,
) -> DataFrame:
    """``(seqnum, slot, id)`` snapshots of a reservoir sample of the whole stream."""
    total = stream.agg(F.max("seq")).first()[0]
    total = 0 if total is None else total + 1
    return snapshots(accepted_events(stream, k, seed), total, batch_size, slots)


def snapshot_lines(snaps: DataFrame, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """One row per snapshot with a column ``<slot>_id`` per slot."""
    picked = [F.max_by("id", F.when(F.col("slot") == s, 1)).alias(f"{s}_id") for s in slots]
    return snaps.groupBy("seqnum").agg(*picked)
