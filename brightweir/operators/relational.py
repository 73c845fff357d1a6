"""Set-valued helpers on long (key, item) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut


def chunked_sets(df: DataFrame, key: str, item: str, chunk_size: int = 10000) -> DataFrame:
    """Items per key as sorted arrays of at most ``chunk_size`` entries.

    Chunks 0, 1, 2, ... of a key, put one after another, are its sorted list. Items are
    ranked by range partitions and offsets, so a key with any number of items is
    spread over tasks and no array grows with the data.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.select(key, item).repartitionByRange(parts, key, item).select(key, item, F.spark_partition_id().alias("part")))
    local = Window.partitionBy("part", key).orderBy(item)
    sizes = cut(ranged.groupBy(key, "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(key)).alias("n_items")
    )
    place = F.col("offset") + F.row_number().over(local) - 1
    return (
        ranged.join(offsets, [key, "part"])
        .withColumn("chunk", F.floor(place / chunk_size).cast("bigint"))
        .groupBy(key, "n_items", "chunk")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct values of a column numbered 0, 1, 2, ... in sorted order.

    The values are range-partitioned and numbered inside each partition; only the
    partition sizes (one row per partition) are summed up in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    ranged = cut(
        df.select(col)
        .distinct()
        .repartitionByRange(parts, col)
        .sortWithinPartitions(col)
        .select(
            col,
            F.shiftright(local, 33).alias("part"),
            local.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"),
        )
    )
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranged.join(F.broadcast(offsets), "part").select(
        col, (F.col("offset") + F.col("pos")).alias(out)
    )


def running_totals(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum over all rows up to this one by ``order``, which must not repeat.

    Rows are range-partitioned; only the sums of the partitions meet in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(*(F.sum(c).alias(f"before_{c}") for c in columns))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", *(F.coalesce(F.sum(f"before_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in columns))
    local = Window.partitionBy("part").orderBy(order)
    rest = [c for c in df.columns if c not in columns]
    return ranged.join(F.broadcast(offsets), "part").select(*rest, *((F.col(f"before_{c}") + F.sum(c).over(local)).alias(c) for c in columns))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
