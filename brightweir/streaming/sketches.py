"""The sketches on Structured Streaming.

Streams come from ``read_id_stream``: ``(seq, id, batch)``. State lives either in
Spark's state store or in tables keyed by epoch below a folder in shared storage
(``EpochTables``), so the results stay exact after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import BLOOM_BITS, HashSpec, bloom_family, distinct_family
from ..functions.numeric import trailing_zeros
from ..operators.sketches import (
    accepted_events,
    bit_first,
    false_positives,
    rate,
    register_estimate,
    snapshots,
    with_positions,
    zero_counts,
)

EPOCHS_A_BASE = 8


def run_available(writer, checkpoint: str) -> None:
    """Process everything the source holds, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class EpochTables:
    """Tables below a folder of shared storage that grow by one part for each epoch of a stream.

    An epoch overwrites its own part only, so a replay after a failure writes the same rows.
    Every ``every`` epochs all parts so far are merged into a base, named by the first epoch it
    does not hold; reading takes the last whole base and the parts from there on, at most
    ``every`` of them, however long the stream has run. Parts and bases merge by the same rule.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = EPOCHS_A_BASE) -> None:
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def put(self, table: str, epoch: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            whole = self.read(table, rows.schema, merge, below=epoch + 1)
            whole.write.mode("overwrite").parquet(f"{self.folder}/{table}-base/below={epoch + 1}")

    def numbers(self, name: str) -> list[int]:
        """Numbers of the finished folders ``.../key=number`` below a name."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = root.getFileSystem(conf)
        found = files.listStatus(root) if files.exists(root) else []
        paths = [f.getPath() for f in found]
        return sorted(int(p.getName().split("=")[1]) for p in paths if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def folders(self, table: str, below: int | None = None) -> list[str]:
        """The folders that hold all epochs, or those below a number."""
        held = lambda n: below is None or n <= below
        start = max((n for n in self.numbers(f"{table}-base") if held(n)), default=0)
        parts = [n for n in self.numbers(table) if n >= start and held(n + 1)]
        base = [f"{self.folder}/{table}-base/below={start}"] if start else []
        return base + [f"{self.folder}/{table}/epoch={n}" for n in parts]

    def read(self, table: str, schema, merge: Callable[[DataFrame], DataFrame], below: int | None = None) -> DataFrame:
        found = self.folders(table, below)
        rows = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        return merge(rows)


def least(key: str, value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(key).agg(F.min(value).alias(value))


FIRSTS, BITS, BATCHES = "id string, first bigint", "pos bigint, bit bigint", "batch bigint"


class BloomState:
    """What a Bloom filter over a stream has seen so far: first positions, bits, batches.

    All three merge by minima or union, so rows that arrive late correct what earlier
    epochs said, and the result is that of the stream so far in seq order.
    """

    def __init__(self, spark: SparkSession, folder: str, batch_size: int, specs: list[HashSpec] | None, m: int) -> None:
        self.tables = EpochTables(spark, folder)
        self.batch_size, self.specs, self.m = batch_size, specs or bloom_family(), m

    def add(self, rows: DataFrame, epoch: int) -> None:
        ids = rows.groupBy("id").agg(F.min("seq").alias("first"))
        self.tables.put("firsts", epoch, ids, least("id", "first"))
        self.tables.put("bits", epoch, bit_first(with_positions(ids, self.specs)), least("pos", "bit"))
        self.tables.put("batches", epoch, rows.select(self.batch_of("seq")).distinct(), DataFrame.distinct)

    def batch_of(self, column: str) -> Column:
        return F.floor(F.col(column) / self.batch_size).cast("bigint").alias("batch")

    def rates(self, below: int | None = None, since: int | None = None) -> DataFrame:
        """``(batch, new_ids, false_positives, fpr)`` after the epochs below a number, from batch ``since`` on."""
        firsts = self.tables.read("firsts", FIRSTS, least("id", "first"), below)
        bits = self.tables.read("bits", BITS, least("pos", "bit"), below)
        batches = self.tables.read("batches", BATCHES, DataFrame.distinct, below)
        if since is not None:
            firsts, batches = firsts.where(F.col("first") >= since * self.batch_size), batches.where(F.col("batch") >= since)
        counts = (
            false_positives(with_positions(firsts, self.specs), bits, self.m)
            .groupBy(self.batch_of("first"))
            .agg(F.count("*").alias("new_ids"), F.count_if("fp").alias("false_positives"))
        )
        zero = F.lit(0).cast("bigint")
        return (
            batches.join(counts, "batch", "left")
            .select("batch", F.coalesce("new_ids", zero).alias("new_ids"), F.coalesce("false_positives", zero).alias("false_positives"))
            .withColumn("fpr", rate(F.col("false_positives"), F.col("new_ids")))
        )


def bloom_stream(
    stream: DataFrame,
    folder: str,
    batch_size: int,
    specs: list[HashSpec] | None = None,
    m: int = BLOOM_BITS,
) -> DataFrame:
    """Run the Bloom filter over a stream that arrives in any order; see ``bloom_fpr``.

    An epoch writes the first position of each of its ids, the first time each bit is
    set, and its batches; the rates are read off at the end.
    """
    state = BloomState(stream.sparkSession, folder, batch_size, specs, m)

    def keep(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        state.add(rows, epoch)
        rows.unpersist()

    run_available(stream.select("seq", "id").writeStream.foreachBatch(keep), f"{folder}/checkpoint")
    return state.rates()


METRICS = "batch bigint, new_ids bigint, false_positives bigint, fpr double"


def bloom_metrics(
    stream: DataFrame,
    folder: str,
    batch_size: int,
    specs: list[HashSpec] | None = None,
    m: int = BLOOM_BITS,
):
    """A writer whose stream tells the metric rows of each batch as soon as it is known.

    Start it with a trigger and a checkpoint. Every epoch adds the rows of the batches it
    touched and of all later ones, which late rows can change too; ``metric_rows`` gives
    the last word on each batch, also while the stream runs.
    """
    state = BloomState(stream.sparkSession, folder, batch_size, specs, m)

    def tell(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        state.add(rows, epoch)
        first = rows.agg(F.min(state.batch_of("seq"))).first()[0]
        if first is not None:
            told = state.rates(epoch + 1, first).withColumn("told", F.lit(epoch).cast("bigint"))
            state.tables.put("metrics", epoch, told, last_word)
        rows.unpersist()

    return stream.select("seq", "id").writeStream.foreachBatch(tell)


def last_word(rows: DataFrame) -> DataFrame:
    values = [F.max_by(c, "told").alias(c) for c in ("new_ids", "false_positives", "fpr")]
    return rows.groupBy("batch").agg(*values, F.max("told").alias("told"))


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, new_ids, false_positives, fpr)`` as the stream below ``folder`` has told so far."""
    return EpochTables(spark, folder).read("metrics", f"{METRICS}, told bigint", last_word).drop("told")


def fm_stream(
    stream: DataFrame,
    folder: str,
    batch_size: int,
    specs: list[HashSpec] | None = None,
    group_size: int = 10,
    tail=trailing_zeros,
) -> DataFrame:
    """Distinct-count estimate per tumbling batch of a stream in any order; see ``fm_estimate``.

    An epoch writes its registers and its distinct ids by batch. Registers merge by
    maxima and ids by union, so no batch is ever closed and late rows count.
    """
    tables = EpochTables(stream.sparkSession, folder)
    specs = specs or distinct_family()
    names = [f"r{i}" for i in range(len(specs))]

    def highest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("batch").agg(*[F.max(n).alias(n) for n in names])

    def keep(rows: DataFrame, epoch: int) -> None:
        rows = rows.select("seq", "id").persist()
        batch = F.floor(F.col("seq") / batch_size).cast("bigint").alias("batch")
        peaks = [F.max(F.col("tails")[i]).cast("bigint").alias(name) for i, name in enumerate(names)]
        tables.put("registers", epoch, zero_counts(rows, specs, tail).groupBy(batch).agg(*peaks), highest)
        tables.put("ids", epoch, rows.select(batch, "id").distinct(), DataFrame.distinct)
        rows.unpersist()

    run_available(stream.writeStream.foreachBatch(keep), f"{folder}/checkpoint")
    columns = ", ".join(f"{name} bigint" for name in names)
    registers = tables.read("registers", f"batch bigint, {columns}", highest)
    ids = tables.read("ids", "batch bigint, id string", DataFrame.distinct)
    truth = ids.groupBy("batch").agg(F.count("*").alias("truth"))
    estimate = register_estimate(F.array(*names), len(specs), group_size)
    return truth.join(registers, "batch").select("batch", "truth", estimate.alias("estimate"))


def reservoir_stream(
    stream: DataFrame,
    folder: str,
    batch_size: int,
    k: int = 100,
    slots: tuple[int, ...] = (0, 20, 40, 60, 80),
    seed: int = 553,
) -> DataFrame:
    """Reservoir snapshots; the stream only writes the few accepted events. See ``reservoir``."""
    tables = EpochTables(stream.sparkSession, folder)
    events = stream.select("seq", "id")

    def furthest(rows: DataFrame) -> DataFrame:
        return rows.agg(F.max("last").alias("last"))

    def keep(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        tables.put("accepted", epoch, accepted_events(rows, k, seed).select("seq", "slot", "id"), DataFrame.distinct)
        tables.put("progress", epoch, rows.agg(F.max("seq").alias("last")), furthest)
        rows.unpersist()

    run_available(events.writeStream.foreachBatch(keep), f"{folder}/checkpoint")
    last = tables.read("progress", "last bigint", furthest).first()[0]
    total = 0 if last is None else last + 1
    return snapshots(tables.read("accepted", "seq bigint, slot bigint, id string", DataFrame.distinct), total, batch_size, slots)
