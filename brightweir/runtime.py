"""Session helpers: the shared work folder and the lineage cut used by loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench, with a work folder of its own; a cluster job brings both.

    Checkpoints that nothing refers to any more are removed.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brightweir")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="brightweir-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster must name one that every executor can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brightweir-"))
        current = context.getCheckpointDir()
    return current


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared work folder."""
    return f"{work_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` of ``n`` rows by ``keys`` in as many tasks as keep ``ROWS_A_TASK`` each, if the session's are too few.

    The session's number of shuffle partitions is fixed, so their size would grow with the table.
    """
    tasks = ceil(n / ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Runs begun inside drop their shuffle files as soon as they have ended.

    Otherwise the files stay until the driver's memory is next cleaned, so those of all steps
    lie on disk together.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    work_root(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        # a frame keeps the settings it was made under, so it is made anew
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared work folder, its lineage forgotten.

    For tables with a row for every member of a set: packed columns take a small part of the
    room of a checkpoint, and what reads few of them reads no more.
    """
    path = new_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
