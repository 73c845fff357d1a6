"""What the operators share: table access, saved tables, and code for the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import new_dir

PACKAGE = __name__.split(".")[0]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, and what reads the table
    several times, with few of its columns, does not compute it again.
    """
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, once for each context, in small batches.

    Texts may be long: batches of Spark's default row count would hold too many of them.
    Batch sizes that the session sets itself are kept.
    """
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    context = spark.sparkContext
    if getattr(context, "_shipped_package", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), f"{PACKAGE}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._shipped_package = True


HELD: dict = {}


def held(name: object, make):
    """What ``make`` gives, kept in this Python worker for its next tasks until another thing is asked for."""
    if name not in HELD:
        HELD.clear()
        HELD[name] = make()
    return HELD[name]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
