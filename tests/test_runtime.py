import time

import pytest
from pyspark.sql import functions as F

from brightweir import runtime


def shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n")
    return sum(line.startswith("shuffle_") for line in blocks.split("\n"))


@pytest.mark.parametrize("kept", [runtime.cut, lambda df: runtime.stored(df, "test")])
def test_shuffle_files_go_with_the_step_that_made_them(spark, kept):
    before = shuffle_files(spark)
    rows = spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 11).alias("key")).agg(F.count("*").alias("n"))
    held = kept(rows)
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert held.agg(F.sum("n")).first()[0] == 5000
    assert spark.conf.get(runtime.CLEANUP, "false") == "false"
