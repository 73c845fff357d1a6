"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

    run(spark, sf_dir)

reads ``documents`` (and ``labels``, ``benchmark``) below ``sf_dir``. Every stage works on
all rows its predecessor kept. Null and empty texts pass every stage but near-dedup,
which keeps one of them; rows with a null id are never dropped as copies or leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightweir.llm import decontaminate, pii, simhash, toxicity
from brightweir.llm.common import saved, table
from brightweir.llm.queries import PII_KEY, bpe_digests


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from labelled ones, rejects go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(saved(leaks, "pipeline-leaks"), "doc_id", "left_anti").select(docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; ``n_chars`` follows."""
    done = pii.replace(docs, key=PII_KEY)
    kind = docs.schema["n_chars"].dataType
    size = F.when(F.col("pii_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size).select(docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, with digests of the ids and of what they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_surrogates),
    ("byte_bpe", tokenised),
]

#: Learned scores and merges have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
