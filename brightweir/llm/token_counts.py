"""Token counts as rollups that signed deltas maintain.

A rollup is a folder of delta tables, one for each committed batch, each holding sums by
source, language and tokenizer version. Counts are additive, so the total is the sum of
all batches: an insert adds a document's tokens, a delete subtracts them, a revision
does both. A batch is committed by writing its sums under its name; writing the same
batch again replaces the same folder, so retries and repeated deliveries count once.
Batches may be folded into one base table at any time without changing the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import text_or_empty

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"
#: Tokenizer versions that need no vocabulary: pattern whose matches are counted.
WORDS = {
    "words-1": r"[^ \t\n\x0B\f\r]+",
    "words-2": r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]",
}


def token_count(tokenizer: str, text: str = "text") -> Column:
    """Tokens of a text under a version of ``WORDS``; null and empty texts have none."""
    body = text_or_empty(text)
    if tokenizer == "words-1":  # runs of other than white space: one more than the gaps between them
        trimmed = F.regexp_replace(body, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
        return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("bigint")
    return F.regexp_count(body, F.lit(WORDS[tokenizer])).cast("bigint")


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` as rows to be inserted: ``(source, lang, tokenizer, n_tokens)``."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), token_count(tokenizer).alias("n_tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("n_docs"), F.col("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents counted anew, as the old counts taken away and the new ones added."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    Null sources, languages and versions are keys like any other; null counts add
    nothing. A key whose documents have all gone has no row. Other columns of what is
    committed are not looked at; an empty batch is committed and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Add the sums of signed ``deltas`` (``KEYS``, ``n_docs``, ``n_tokens``), once for each batch name."""
        sums = deltas.groupBy(*KEYS).agg(
            F.coalesce(F.sum("n_docs"), F.lit(0)).cast("bigint").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens")
        )
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/{self.folder(batch)}")

    @staticmethod
    def folder(batch: str) -> str:
        return f"batch-{batch.encode().hex()}"

    def deltas(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{self.folder(b)}" for b in batches])

    def totals(self, batches: list[str]) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)`` after the named batches, in whatever order they came."""
        return (
            self.deltas(batches)
            .dropDuplicates([*KEYS, "batch"])
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
        )

    def fold(self, batches: list[str], base: str) -> None:
        """Commit the sum of ``batches`` as the batch ``base``, which then stands for them."""
        self.commit(base, self.totals(batches))


CHECK = r"""
WITH counted AS (
    SELECT doc_id, text, source, lang,
           CASE WHEN regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g') = '' THEN 0
                ELSE len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) END AS words1,
           len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]')) AS words2
    FROM (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM counted)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM (SELECT source, lang,
             CASE WHEN lang IN ('de', 'fr') THEN 'words-2' ELSE 'words-1' END AS tokenizer,
             CASE WHEN lang IN ('de', 'fr') THEN words2 ELSE words1 END AS n_tokens
      FROM ranked WHERE copy = 1)
GROUP BY source, lang, tokenizer
"""
