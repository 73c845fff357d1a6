"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with n distinct shingles is contained in a document if at least
``need = ceil(t * n)`` of them occur in it. A hash orders all shingles; an item's sketch
is its ``n - need + 1`` smallest values (bottom-k MinHash with k set by the item's size).
No more than ``n - need`` of its shingles may be missing, so a document that contains the
item has at least one value of the sketch: the search by one equality join loses nothing,
however long the document is. Items are partitioned by size (powers of two). Each
partition has a ceiling, the largest value in its sketches, and a least ``need``; a
document probes only with values below the ceilings of partitions whose items it is long
enough to contain. Candidates are verified by exact shingle containment.

All steps are DataFrame expressions. Documents are not shuffled for the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved, text_or_empty

WORDS = 5
CONTAINMENT = 0.8
#: A table of sketches or item shingles is broadcast up to so many rows; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str) -> Column:
    """Strings of ``WORDS`` words; fewer words give the whole sequence, none give none."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    )


def hashes_of(hashed: str) -> Column:
    """One 64-bit value for each shingle, from the values of its words (column ``hashed``)."""
    n = F.size(hashed)
    parts = lambda i: [F.get(F.col(hashed), i + k) for k in range(WORDS)]
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < WORDS, F.array(F.hash(hashed).cast("bigint") * 4294967296 + F.xxhash64(hashed).bitwiseAND(4294967295)))
        .otherwise(F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*parts(i))))
    )


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it was counted to have at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """``(item_id, h, need, size_class)``: the bottom-k sketch of each item with at least one shingle."""
    sized = items.select("item_id", F.array_distinct(hashes_of("hashed")).alias("hs")).where(F.size("hs") > 0)
    sized = sized.withColumn("need", F.ceil(F.size("hs") * F.lit(containment) - 1e-9).cast("int"))
    return sized.select(
        "item_id",
        F.explode(F.slice(F.array_sort("hs"), F.lit(1), F.size("hs") - F.col("need") + 1)).alias("h"),
        "need",
        F.floor(F.log2(F.size("hs"))).alias("size_class"),
    )


def candidates(docs: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` that share a value of the item's sketch."""
    sketch = saved(sketches(items, containment), "decontaminate-sketches")
    # one row for each power of two of an item's size: at most 31
    classes = sketch.groupBy("size_class").agg(F.max("h").alias("ceiling"), F.min("need").alias("need")).collect()
    hashed = docs.select("doc_id", hashed_words(text_or_empty()).alias("hashed")).select("doc_id", hashes_of("hashed").alias("hs"))
    if not classes:
        return hashed.where("false").join(sketch, F.lit(False)).select("doc_id", "item_id")
    size = F.size("hs")
    ceilings = [F.when(size >= c["need"], F.lit(c["ceiling"])) for c in classes]
    ceiling = F.greatest(*ceilings) if len(ceilings) > 1 else ceilings[0]
    probes = hashed.select("doc_id", size.alias("size"), F.explode(F.filter("hs", lambda h: h <= ceiling)).alias("probe"))
    lookup = few(sketch.select("item_id", "h", "need"), sketch.count())
    return (
        probes.join(lookup, (F.col("probe") == F.col("h")) & (F.col("size") >= F.col("need")))
        .select("doc_id", "item_id")
        .distinct()
    )


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` of documents that contain an item.

    ``docs`` has ``(doc_id, text)``, ``items`` ``(item_id, text)``; other columns are not
    looked at. Null and empty texts contain nothing and are contained in nothing; a text
    of fewer than five words matches only the same sequence of words as a whole text.
    Rows that repeat an id are parts of one document or item: what any of them holds,
    it holds. Rows with a null id are left out, since nothing could name them.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = items.select("item_id", "text").where("item_id is not null")
    pairs = saved(candidates(docs, items.select("item_id", hashed_words(text_or_empty()).alias("hashed")), containment), "decontaminate-pairs")
    parts = items.select("item_id", words_of(text_or_empty()).alias("words"))
    owned = saved(parts.select("item_id", F.explode(shingles_of("words")).alias("shingle")).distinct(), "decontaminate-items")
    sizes = owned.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    suspects = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = suspects.select("doc_id", words_of(text_or_empty()).alias("words")).select(
        "doc_id", F.explode(F.array_distinct(shingles_of("words"))).alias("shingle")
    )
    found = (
        held.join(few(owned, owned.count()), "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("shingle").alias("n_found"))
        .join(pairs, ["doc_id", "item_id"], "left_semi")
        .join(sizes, "item_id")
    )
    return found.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * F.lit(containment) - 1e-9)).select(
        "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")
    )


def shingles_sql(table: str, name: str) -> str:
    """The distinct shingles of a table's texts, in DuckDB SQL."""
    return f"""SELECT DISTINCT {name}, array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') AS shingle
        FROM (SELECT {name}, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i
              FROM (SELECT {name}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws
                    FROM {table} WHERE {name} IS NOT NULL)
              WHERE len(ws) > 0)"""


CHECK = f"""
WITH held AS ({shingles_sql("documents", "doc_id")}),
     owned AS ({shingles_sql("benchmark", "item_id")}),
     sizes AS (SELECT item_id, count(*) AS n_shingles FROM owned GROUP BY item_id),
     found AS (SELECT doc_id, item_id, count(*) AS n_found FROM held JOIN owned USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM found JOIN sizes USING (item_id)
WHERE n_found >= ceil(n_shingles * {CONTAINMENT} - 1e-9)
"""
