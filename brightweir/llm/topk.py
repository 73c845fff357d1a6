"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments at several resolutions; of each segment its mean and its
deviation (root of the summed squared differences from the mean) are kept. For a pair,

    product <= sum over segments of  width * mean_q * mean_v + deviation_q * deviation_v,

so |q|^2 + |v|^2 minus twice that bounds the distance from below. The search goes from
one segment to many; a candidate whose bound cannot reach the k-th best exact product
known so far is dropped, the survivors' products are computed exactly.

Spark deals the work as a grid: candidates go to cells by row, queries by column, and
each cell answers its queries among its candidates. What a cell holds is bounded by
parameters, and only k rows for each query leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship

SCALE = 256.0
LEVELS = (1, 4, 16)  # segments, coarse to fine
CELL_CANDIDATES, CELL_QUERIES = 32_768, 8_192  # expected vectors of a cell, at most
QUERY_CHUNK = 64
EXACT = 2.0**53  # doubles hold all integers below
LONG = 2**63 - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of (root of width * mean, deviation) for each segment, so that a dot product is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    means = np.stack([p.mean(axis=1) * math.sqrt(p.shape[1]) for p in parts], axis=1)
    devs = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts], axis=1)
    return np.concatenate((means, devs), axis=1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; beyond 64 bits the nearest long."""
    biggest = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(v).max(initial=0), 1.0) * q.shape[1]
    if biggest < EXACT:
        return (q @ v.T).astype(np.int64)
    wide = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in v], object).reshape(v.shape).T
    return np.vectorize(lambda x: max(-LONG - 1, min(LONG, int(x))), otypes=[np.int64])(wide) if wide.size else np.zeros(wide.shape, np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best candidates of each query: parallel lists of query id, candidate id, product."""
    levels = [s for s in LEVELS if s <= v.shape[1]]
    q_stats, v_stats = [statistics(q, s) for s in levels], [statistics(v, s) for s in levels]
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(q), QUERY_CHUNK):
        rows = slice(start, start + QUERY_CHUNK)
        ids, here = q_ids[rows], q[rows]
        alive = ids[:, None] != v_ids
        floor = np.full(len(here), -np.inf)  # the k-th best product known
        for mine, theirs in zip(q_stats, v_stats, strict=True):
            columns = np.flatnonzero(alive.any(axis=0))
            bound = mine[rows] @ theirs[columns].T
            bound += 1e-9 * np.abs(bound) + 1e-6  # for rounding
            bound[~alive[:, columns]] = -np.inf
            if len(columns) > k:
                best = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                for i, at in enumerate(best):
                    at = at[alive[i, columns[at]]]
                    if len(at) == k:
                        floor[i] = max(floor[i], products(here[i : i + 1], v[columns[at]]).min())
            alive[:, columns] &= bound >= floor[:, None]
        columns = np.flatnonzero(alive.any(axis=0))
        exact = products(here, v[columns])
        for i, query in enumerate(ids.tolist()):
            at = np.flatnonzero(alive[i, columns])
            scores, names = exact[i, at], v_ids[columns[at]]
            if len(at) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, names = scores[scores >= least], names[scores >= least]
            order = np.lexsort((names, -scores.astype(float) if len(scores) and abs(scores).max() < EXACT else [-int(s) for s in scores]))[:k]
            out[0].extend([query] * len(order))
            out[1].extend(names[order].tolist())
            out[2].extend(scores[order].tolist())
    return out


def whole_numbers(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Scaled vectors by their length: places and matrix of whole numbers, as doubles."""
    column = vectors.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(float))
    sizes = np.diff(offsets)
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, flat[offsets[at][:, None] + np.arange(size)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k highest products, all if there are fewer.

    Components become floor(256 * x). Candidates are all rows with another id and the
    same number of components; ties go to the smaller id, and a row that repeats another
    is a candidate of its own. Rows with a null id, a null vector, or a null or
    non-finite component take no part. Products beyond 64 bits count as the nearest
    long. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")
    )
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    cores = spark.sparkContext.defaultParallelism
    wide = max(1, math.ceil(size["n"] / CELL_CANDIDATES), min(3 * cores, size["n"] // 1000))
    high = max(1, math.ceil(size["q"] / CELL_QUERIES))
    dealt = F.xxhash64("id", "v")
    candidates = rows.select("id", "v", F.pmod(dealt, F.lit(wide)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("y"))
    queries = rows.where("asks").select(
        F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("q_x"), F.pmod(dealt, F.lit(high)).alias("q_y")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            mine, theirs = whole_numbers(right["q_v"]), whole_numbers(left["v"])
            for length in mine.keys() & theirs.keys():
                (q_at, q), (v_at, v) = mine[length], theirs[length]
                part = search(right["q_id"].to_numpy()[q_at], q, left["id"].to_numpy()[v_at], v, k)
                for whole, some in zip(found, part, strict=True):
                    whole.extend(some)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)})

    cells = (
        candidates.groupBy("x", "y")
        .cogroup(queries.groupBy(F.col("q_x").cast("bigint").alias("x"), F.col("q_y").cast("int").alias("y")))
        .applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


CHECK = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
