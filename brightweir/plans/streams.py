"""Queries for the stream sketches, over the event table and over a stream of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import (
    bloom_family,
    distinct_family,
    hash_all,
    id_chunks,
    variant_family,
)
from ..functions.numeric import trailing_zeros, trailing_zeros_of_text
from ..operators import sketches
from ..runtime import cut, new_dir
from ..sources.readers import read_id_stream, with_batch
from ..streaming import sketches as streamed
from . import views
from .registry import query
from .views import with_views

BATCH = 100
DISTINCT_BATCH = 300
SLOTS = (0, 20, 40, 60, 80)
ARRIVAL = (2, 0, 3, 1)  # quarters of the events in order of arrival


def specs_sql(specs) -> str:
    rows = ", ".join(f"({i}, {s.a}, {s.b}, {s.p}, {s.m})" for i, s in enumerate(specs))
    return f"specs AS (SELECT * FROM (VALUES {rows}) v(h, a, b, p, m))"


def hashes_sql(specs) -> str:
    """``hashed(id, h, value)``: every distinct id under every hash."""
    return (
        with_views("stream")
        + f""", {specs_sql(specs)},
    bytes AS MATERIALIZED (SELECT id, list_transform(range(0, length(hex(id)) // 2),
              lambda i: ('0x' || substr(hex(id), i * 2 + 1, 2))::BIGINT) AS bs
              FROM (SELECT DISTINCT id FROM stream)),
    primes AS (SELECT DISTINCT p FROM specs),
    reduced AS MATERIALIZED (SELECT id, p,
                list_reduce(bs, lambda acc, v: (acc * 256 + v) % p, 0::BIGINT) AS x FROM bytes, primes),
    hashed AS MATERIALIZED (SELECT id, h, ((x * a + b) % specs.p) % m AS value
               FROM reduced JOIN specs ON specs.p = reduced.p)"""
    )


TAIL = "CASE WHEN value = 0 THEN {zero} ELSE CAST(bit_count((value & -value) - 1) AS INTEGER) END"


def registers_sql(specs, zero: int = 0, batch: int = DISTINCT_BATCH) -> str:
    return (
        hashes_sql(specs)
        + f""", regs AS (SELECT seq // {batch} AS batch, h, max({TAIL.format(zero=zero)}) AS r
                 FROM stream JOIN hashed USING (id) GROUP BY 1, 2),
    truth AS (SELECT seq // {batch} AS batch, count(DISTINCT id) AS truth FROM stream GROUP BY 1),
    est AS (SELECT batch, CAST(round_even(avg(pow(2, r)), 0) AS BIGINT) AS estimate FROM regs GROUP BY batch),
    fm AS (SELECT batch, truth, estimate FROM truth JOIN est USING (batch))"""
    )


FM_SQL = registers_sql(distinct_family())

BLOOM_SQL = (
    hashes_sql(bloom_family())
    + f""", firsts AS (SELECT id, min(seq) AS first FROM stream GROUP BY id),
    bits AS (SELECT value, min(first) AS bit FROM hashed JOIN firsts USING (id) GROUP BY value),
    verdict AS (SELECT id, first, max(bit) < first AS fp FROM hashed JOIN firsts USING (id)
                JOIN bits USING (value) GROUP BY id, first),
    per AS (SELECT first // {BATCH} AS batch, count(*) AS new_ids, count(*) FILTER (WHERE fp) AS fps
            FROM verdict GROUP BY 1)
    SELECT b.batch, coalesce(new_ids, 0) AS new_ids, coalesce(fps, 0) AS false_positives,
           round(CASE WHEN coalesce(new_ids, 0) = 0 THEN 0 ELSE fps / new_ids END, 6) AS fpr
    FROM (SELECT DISTINCT seq // {BATCH} AS batch FROM stream) b LEFT JOIN per ON per.batch = b.batch"""
)

RESERVOIR_SQL = (
    with_views("stream")
    + f""", draws AS (SELECT seq, id,
        ('0x' || substr(md5('553-accept-' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
        ('0x' || substr(md5('553-slot-' || seq), 1, 8))::BIGINT % 100 AS s FROM stream),
    accepted AS (SELECT seq, CASE WHEN seq < 100 THEN seq ELSE s END AS slot, id FROM draws
                 WHERE seq < 100 OR u < 100.0::DOUBLE / (seq + 1)),
    batches AS (SELECT seq // {BATCH} AS batch, max(seq) + 1 AS seqnum FROM stream GROUP BY 1),
    snaps AS (SELECT seqnum, slot, max_by(id, seq) AS id FROM batches JOIN accepted ON seq < seqnum
              WHERE slot IN (0, 20, 40, 60, 80) GROUP BY seqnum, slot)"""
)


def events(spark, sf_dir):
    return views.id_stream(spark, sf_dir)


def event_stream(spark, sf_dir, batch_size):
    """The event table in quarters that arrive out of order, read back as a stream."""
    rows = events(spark, sf_dir)
    path = new_dir(spark, "events")
    total = rows.agg(F.max("seq")).first()[0] + 1
    step = -(-total // len(ARRIVAL))
    for quarter in ARRIVAL:
        part = rows.where((F.col("seq") >= quarter * step) & (F.col("seq") < (quarter + 1) * step))
        part.write.mode("append").parquet(path)
    return read_id_stream(spark, path, batch_size)


def shown_rates(rates):
    return rates.withColumn("fpr", F.round("fpr", 6))


@query(
    "src7_id_stream",
    with_views("stream") + f" SELECT seq, id, seq // {BATCH} AS batch FROM stream",
)
def _(spark, sf_dir):
    path = new_dir(spark, "copied")
    stream = event_stream(spark, sf_dir, BATCH)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows")
    streamed.run_available(writer, f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("str1_bloom_fpr", BLOOM_SQL)
def _(spark, sf_dir):
    return shown_rates(sketches.bloom_fpr(events(spark, sf_dir), BATCH))


@query("str1_bloom_fpr_stream", BLOOM_SQL)
def _(spark, sf_dir):
    folder = new_dir(spark, "bloom")
    return shown_rates(streamed.bloom_stream(event_stream(spark, sf_dir, BATCH), folder, BATCH))


@query("snk7_batch_metrics", BLOOM_SQL.replace("SELECT b.batch", "SELECT b.batch AS time, b.batch", 1))
def _(spark, sf_dir):
    folder = new_dir(spark, "metrics")
    writer = streamed.bloom_metrics(event_stream(spark, sf_dir, BATCH), folder, BATCH)
    streamed.run_available(writer, f"{folder}/checkpoint")
    told = shown_rates(streamed.metric_rows(spark, folder))
    return told.select(F.col("batch").alias("time"), "batch", "new_ids", "false_positives", "fpr")


@query("str2_distinct_estimate", FM_SQL + " SELECT batch, truth, estimate FROM fm")
def _(spark, sf_dir):
    return sketches.fm_estimate(events(spark, sf_dir), DISTINCT_BATCH)


@query("str2_distinct_estimate_stream", FM_SQL + " SELECT batch, truth, estimate FROM fm")
def _(spark, sf_dir):
    folder = new_dir(spark, "distinct")
    return streamed.fm_stream(event_stream(spark, sf_dir, DISTINCT_BATCH), folder, DISTINCT_BATCH)


@query(
    "str3_distinct_variant",
    registers_sql(variant_family(), zero=3) + " SELECT batch, truth, estimate FROM fm",
)
def _(spark, sf_dir):
    specs = variant_family()
    return sketches.fm_estimate(
        events(spark, sf_dir), DISTINCT_BATCH, specs, group_size=len(specs), tail=trailing_zeros_of_text
    )


@query("str4_reservoir", RESERVOIR_SQL + " SELECT seqnum, slot, id FROM snaps")
def _(spark, sf_dir):
    return sketches.reservoir(events(spark, sf_dir), BATCH)


@query("str4_reservoir_stream", RESERVOIR_SQL + " SELECT seqnum, slot, id FROM snaps")
def _(spark, sf_dir):
    folder = new_dir(spark, "reservoir")
    return streamed.reservoir_stream(event_stream(spark, sf_dir, BATCH), folder, BATCH)


@query(
    "win2_slot_snapshots",
    RESERVOIR_SQL
    + " SELECT seqnum, "
    + ", ".join(f'max(id) FILTER (WHERE slot = {s}) AS "{s}_id"' for s in SLOTS)
    + " FROM snaps GROUP BY seqnum",
)
def _(spark, sf_dir):
    return sketches.snapshot_lines(sketches.reservoir(events(spark, sf_dir), BATCH))


RATIO_SQL = FM_SQL + " SELECT round(sum(estimate) / sum(truth), 6) AS ratio FROM fm"


@query("str5_accuracy_ratio", RATIO_SQL)
def _(spark, sf_dir):
    ratio = sketches.estimate_ratio(sketches.fm_estimate(events(spark, sf_dir), DISTINCT_BATCH))
    return ratio.select(F.round("ratio", 6).alias("ratio"))


@query("agg20_ratio_of_sums", RATIO_SQL.replace("FROM fm", ", CAST(sum(truth) AS BIGINT) AS truth FROM fm"))
def _(spark, sf_dir):
    fm = cut(sketches.fm_estimate(events(spark, sf_dir), DISTINCT_BATCH))
    truth = fm.agg(F.sum("truth").alias("truth"))
    return sketches.estimate_ratio(fm).select(F.round("ratio", 6).alias("ratio"), truth.scalar().alias("truth"))


@query(
    "str6_distinct_per_batch",
    with_views("stream")
    + f" SELECT seq // {BATCH} AS batch, count(DISTINCT id) AS truth FROM stream GROUP BY 1",
)
def _(spark, sf_dir):
    return sketches.distinct_per_batch(events(spark, sf_dir), BATCH)


@query(
    "str7_tumbling_count_window",
    with_views("stream")
    + f""" SELECT seq // {BATCH} AS batch, count(*) AS n, min(seq) AS first, max(seq) AS last
    FROM stream GROUP BY 1""",
)
def _(spark, sf_dir):
    return (
        with_batch(events(spark, sf_dir), BATCH)
        .groupBy("batch")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    )


@query(
    "agg12_registers",
    registers_sql(distinct_family()) + " SELECT batch, h AS hash_idx, r AS register FROM regs",
)
def _(spark, sf_dir):
    rows = sketches.registers(events(spark, sf_dir), DISTINCT_BATCH, distinct_family())
    return rows.select("batch", F.posexplode("registers").alias("hash_idx", "register"))


@query(
    "agg14_median_of_means",
    registers_sql(distinct_family())
    + """, means AS (SELECT batch, h // 2 AS grp, avg(pow(2, r)) AS mean FROM regs GROUP BY 1, 2)
    SELECT batch, CAST(round_even(quantile_cont(mean, 0.5), 0) AS BIGINT) AS estimate FROM means GROUP BY batch""",
)
def _(spark, sf_dir):
    return sketches.fm_estimate(events(spark, sf_dir), DISTINCT_BATCH, group_size=2).select("batch", "estimate")


@query(
    "fn5_id_hashes",
    hashes_sql(bloom_family()) + " SELECT id, h AS hash_idx, value FROM hashed",
)
def _(spark, sf_dir):
    ids = events(spark, sf_dir).select("id").distinct()
    return ids.withColumn("chunks", id_chunks(F.col("id"))).select(
        "id", F.posexplode_outer(hash_all(F.col("chunks"), bloom_family())).alias("hash_idx", "value")
    )


@query("fn6_trailing_zeros", f"SELECT event_id, {TAIL.format(zero=0)} AS tz FROM "
       "(SELECT event_id, CAST(event_id AS BIGINT) AS value FROM events)")
def _(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", trailing_zeros(F.col("event_id")).alias("tz"))


@query("fn7_trailing_zeros_of_text", f"SELECT event_id, {TAIL.format(zero=3)} AS tz FROM "
       "(SELECT event_id, CAST(event_id AS BIGINT) AS value FROM events)")
def _(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id", trailing_zeros_of_text(F.col("event_id")).alias("tz")
    )
