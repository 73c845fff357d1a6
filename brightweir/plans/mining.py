"""Queries for reports, itemsets, similarity, recommendation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import itemsets, model, overlap, recommend, reports, similarity
from ..runtime import cut, new_dir
from ..sinks import writers
from ..sources.readers import read_rating_folder, read_transactions
from . import views
from .basics import (
    BUCKET_SQL,
    CITY_SQL,
    CO_RATER_SQL,
    FEATURE_COLUMNS_SQL,
    FEATURE_SQL,
    REPORT_SQL,
    YEAR,
    asked_neighbours,
    flat_report,
    rating_folder,
)
from .registry import once, query
from .views import with_views

# ---------------------------------------------------------------- reports


@query("rep1_review_report", REPORT_SQL)
def _(spark, sf_dir):
    return flat_report(reports.review_report(views.reviews(spark, sf_dir), YEAR))


@query("rep2_city_average", CITY_SQL)
def _(spark, sf_dir):
    cities = reports.city_average(views.reviews(spark, sf_dir), views.business(spark, sf_dir))
    return cities.select("city", F.round("stars", 6).alias("stars"))


@query(
    "rep3_partition_profile",
    BUCKET_SQL.replace("SELECT CAST(b AS INTEGER)", "SELECT 'customized' AS layout, CAST(b AS INTEGER)"),
)
def _(spark, sf_dir):
    return reports.hash_bucket_profile(views.reviews(spark, sf_dir), "business_id", 16).select(
        F.lit("customized").alias("layout"), "bucket", "n_items"
    )


@query("rep3_partition_summary")
def _(spark, sf_dir):
    return reports.profile_summary(
        reports.partition_profile(views.reviews(spark, sf_dir), "business_id", 16)
    )


# ---------------------------------------------------------------- itemsets

SUPPORT = 30  # of 10,000 baskets
PAIR_SUPPORT = 10  # baskets
N_BUCKETS = 4


def subsets_sql(view: str, extra: str = "", keep: str = "") -> str:
    """Every subset of every basket, by growing sorted lists."""
    return (
        with_views(view, recursive=True)
        + f""", base AS (SELECT basket_id, item FROM {view} {keep}),
    subs(basket_id, itemset, size, last) AS (
        SELECT basket_id, CAST(item AS VARCHAR), 1, item FROM base
        UNION ALL SELECT s.basket_id, s.itemset || '|' || b.item, s.size + 1, b.item
        FROM subs s JOIN base b ON b.basket_id = s.basket_id AND b.item > s.last){extra}"""
    )


FREQUENT_SQL = (
    subsets_sql("brand_baskets")
    + f""" SELECT itemset, size, count(*) AS cnt FROM subs GROUP BY itemset, size
    HAVING count(*) >= {views.sql_basket_support(SUPPORT)}"""
)

LOCAL_SQL = subsets_sql(
    "brand_baskets",
    f""", where_is AS (SELECT DISTINCT basket_id,
            ('0x' || substr(md5(CAST(basket_id AS VARCHAR)), 1, 8))::BIGINT % {N_BUCKETS} AS bucket
            FROM brand_baskets),
    share AS (SELECT bucket, count(*) / (SELECT count(*) FROM where_is)
              * {views.sql_basket_support(SUPPORT)} AS lim FROM where_is GROUP BY bucket),
    local AS (SELECT bucket, itemset, size, count(*) AS cnt FROM subs JOIN where_is USING (basket_id)
              GROUP BY bucket, itemset, size),
    candidates AS (SELECT DISTINCT itemset, size FROM local JOIN share USING (bucket) WHERE cnt >= lim)""",
)


def flat(found):
    return found.withColumn("itemset", F.concat_ws("|", F.col("itemset").cast("array<string>")))


def brand_job(spark, sf_dir):
    return views.brand_baskets(spark, sf_dir), views.basket_support(spark, sf_dir, SUPPORT)


@query(
    "fim1_baskets",
    with_views("pairs")
    + """ SELECT 1 AS kase, user_id AS basket_id, item FROM pairs
    UNION ALL SELECT 2, item, user_id FROM pairs
    UNION ALL SELECT 3, user_id, item FROM pairs WHERE user_id IN
        (SELECT user_id FROM pairs GROUP BY user_id HAVING count(*) > 40)""",
)
def _(spark, sf_dir):
    pairs = views.pairs(spark, sf_dir)
    one = itemsets.baskets(pairs, 1).select(F.lit(1).alias("kase"), "basket_id", "item")
    two = itemsets.baskets(pairs, 2).select(F.lit(2).alias("kase"), "basket_id", "item")
    large = itemsets.baskets(pairs, 1, min_size=40).select(F.lit(3).alias("kase"), "basket_id", "item")
    return one.unionByName(two).unionByName(large)


@query("fim2_apriori", FREQUENT_SQL)
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    return flat(itemsets.apriori(rows, support))


@query(
    "fim2_apriori_many_items",
    subsets_sql("supplier_baskets")
    + f""" SELECT itemset, size, count(*) AS cnt FROM subs GROUP BY itemset, size
    HAVING count(*) >= {PAIR_SUPPORT}""",
)
def _(spark, sf_dir):
    return flat(itemsets.apriori(views.supplier_baskets(spark, sf_dir), PAIR_SUPPORT))


@query("fim3_local_candidates", LOCAL_SQL + " SELECT itemset, size FROM candidates")
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    return flat(itemsets.son_candidates(rows, support, N_BUCKETS))


@query("fim4_two_pass_frequent", FREQUENT_SQL)
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    candidates = itemsets.son_candidates(rows, support, N_BUCKETS)
    return flat(itemsets.son_frequent(rows, candidates, support))


@query("fim5_fp_growth", FREQUENT_SQL)
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    return flat(itemsets.frequent_itemsets(rows, support))


@query("set1_union_of_candidates", LOCAL_SQL + " SELECT size, count(*) AS n FROM candidates GROUP BY size")
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    candidates = itemsets.son_candidates(rows, support, N_BUCKETS)
    return candidates.groupBy("size").agg(F.count("*").alias("n"))


@query(
    "snk3_itemset_report",
    subsets_sql("brand_baskets")
    + f""", found AS (SELECT itemset, size FROM subs GROUP BY itemset, size
                 HAVING count(*) >= {views.sql_basket_support(SUPPORT)}),
    pieces AS (SELECT size, '(''' || replace(itemset, '|', ''', ''') || '''' AS label,
        row_number() OVER (PARTITION BY size ORDER BY string_split(itemset, '|')) = 1 AS opens FROM found)
    SELECT CASE WHEN NOT opens THEN ',' WHEN size > 1 THEN chr(10) || chr(10)
                WHEN section = 1 THEN 'Candidates:' || chr(10)
                ELSE chr(10) || chr(10) || 'Frequent Itemsets:' || chr(10) END || label AS value
    FROM pieces, (VALUES (1), (2)) s(section)""",
)
def _(spark, sf_dir):
    rows, support = brand_job(spark, sf_dir)
    found = cut(itemsets.frequent_itemsets(rows, support))
    path = new_dir(spark, "itemset-report")
    writers.write_itemset_report(found, found, path)
    return spark.read.option("lineSep", ")").text(path)


JOB_SUPPORT = 24  # baskets


@query(
    "job_transactions",
    subsets_sql(
        "transaction_baskets",
        f""", where_is AS (SELECT DISTINCT basket_id,
            ('0x' || substr(md5(basket_id), 1, 8))::BIGINT % {N_BUCKETS} AS bucket FROM transaction_baskets),
    share AS (SELECT bucket, count(*) / (SELECT count(*) FROM where_is) * {JOB_SUPPORT} AS lim
              FROM where_is GROUP BY bucket),
    local AS (SELECT bucket, itemset, size, count(*) AS cnt FROM subs JOIN where_is USING (basket_id)
              GROUP BY bucket, itemset, size),
    listed AS (SELECT DISTINCT 1 AS section, itemset, size FROM local JOIN share USING (bucket) WHERE cnt >= lim
               UNION ALL SELECT 2, itemset, size FROM subs GROUP BY itemset, size HAVING count(*) >= {JOB_SUPPORT}),
    pieces AS (SELECT section, size, '(''' || replace(itemset, '|', ''', ''') || '''' AS label,
               min(size) OVER (PARTITION BY section) AS least, row_number() OVER (PARTITION BY section, size ORDER BY
               list_transform(string_split(itemset, '|'), lambda x: CAST(x AS BIGINT))) = 1 AS opens FROM listed)
    SELECT CASE WHEN NOT opens THEN ',' WHEN size > least THEN chr(10) || chr(10)
                WHEN section = 1 THEN 'Candidates:' || chr(10)
                ELSE chr(10) || chr(10) || 'Frequent Itemsets:' || chr(10) END || label AS value
    FROM pieces""",
    ),
)
def _(spark, sf_dir):
    """From transaction lines to the report: read, keep the cleaned table, drop small baskets, search twice, write."""
    raw, clean, report = (new_dir(spark, f"job-{name}") for name in ("lines", "table", "report"))
    views.transactions(spark, sf_dir).write.text(raw)
    rows = writers.write_table(read_transactions(spark, raw).distinct(), clean)
    kept = cut(itemsets.baskets(rows, 1, min_size=views.LEAST_ITEMS))
    candidates = cut(itemsets.son_candidates(kept, JOB_SUPPORT, N_BUCKETS))
    frequent = cut(itemsets.son_frequent(kept, candidates, JOB_SUPPORT))
    writers.write_itemset_report(candidates, frequent, report)
    return spark.read.option("lineSep", ")").text(report)


# ---------------------------------------------------------------- similarity

COEFFICIENTS_SQL = """, size AS MATERIALIZED (
        SELECT min(c) AS m FROM (SELECT unnest(range(n, n + 2000)) AS c FROM
            (SELECT count(DISTINCT member) AS n FROM sets))
        WHERE len(list_filter(range(2, CAST(floor(sqrt(c)) AS BIGINT) + 1), lambda d: c % d = 0)) = 0),
    coeff AS MATERIALIZED (SELECT h,
        1 + ('0x' || substr(md5('minhash-a-' || h), 1, 8))::BIGINT % (m - 1) AS a,
        ('0x' || substr(md5('minhash-b-' || h), 1, 8))::BIGINT % m AS b, m FROM range(0, 100) r(h), size)"""

SIGNATURE_SQL = (
    with_views("sets")
    + COEFFICIENTS_SQL
    + """, idx AS (SELECT member, row_number() OVER (ORDER BY encode(member)) - 1 AS i
             FROM (SELECT DISTINCT member FROM sets)),
    sig AS MATERIALIZED (SELECT set_id, h AS hash_idx, min((i * a + b) % m) AS minval
            FROM sets JOIN idx USING (member), coeff GROUP BY set_id, h),
    bands AS MATERIALIZED (SELECT set_id, hash_idx // 5 AS band,
            string_agg(CAST(minval AS VARCHAR), ',' ORDER BY hash_idx) AS band_key
            FROM sig GROUP BY set_id, hash_idx // 5)"""
)

CANDIDATE_SQL = SIGNATURE_SQL + """, cand AS (SELECT DISTINCT a.set_id AS id1, b.set_id AS id2 FROM bands a
    JOIN bands b ON a.band = b.band AND a.band_key = b.band_key AND a.set_id < b.set_id)"""

VERIFY_SQL = """, n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY set_id),
    common AS (SELECT id1, id2, count(*) AS shared FROM cand JOIN sets a ON a.set_id = id1
               JOIN sets b ON b.set_id = id2 AND b.member = a.member GROUP BY id1, id2),
    scored AS (SELECT id1, id2, shared, x.n + y.n - shared AS total,
               round(shared / (x.n + y.n - shared), 6) AS similarity
               FROM common JOIN n x ON x.set_id = id1 JOIN n y ON y.set_id = id2)"""

ALL_PAIRS_SQL = with_views("sets") + """,
    n AS MATERIALIZED (SELECT set_id, count(*) AS n FROM sets GROUP BY set_id),
    common AS (SELECT a.set_id AS id1, b.set_id AS id2, count(*) AS shared FROM sets a JOIN sets b
               ON a.member = b.member AND a.set_id < b.set_id GROUP BY a.set_id, b.set_id),
    scored AS (SELECT id1, id2, shared, x.n + y.n - shared AS total,
               round(shared / (x.n + y.n - shared), 6) AS similarity
               FROM common JOIN n x ON x.set_id = id1 JOIN n y ON y.set_id = id2)
    SELECT id1, id2, shared, total, similarity FROM scored WHERE shared / total >= 0.5"""


def rounded(pairs):
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("sim1_minhash_signatures", SIGNATURE_SQL + " SELECT set_id, CAST(hash_idx AS INTEGER) AS hash_idx, minval FROM sig")
def _(spark, sf_dir):
    return similarity.minhash_signatures(views.word_sets(spark, sf_dir))


@query("sim2_bands", SIGNATURE_SQL + " SELECT set_id, CAST(band AS INTEGER) AS band, band_key FROM bands")
def _(spark, sf_dir):
    bands = similarity.lsh_bands(similarity.signature_arrays(views.word_sets(spark, sf_dir)))
    return bands.withColumn("band_key", F.concat_ws(",", F.col("band_key").cast("array<string>")))


@query("sim3_candidate_pairs", CANDIDATE_SQL + " SELECT id1, id2 FROM cand")
def _(spark, sf_dir):
    bands = similarity.lsh_bands(similarity.signature_arrays(views.word_sets(spark, sf_dir)))
    return similarity.lsh_candidates(bands)


@query(
    "sim4_verified_pairs",
    CANDIDATE_SQL + VERIFY_SQL
    + " SELECT id1, id2, shared, total, similarity FROM scored WHERE shared / total >= 0.5",
)
def _(spark, sf_dir):
    return rounded(similarity.lsh_similar(views.word_sets(spark, sf_dir)))


@query("sim5_exact_jaccard", ALL_PAIRS_SQL)
def _(spark, sf_dir):
    return rounded(similarity.jaccard_all(views.word_sets(spark, sf_dir)))


@query(
    "flt4_similarity_cut",
    ALL_PAIRS_SQL.replace(">= 0.5", ">= 0.8"),
)
def _(spark, sf_dir):
    return rounded(similarity.jaccard_all(views.word_sets(spark, sf_dir), min_sim=0.8))


@query("srt3_sorted_pairs", ALL_PAIRS_SQL + " ORDER BY id1, id2, similarity")
def _(spark, sf_dir):
    return rounded(similarity.jaccard_all(views.word_sets(spark, sf_dir)).orderBy("id1", "id2", "similarity"))


@query(
    "set3_intersection_union",
    """WITH w AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark)
    SELECT a.item_id AS id1, b.item_id AS id2, len(list_intersect(a.w, b.w)) AS shared,
           len(list_distinct(a.w || b.w)) AS total
    FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""",
)
def _(spark, sf_dir):
    """Every two benchmark items that share a word."""
    words = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.explode(F.array_distinct(F.split("text", " "))).alias("member")
    )
    sizes = words.groupBy("id").agg(F.count("*").alias("n"))
    n1, n2 = sizes.toDF("id1", "n1"), sizes.toDF("id2", "n2")
    return overlap.overlap_pairs(words, 1).join(n1, "id1").join(n2, "id2").select(
        "id1", "id2", "shared", (F.col("n1") + F.col("n2") - F.col("shared")).alias("total")
    )


# ---------------------------------------------------------------- collaborative filtering

SIM_SQL = CO_RATER_SQL + """,
    mom AS (SELECT id1, id2, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx,
            sum(y * y) AS syy FROM met GROUP BY id1, id2),
    sims AS MATERIALIZED (SELECT w.id1, w.id2, coalesce(n, 0) AS n,
        CASE WHEN n IS NULL THEN 0.0::DOUBLE
             WHEN n * sxx - sx * sx <= 0 OR n * syy - sy * sy <= 0 THEN 1.0::DOUBLE
             ELSE least(1.0::DOUBLE, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)))
        END AS sim FROM needed w LEFT JOIN mom ON mom.id1 = w.id1 AND mom.id2 = w.id2)"""


def predict_sql(n: int, midpoint: bool = False) -> str:
    skip = "AND s.sim <> 0" if midpoint else ""
    base = "(um.m + im.m) / 2" if midpoint else "im.m + um.m - o.o"
    return SIM_SQL + f""",
    o AS (SELECT avg(stars) AS o FROM train),
    um AS (SELECT user_id, avg(stars) AS m FROM dd GROUP BY user_id),
    im AS (SELECT item_id, avg(stars) AS m FROM dd GROUP BY item_id),
    nb AS (SELECT t.user_id, t.item_id, d.item_id AS other, d.stars,
                  CASE WHEN s.sim < 0 THEN s.sim * 0.8 ELSE s.sim * 1.2 END AS sim
           FROM test t JOIN dd d ON d.user_id = t.user_id AND d.item_id <> t.item_id
           JOIN sims s ON s.id1 = least(t.item_id, d.item_id) AND s.id2 = greatest(t.item_id, d.item_id)
           WHERE TRUE {skip}),
    top AS (SELECT * FROM (SELECT *, row_number() OVER
            (PARTITION BY user_id, item_id ORDER BY sim DESC, other) AS rn FROM nb) WHERE rn <= {n}),
    agg AS (SELECT top.user_id, top.item_id, sum(sim * (stars - (im.m + um.m - o.o))) AS num,
                   sum(abs(sim)) AS den, count(*) AS nc
            FROM top JOIN im ON im.item_id = top.other JOIN um ON um.user_id = top.user_id, o
            GROUP BY top.user_id, top.item_id),
    cf AS (SELECT t.user_id, t.item_id,
           CASE WHEN im.m IS NOT NULL AND um.m IS NOT NULL THEN
                least(greatest({base} + CASE WHEN coalesce(den, 0) <> 0 THEN num / den ELSE 0 END, 1.0), 5.0)
                ELSE coalesce(um.m, im.m, o.o) END AS prediction,
           coalesce(nc, 0) AS neighbor_count
           FROM test t LEFT JOIN um ON um.user_id = t.user_id LEFT JOIN im ON im.item_id = t.item_id
           LEFT JOIN agg ON agg.user_id = t.user_id AND agg.item_id = t.item_id, o)"""


CF_OUT = " SELECT user_id, item_id, round(prediction, 5) AS prediction, neighbor_count FROM cf"


def shown(predictions):
    return predictions.withColumn("prediction", F.round("prediction", 5))


def cf(spark, sf_dir, n=50, variant="standard"):
    return recommend.cf_predict(views.train(spark, sf_dir), views.test_rows(spark, sf_dir), n, variant)


def item_sims(spark, sf_dir, unmet=True):
    ratings, asked = asked_neighbours(spark, sf_dir)
    return recommend.pearson_item_pairs(ratings, recommend.keyed_by_pair(asked), unmet=unmet)


@query(
    "cf1_item_pearson",
    SIM_SQL + " SELECT id1 AS item_i, id2 AS item_j, n, round(sim, 6) + 0.0 AS sim FROM sims",
)
def _(spark, sf_dir):
    return item_sims(spark, sf_dir).withColumn("sim", F.round("sim", 6) + 0.0)


@query(
    "flt6_nonzero_similarity",
    SIM_SQL + " SELECT id1 AS item_i, id2 AS item_j, n, round(sim, 6) + 0.0 AS sim FROM sims WHERE sim <> 0",
)
def _(spark, sf_dir):
    kept = item_sims(spark, sf_dir, unmet=False).where(F.col("sim") != 0)
    return kept.withColumn("sim", F.round("sim", 6) + 0.0)


@query("cf2_item_cf", predict_sql(50) + CF_OUT)
def _(spark, sf_dir):
    return shown(cf(spark, sf_dir))


@query(
    "cf3_cold_start",
    predict_sql(50)
    + """ SELECT user_id, item_id, round(prediction, 6) AS prediction FROM cf
    WHERE user_id NOT IN (SELECT user_id FROM dd) OR item_id NOT IN (SELECT item_id FROM dd)""",
)
def _(spark, sf_dir):
    """Only the rows with an unknown user or item are predicted."""
    train, rows = views.train(spark, sf_dir), views.test_rows(spark, sf_dir)
    warm = rows.join(train.select("user_id").distinct(), "user_id", "left_semi").join(
        train.select("item_id").distinct(), "item_id", "left_semi"
    )
    cold = cut(rows.join(warm, ["user_id", "item_id"], "left_anti").select("user_id", "item_id"))
    predictions = recommend.cf_predict(train, cold, 50)
    return predictions.select("user_id", "item_id", F.round("prediction", 6).alias("prediction"))


@query("cf4_midpoint_variant", predict_sql(50, midpoint=True) + CF_OUT)
def _(spark, sf_dir):
    return shown(cf(spark, sf_dir, variant="midpoint"))


# ---------------------------------------------------------------- models


@query(
    "mdl1_feature_table",
    with_views("train", "user_profiles", "business_profiles")
    + FEATURE_SQL
    + f""" SELECT t.user_id, t.item_id, t.stars AS label, {FEATURE_COLUMNS_SQL}
    FROM train t LEFT JOIN uf ON t.user_id = uf.user_id LEFT JOIN bf ON t.item_id = bf.item_id""",
)
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = model.feature_table(
        views.train(spark, sf_dir), views.user_profiles(spark, sf_dir), views.business_profiles(spark, sf_dir)
    )
    values = rows.withColumn("v", vector_to_array("features"))
    real = ("user_average_stars", "item_stars")
    columns = [
        (F.round(F.col("v")[i], 6) if name in real else F.col("v")[i].cast("bigint")).alias(name)
        for i, name in enumerate(model.FEATURES)
    ]
    return values.select("user_id", "item_id", "label", *columns)


def trees(spark, sf_dir):
    """Predictions of one fit for the rated and the later pairs, which the queries below share."""

    def fit():
        train, later = views.train(spark, sf_dir), views.test_rows(spark, sf_dir)
        pairs = train.select("user_id", "item_id").union(later.select("user_id", "item_id")).distinct()
        return cut(model.gbt_predict(train, pairs, views.user_profiles(spark, sf_dir), views.business_profiles(spark, sf_dir)))

    return once(spark, "trees", sf_dir, fit)


def mixed(spark, sf_dir):
    """The hybrid predictions of one fit, which the queries below share."""
    profiles = views.user_profiles(spark, sf_dir), views.business_profiles(spark, sf_dir)
    fit = lambda: cut(model.hybrid_predict(views.train(spark, sf_dir), views.test_rows(spark, sf_dir), *profiles))
    return once(spark, "mixed", sf_dir, fit)


@query("mdl2_boosted_trees")
def _(spark, sf_dir):
    return views.test_rows(spark, sf_dir).join(trees(spark, sf_dir), ["user_id", "item_id"])


@query(
    "mdl2_bounds",
    with_views("train", "test") + " SELECT count(*) AS n_rows, TRUE AS in_range, TRUE AS beats_mean FROM test",
)
def _(spark, sf_dir):
    """Every later pair has a prediction near the range of the ratings; on the rated pairs it beats their mean."""
    train, found = views.train(spark, sf_dir), trees(spark, sf_dir)
    limits = train.agg(F.min("stars").alias("low"), F.max("stars").alias("high"), F.avg("stars").alias("mean")).first()
    later = views.test_rows(spark, sf_dir).join(found, ["user_id", "item_id"]).agg(
        F.count("prediction").alias("n_rows"),
        F.coalesce(F.every(F.col("prediction").between(limits["low"] - 1, limits["high"] + 1)), F.lit(True)).alias("in_range"),
    )
    square = lambda x: F.avg((x - F.col("stars")) ** 2)
    errors = train.join(found, ["user_id", "item_id"]).agg((square(F.col("prediction")) < square(F.lit(limits["mean"]))).alias("beats_mean"))
    return later.select("n_rows", "in_range", errors.select("beats_mean").scalar().alias("beats_mean"))


@query("mdl3_hybrid")
def _(spark, sf_dir):
    return mixed(spark, sf_dir)


@query("mdl3_mix", with_views("test") + " SELECT count(*) AS n_rows, TRUE AS is_mix FROM test")
def _(spark, sf_dir):
    """Each prediction lies where the weight puts it: between the neighbours' and a star rating of the model."""
    train = views.train(spark, sf_dir)
    items = model.item_features(views.business_profiles(spark, sf_dir), train)
    parts = model.hybrid_alpha(cf(spark, sf_dir, n=10), train, items).select(
        "user_id", "item_id", F.col("prediction").alias("near"), F.col("alpha").alias("weight")
    )
    share = F.col("prediction") - F.col("weight") * F.col("near")
    rest = 1 - F.col("weight")
    fits = (F.abs(F.col("alpha") - F.col("weight")) < 1e-9) & share.between(rest - 1e-6, 5 * rest + 1e-6)
    return mixed(spark, sf_dir).join(parts.distinct(), ["user_id", "item_id"]).agg(
        F.count("*").alias("n_rows"), F.every(fits).alias("is_mix")
    )


HYBRID_SQL = (
    predict_sql(10)
    + """, bp AS (SELECT item_id, count(*) AS rc FROM dated GROUP BY item_id),
    bf AS (SELECT * FROM bp WHERE item_id IN (SELECT item_id FROM train)),
    p AS (SELECT (SELECT quantile_cont(n, 0.95) FROM (SELECT item_id, count(*) AS n FROM dd GROUP BY item_id)) AS p,
                 (SELECT quantile_cont(rc, 0.1) FROM bf) AS k)"""
)
JOB_ROUNDS = 20


@query(
    "mdl3_hybrid_weight",
    HYBRID_SQL
    + """ SELECT cf.user_id, cf.item_id, round(prediction, 5) AS prediction, neighbor_count,
           round(CASE WHEN neighbor_count = 0 AND coalesce(rc, 0) = 0 THEN 1
                 ELSE least(neighbor_count, p) / p * (k / (coalesce(rc, 0) + k)) END, 6) AS alpha
    FROM cf LEFT JOIN bf ON bf.item_id = cf.item_id, p""",
)
def _(spark, sf_dir):
    train = views.train(spark, sf_dir)
    items = model.item_features(views.business_profiles(spark, sf_dir), train)
    weighted = model.hybrid_alpha(cf(spark, sf_dir, n=10), train, items)
    return shown(weighted).withColumn("alpha", F.round("alpha", 6))


@query(
    "job_hybrid",
    HYBRID_SQL
    + """ SELECT CAST(cf.user_id AS VARCHAR) AS user_id, CAST(cf.item_id AS VARCHAR) AS item_id, TRUE AS in_range,
           round(CASE WHEN neighbor_count = 0 AND coalesce(rc, 0) = 0 THEN 1
                 ELSE least(neighbor_count, p) / p * (k / (coalesce(rc, 0) + k)) END, 6) AS alpha
    FROM cf LEFT JOIN bf ON bf.item_id = cf.item_id, p""",
)
def _(spark, sf_dir):
    """From a folder of files to the predictions of the hybrid, with a smaller model than ``mdl3_hybrid``."""
    folder = read_rating_folder(spark, rating_folder(spark, sf_dir), names={"business_id": "item_id"})
    asked = views.test_rows(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("item_id"))
    found = model.hybrid_predict(folder["train"], asked, folder["user"], folder["business"], depth=5, rounds=JOB_ROUNDS)
    in_range = F.coalesce(F.col("prediction").between(1 - 1e-9, 5 + 1e-9), F.lit(False))
    return found.select("user_id", "item_id", in_range.alias("in_range"), F.round("alpha", 6).alias("alpha"))


@query(
    "evl1_rmse",
    predict_sql(50)
    + """ SELECT round(sqrt(avg((prediction - stars) * (prediction - stars))), 5) AS rmse, count(*) AS n
    FROM cf JOIN truth USING (user_id, item_id)""",
)
def _(spark, sf_dir):
    result = recommend.rmse(cf(spark, sf_dir), views.truth(spark, sf_dir))
    return result.select(F.round("rmse", 5).alias("rmse"), "n")
