"""Queries for sources, sinks, filters, joins, aggregates, windows, sorts, sets, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, numeric, text
from ..operators import itemsets, model, overlap, recommend, relational, reports, similarity, sketches
from ..operators.graph import bfs_levels, label_propagation, remove_edges, top_edges, community_members
from ..runtime import cut, new_dir, stored
from ..sinks import writers
from ..sources import readers
from . import views
from .graphs import EDGES_SQL, LABELS_SQL, edges, sql_edges
from .registry import query
from .views import table, with_views

YEAR = views.REPORT_YEAR
LINES = views.LINES
ITEM_SUPPORT = 600  # baskets
SHARED_ITEMS = 4
CHUNK = 3  # entries of a list, small enough for lists of several chunks
COMMON_PAIR = 130  # of 10,000 baskets

# ---------------------------------------------------------------- sources


def json_reviews(spark, sf_dir):
    path = new_dir(spark, "reviews-json")
    views.reviews(spark, sf_dir).write.json(path)
    return path


ALL_REVIEWS = with_views("reviews") + " SELECT user_id, business_id, stars, date FROM reviews"


@query("src1_json_strict", ALL_REVIEWS)
def _(spark, sf_dir):
    return readers.read_json_strict(spark, json_reviews(spark, sf_dir), readers.REVIEW_SCHEMA)


@query("src2_json_drop_bad_lines", ALL_REVIEWS)
def _(spark, sf_dir):
    path = new_dir(spark, "reviews-mixed")
    good = views.reviews(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    broken = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"user_id": "'), F.col("s_name")).alias("value")
    )
    good.union(broken).write.text(path)
    return readers.read_json_lenient(spark, path, readers.REVIEW_SCHEMA)


@query("src3_json_inferred", with_views("reviews") + " SELECT business_id, stars FROM reviews")
def _(spark, sf_dir):
    return readers.read_json_inferred(spark, json_reviews(spark, sf_dir), "business_id", "stars")


@query(
    "src4_header_csv",
    with_views("ratings")
    + " SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS business_id, stars FROM ratings",
)
def _(spark, sf_dir):
    path = new_dir(spark, "ratings-csv")
    # the header opens every part file and is repeated once per region inside
    rows = views.ratings(spark, sf_dir).select(F.concat_ws(",", "user_id", "item_id", "stars").alias("value"))
    titles = table(spark, sf_dir, "region").select(F.lit("user_id,business_id,stars").alias("value"))
    titles.union(rows).write.text(path)
    return readers.read_header_csv(spark, path, readers.RATING_SCHEMA)


SHORT_KEY = """strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey"""


def transaction_file(spark, sf_dir):
    path = new_dir(spark, "transactions")
    title = '"DATE","CUSTOMER","A","B","C","PRODUCT"'
    titles = table(spark, sf_dir, "region").select(F.lit(title).alias("value"))
    titles.union(views.transactions(spark, sf_dir)).write.text(path)
    return path


@query(
    "src5_transaction_csv", f"SELECT {SHORT_KEY} AS basket_id, l_partkey AS item FROM {LINES}"
)
def _(spark, sf_dir):
    return readers.read_transactions(spark, transaction_file(spark, sf_dir))


def rating_folder(spark, sf_dir):
    folder = new_dir(spark, "folder")
    views.train(spark, sf_dir).write.option("header", True).csv(f"{folder}/train.csv")
    users = views.user_profiles(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    users.write.json(f"{folder}/user.json")
    items = views.business_profiles(spark, sf_dir).withColumn("business_id", F.col("item_id").cast("string"))
    items.drop("item_id").write.json(f"{folder}/business.json")
    return folder


@query(
    "src6_folder",
    with_views("train", "user_profiles", "business_profiles")
    + """ SELECT 'train' AS part, count(*) AS n, CAST(sum(stars) AS BIGINT) AS total FROM train
    UNION ALL SELECT 'user', count(*), CAST(sum(useful) AS BIGINT) FROM user_profiles
    UNION ALL SELECT 'business', count(*), CAST(sum(review_count) AS BIGINT) FROM business_profiles""",
)
def _(spark, sf_dir):
    parts = readers.read_rating_folder(spark, rating_folder(spark, sf_dir))
    measures = {"train": "stars", "user": "useful", "business": "review_count"}
    return overlap.union_all(
        [
            parts[p].agg(
                F.lit(p).alias("part"), F.count("*").alias("n"), F.sum(c).cast("bigint").alias("total")
            )
            for p, c in measures.items()
        ]
    )


# ---------------------------------------------------------------- sinks

REPORT_SQL = with_views("reviews") + f""",
    users AS (SELECT user_id, count(*) AS cnt FROM reviews GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 10),
    firms AS (SELECT business_id, count(*) AS cnt FROM reviews GROUP BY business_id
              ORDER BY cnt DESC, business_id LIMIT 10)
    SELECT count(*) AS n_review, count(*) FILTER (WHERE starts_with(date, '{YEAR}')) AS n_review_year,
           count(DISTINCT user_id) AS n_user,
           (SELECT string_agg(user_id || ':' || cnt, ' ' ORDER BY cnt DESC, user_id) FROM users) AS top_user,
           count(DISTINCT business_id) AS n_business,
           (SELECT string_agg(business_id || ':' || cnt, ' ' ORDER BY cnt DESC, business_id) FROM firms)
               AS top_business
    FROM reviews"""


def flat_report(report):
    """Top lists as ``id:count`` words, for comparison with SQL."""
    words = {
        c: F.concat_ws(" ", F.transform(c, lambda e: F.concat_ws(":", e["id"], e["cnt"].cast("string"))))
        for c in ("top_user", "top_business")
    }
    return report.withColumns(words)


@query("snk1_json_report", REPORT_SQL)
def _(spark, sf_dir):
    path = new_dir(spark, "report-json")
    report = reports.review_report(views.reviews(spark, sf_dir), YEAR)
    writers.write_json_report(report, path)
    return flat_report(spark.read.schema(report.schema).json(path))


CITY_SQL = with_views("reviews", "business") + """
    SELECT coalesce(city, '') AS city, round(avg(stars), 6) AS stars
    FROM reviews LEFT JOIN business USING (business_id) GROUP BY coalesce(city, '')"""


@query("snk2_csv_header", CITY_SQL)
def _(spark, sf_dir):
    path = new_dir(spark, "city-csv")
    writers.write_csv(
        reports.city_average(views.reviews(spark, sf_dir), views.business(spark, sf_dir)), path
    )
    rows = spark.read.schema("city string, stars double").option("header", True).csv(path)
    return rows.select(F.coalesce("city", F.lit("")).alias("city"), F.round("stars", 6).alias("stars"))


@query(
    "snk6_cleaned_table", f"SELECT {SHORT_KEY} AS basket_id, l_partkey AS item FROM {LINES}"
)
def _(spark, sf_dir):
    cleaned = readers.read_transactions(spark, transaction_file(spark, sf_dir))
    return writers.write_table(cleaned, new_dir(spark, "cleaned"))


# ---------------------------------------------------------------- projections and filters


@query(
    "prj1_rekey",
    with_views("reviews") + " SELECT business_id AS k, stars AS v, 1 AS one FROM reviews",
)
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).select(
        F.col("business_id").alias("k"), F.col("stars").alias("v"), F.lit(1).alias("one")
    )


@query(
    "prj2_explode_sets",
    with_views("sets") + " SELECT set_id, member FROM sets",
)
def _(spark, sf_dir):
    return views.word_sets(spark, sf_dir)


@query(
    "flt1_date_prefix",
    with_views("reviews") + f" SELECT * FROM reviews WHERE starts_with(date, '{YEAR}')",
)
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).where(F.col("date").startswith(YEAR))


@query(
    "flt2_min_support",
    with_views("supplier_baskets")
    + f""" SELECT item, count(*) AS cnt FROM supplier_baskets GROUP BY item
    HAVING count(*) >= {ITEM_SUPPORT}""",
)
def _(spark, sf_dir):
    return reports.group_counts(views.supplier_baskets(spark, sf_dir), "item").where(F.col("cnt") >= ITEM_SUPPORT)


@query(
    "flt3_basket_size",
    with_views("brand_baskets")
    + """ SELECT basket_id, item FROM brand_baskets WHERE basket_id IN
    (SELECT basket_id FROM brand_baskets GROUP BY basket_id HAVING count(*) > 4)""",
)
def _(spark, sf_dir):
    return itemsets.larger_baskets(views.brand_baskets(spark, sf_dir), 4)


@query(
    "flt5_near_maximum",
    sql_edges()
    + """ SELECT src, dst, CAST(shared AS DOUBLE) AS betweenness FROM edges
    WHERE abs(shared - (SELECT max(shared) FROM edges)) < 1e-6""",
)
def _(spark, sf_dir):
    scores = edges(spark, sf_dir).select("src", "dst", F.col("shared").cast("double").alias("betweenness"))
    return top_edges(scores)


@query(
    "flt7_defaults",
    with_views("ratings", "user_profiles")
    + """ SELECT c_custkey AS user_id, coalesce(review_count, 0) AS review_count,
    round(coalesce(average_stars, 0.0), 6) AS average_stars, coalesce(useful, 0) AS useful
    FROM customer LEFT JOIN user_profiles ON c_custkey = user_id""",
)
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return customers.join(views.user_profiles(spark, sf_dir), "user_id", "left").select(
        "user_id",
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.round(F.coalesce("average_stars", F.lit(0.0)), 6).alias("average_stars"),
        F.coalesce("useful", F.lit(0)).alias("useful"),
    )


# ---------------------------------------------------------------- joins


@query(
    "jn1_left_outer",
    with_views("reviews", "business")
    + """ SELECT business_id, user_id, stars, date, coalesce(city, '') AS city
    FROM reviews LEFT JOIN business USING (business_id)""",
)
def _(spark, sf_dir):
    return reports.review_city(views.reviews(spark, sf_dir), views.business(spark, sf_dir))


@query(
    "jn2_left_semi",
    with_views("train", "user_profiles")
    + """ SELECT user_id, review_count, round(average_stars, 6) AS average_stars, useful
    FROM user_profiles WHERE user_id IN (SELECT user_id FROM train)""",
)
def _(spark, sf_dir):
    profiles = model.user_features(views.user_profiles(spark, sf_dir), views.train(spark, sf_dir))
    return profiles.select(
        "user_id",
        F.col("user_review_count").cast("bigint").alias("review_count"),
        F.round("user_average_stars", 6).alias("average_stars"),
        F.col("user_useful").cast("bigint").alias("useful"),
    )


FEATURE_SQL = """,
    uf AS (SELECT * FROM user_profiles WHERE user_id IN (SELECT user_id FROM train)),
    bf AS (SELECT * FROM business_profiles WHERE item_id IN (SELECT item_id FROM train))"""

FEATURE_COLUMNS_SQL = """coalesce(uf.review_count, 0) AS user_review_count,
    round(coalesce(uf.average_stars, 0), 6) AS user_average_stars, coalesce(uf.useful, 0) AS user_useful,
    round(coalesce(bf.stars, 0), 6) AS item_stars, coalesce(bf.review_count, 0) AS item_review_count,
    CAST(coalesce(TRY_CAST(bf.price AS INTEGER), 0) AS BIGINT) AS item_price_range"""


@query(
    "jn3_default_lookup",
    with_views("train", "test", "user_profiles", "business_profiles")
    + FEATURE_SQL
    + f""" SELECT t.user_id, t.item_id, {FEATURE_COLUMNS_SQL}
    FROM test t LEFT JOIN uf ON t.user_id = uf.user_id LEFT JOIN bf ON t.item_id = bf.item_id""",
)
def _(spark, sf_dir):
    train = views.train(spark, sf_dir)
    wide = model.feature_columns(
        views.test_rows(spark, sf_dir),
        model.user_features(views.user_profiles(spark, sf_dir), train),
        model.item_features(views.business_profiles(spark, sf_dir), train),
    )
    whole = ["user_review_count", "user_useful", "item_review_count", "item_price_range"]
    real = ["user_average_stars", "item_stars"]
    return wide.select(
        "user_id",
        "item_id",
        *[F.col(c).cast("bigint").alias(c) for c in whole],
        *[F.round(c, 6).alias(c) for c in real],
    )


@query(
    "jn4_pairs_in_group",
    with_views("pairs")
    + f""" SELECT a.user_id AS id1, b.user_id AS id2, count(*) AS shared FROM pairs a JOIN pairs b
    ON a.item = b.item AND a.user_id < b.user_id GROUP BY a.user_id, b.user_id
    HAVING count(*) >= {SHARED_ITEMS}""",
)
def _(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("item").alias("member"))
    return overlap.overlap_pairs(rows, SHARED_ITEMS)


def toy_predictions(spark, sf_dir):
    """User mean of the training ratings as prediction for every test row."""
    train = views.train(spark, sf_dir)
    means = recommend.key_mean(recommend.distinct_ratings(train), "user_id", "prediction")
    overall = recommend.overall_mean(train).scalar()
    return views.test_rows(spark, sf_dir).join(means, "user_id", "left").select(
        "user_id", "item_id", F.coalesce("prediction", overall).alias("prediction")
    )


PREDICTIONS_SQL = with_views("train", "test") + """,
    dd AS (SELECT user_id, item_id, max(stars) AS stars FROM train GROUP BY user_id, item_id),
    um AS (SELECT user_id, avg(stars) AS m FROM dd GROUP BY user_id),
    pred AS (SELECT t.user_id, t.item_id, coalesce(um.m, (SELECT avg(stars) FROM train)) AS prediction
             FROM test t LEFT JOIN um ON t.user_id = um.user_id)"""


@query(
    "jn5_prediction_truth",
    PREDICTIONS_SQL
    + """ SELECT user_id, item_id, round(prediction, 6) AS prediction, stars
    FROM pred JOIN truth USING (user_id, item_id)""",
)
def _(spark, sf_dir):
    return (
        toy_predictions(spark, sf_dir)
        .join(views.truth(spark, sf_dir), ["user_id", "item_id"])
        .withColumn("prediction", F.round("prediction", 6))
    )


@query(
    "jn6_missing_truth",
    PREDICTIONS_SQL
    + """ SELECT user_id, item_id FROM pred WHERE NOT EXISTS
    (SELECT 1 FROM truth WHERE truth.user_id = pred.user_id AND truth.item_id = pred.item_id)""",
)
def _(spark, sf_dir):
    return recommend.missing_truth(toy_predictions(spark, sf_dir), views.truth(spark, sf_dir))


def asked_neighbours(spark, sf_dir):
    """The ratings and the other ratings of the test users, which the queries below look up."""
    ratings = stored(recommend.distinct_ratings(views.train(spark, sf_dir)), "ratings")
    known = stored(recommend.known_rows(ratings, views.test_rows(spark, sf_dir)), "known")
    return ratings, recommend.other_ratings(ratings, known)


CO_RATER_SQL = with_views("train", "test") + """,
    dd AS (SELECT user_id, item_id, max(stars) AS stars FROM train GROUP BY user_id, item_id),
    needed AS (SELECT DISTINCT least(t.item_id, d.item_id) AS id1, greatest(t.item_id, d.item_id) AS id2
               FROM test t JOIN dd d ON t.user_id = d.user_id
               WHERE t.item_id <> d.item_id AND t.item_id IN (SELECT item_id FROM dd)),
    met AS (SELECT a.item_id AS id1, b.item_id AS id2, a.user_id AS member, a.stars AS x, b.stars AS y
            FROM dd a JOIN dd b ON a.user_id = b.user_id AND a.item_id < b.item_id
            JOIN needed n ON n.id1 = a.item_id AND n.id2 = b.item_id)"""


@query(
    "jn7_co_raters",
    CO_RATER_SQL + " SELECT id1, id2, member, x AS value1, y AS value2 FROM met",
)
def _(spark, sf_dir):
    ratings, asked = asked_neighbours(spark, sf_dir)
    return recommend.co_ratings(ratings, recommend.keyed_by_pair(asked))


@query(
    "jn8_containment",
    with_views("brand_baskets")
    + """, wanted AS (SELECT a.item AS x, b.item AS y FROM brand_baskets a JOIN brand_baskets b
              ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY a.item, b.item
              HAVING count(*) >= """
    + views.sql_basket_support(COMMON_PAIR)
    + """)
    SELECT a.basket_id, a.item || '|' || b.item AS itemset FROM brand_baskets a
    JOIN brand_baskets b ON a.basket_id = b.basket_id AND a.item < b.item
    JOIN wanted w ON w.x = a.item AND w.y = b.item""",
)
def _(spark, sf_dir):
    support = views.basket_support(spark, sf_dir, COMMON_PAIR)
    rows = views.brand_baskets(spark, sf_dir)
    wanted = itemsets.apriori(rows, support).where(F.col("size") == 2).select(F.lit(0).alias("bucket"), "itemset")
    tagged = rows.select(F.lit(0).alias("bucket"), "basket_id", "item")
    singles = tagged.select("bucket", "basket_id", F.array("item").alias("itemset"))
    found = itemsets.occurrences(singles, tagged, wanted)
    return found.select("basket_id", F.concat_ws("|", "itemset").alias("itemset"))


@query(
    "jn9_frontier_step",
    sql_edges()
    + """, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
    SELECT a.src AS root, b.dst AS node, count(*) AS sigma FROM both_ways a JOIN both_ways b ON a.dst = b.src
    WHERE b.dst <> a.src AND NOT EXISTS (SELECT 1 FROM both_ways c WHERE c.src = a.src AND c.dst = b.dst)
    GROUP BY a.src, b.dst""",
)
def _(spark, sf_dir):
    second = bfs_levels(cut(edges(spark, sf_dir)), most=2)[2]
    return second.select("root", "node", F.col("sigma").cast("bigint").alias("sigma"))


@query(
    "jn10_scalar_attach",
    with_views("train")
    + """ SELECT user_id, item_id, round(stars - (SELECT avg(stars) FROM train), 6) AS offset_stars FROM train""",
)
def _(spark, sf_dir):
    train = views.train(spark, sf_dir)
    overall = recommend.overall_mean(train).scalar()
    return train.select("user_id", "item_id", F.round(F.col("stars") - overall, 6).alias("offset_stars"))


# ---------------------------------------------------------------- aggregates


@query("agg1_count", with_views("reviews") + " SELECT count(*) AS n FROM reviews")
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).agg(F.count("*").alias("n"))


@query(
    "agg2_conditional_count",
    with_views("reviews") + f" SELECT count(*) FILTER (WHERE starts_with(date, '{YEAR}')) AS n FROM reviews",
)
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).agg(F.count_if(F.col("date").startswith(YEAR)).alias("n"))


@query(
    "agg3_count_distinct",
    with_views("reviews")
    + " SELECT count(DISTINCT user_id) AS users, count(DISTINCT business_id) AS firms FROM reviews",
)
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("business_id").alias("firms")
    )


@query(
    "agg4_group_count",
    with_views("reviews") + " SELECT user_id, count(*) AS cnt FROM reviews GROUP BY user_id",
)
def _(spark, sf_dir):
    return reports.group_counts(views.reviews(spark, sf_dir), "user_id")


@query(
    "agg5_group_average",
    with_views("reviews")
    + " SELECT business_id, round(avg(stars), 6) AS stars FROM reviews GROUP BY business_id",
)
def _(spark, sf_dir):
    return views.reviews(spark, sf_dir).groupBy("business_id").agg(F.round(F.avg("stars"), 6).alias("stars"))


@query("agg6_global_mean", with_views("train") + " SELECT round(avg(stars), 6) AS overall FROM train")
def _(spark, sf_dir):
    return recommend.overall_mean(views.train(spark, sf_dir)).select(F.round("overall", 6).alias("overall"))


@query(
    "agg7_key_means",
    with_views("train")
    + """, dd AS (SELECT user_id, item_id, max(stars) AS stars FROM train GROUP BY user_id, item_id)
    SELECT 'user' AS kind, user_id AS id, round(avg(stars), 6) AS mean FROM dd GROUP BY user_id
    UNION ALL SELECT 'item', item_id, round(avg(stars), 6) FROM dd GROUP BY item_id""",
)
def _(spark, sf_dir):
    ratings = recommend.distinct_ratings(views.train(spark, sf_dir))
    return overlap.union_all(
        [
            recommend.key_mean(ratings, f"{kind}_id", "mean").select(
                F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.round("mean", 6).alias("mean")
            )
            for kind in ("user", "item")
        ]
    )


@query("agg8_distinct", with_views("ratings") + " SELECT DISTINCT user_id, item_id AS item FROM ratings")
def _(spark, sf_dir):
    return views.pairs(spark, sf_dir)


@query(
    "agg9_collect_set",
    with_views("supplier_baskets")
    + f""" SELECT basket_id, n_items, chunk, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items
    FROM (SELECT basket_id, item, count(*) OVER (PARTITION BY basket_id) AS n_items,
          (row_number() OVER (PARTITION BY basket_id ORDER BY item) - 1) // {CHUNK} AS chunk FROM supplier_baskets)
    GROUP BY basket_id, n_items, chunk""",
)
def _(spark, sf_dir):
    sets = relational.chunked_sets(views.supplier_baskets(spark, sf_dir), "basket_id", "item", CHUNK)
    return sets.withColumn("items", F.concat_ws(",", F.col("items").cast("array<string>")))


@query(
    "agg10_collect_list",
    f"""SELECT l_orderkey, n_items, chunk, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS items
    FROM (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n_items,
          (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1) // {CHUNK} AS chunk FROM lineitem)
    GROUP BY l_orderkey, n_items, chunk""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lists = relational.chunked_sets(lines, "l_orderkey", "l_partkey", CHUNK)
    return lists.withColumn("items", F.concat_ws(",", F.col("items").cast("array<string>")))


@query(
    "agg11_min_per_key_and_hash",
    with_views("supplier_baskets")
    + """ SELECT basket_id, CAST(h AS INTEGER) AS hash_idx, min((item * (2 * h + 3) + h) % 10007) AS minval
    FROM supplier_baskets, range(0, 4) r(h) GROUP BY basket_id, h""",
)
def _(spark, sf_dir):
    minima = [
        F.min(hashing.linear_hash(F.col("item"), 2 * h + 3, h, 10007)).alias(f"h{h}") for h in range(4)
    ]
    wide = views.supplier_baskets(spark, sf_dir).groupBy("basket_id").agg(*minima)
    return wide.select(
        "basket_id", F.posexplode(F.array(*[f"h{h}" for h in range(4)])).alias("hash_idx", "minval")
    )


@query(
    "agg15_percentiles",
    with_views("train", "business_profiles")
    + """, rc AS (SELECT item_id, count(*) AS n FROM
        (SELECT DISTINCT user_id, item_id FROM train) GROUP BY item_id)
    SELECT (SELECT round(quantile_cont(n, 0.95), 6) FROM rc) AS p95,
           (SELECT round(quantile_cont(review_count, 0.1), 6) FROM business_profiles
            WHERE item_id IN (SELECT item_id FROM train)) AS p10""",
)
def _(spark, sf_dir):
    train = views.train(spark, sf_dir)
    raters = recommend.distinct_ratings(train).groupBy("item_id").agg(F.count("*").alias("n"))
    counts = model.item_features(views.business_profiles(spark, sf_dir), train)
    return raters.agg(F.round(F.percentile("n", 0.95), 6).alias("p95")).select(
        "p95", counts.agg(F.round(F.percentile("item_review_count", 0.1), 6)).scalar().alias("p10")
    )


@query(
    "agg16_pair_moments",
    CO_RATER_SQL
    + """ SELECT id1, id2, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy,
    CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy
    FROM met GROUP BY id1, id2""",
)
def _(spark, sf_dir):
    ratings, asked = asked_neighbours(spark, sf_dir)
    counted = lambda met, *_: recommend.pair_moments(met)
    moments = recommend.co_ratings(ratings, recommend.keyed_by_pair(asked), each=counted)
    sums = [F.col(c).cast("bigint").alias(c) for c in ("sx", "sy", "sxy", "sxx", "syy")]
    return moments.select("id1", "id2", "n", *sums)


@query(
    "agg17_rmse",
    PREDICTIONS_SQL
    + """ SELECT round(sqrt(avg((prediction - stars) * (prediction - stars))), 6) AS rmse, count(*) AS n
    FROM pred JOIN truth USING (user_id, item_id)""",
)
def _(spark, sf_dir):
    result = recommend.rmse(toy_predictions(spark, sf_dir), views.truth(spark, sf_dir))
    return result.select(F.round("rmse", 6).alias("rmse"), "n")


BUCKET_SQL = with_views("reviews") + """, counts AS (
        SELECT ('0x' || substr(md5(business_id), 1, 8))::BIGINT % 16 AS bucket, count(*) AS cnt
        FROM reviews GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bucket, coalesce(cnt, 0) AS n_items
    FROM range(0, 16) r(b) LEFT JOIN counts ON b = bucket"""


@query("agg18_rows_per_bucket", BUCKET_SQL)
def _(spark, sf_dir):
    return reports.hash_bucket_profile(views.reviews(spark, sf_dir), "business_id", 16)


@query("agg19_rows_per_partition")
def _(spark, sf_dir):
    return reports.layout_profile(table(spark, sf_dir, "lineitem").select("l_suppkey"))


# ---------------------------------------------------------------- windows


@query(
    "win1_top_n_per_group",
    """SELECT l_suppkey, l_partkey, cnt, CAST(rnk AS INTEGER) AS rnk FROM (
        SELECT l_suppkey, l_partkey, cnt,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY cnt DESC, l_partkey) AS rnk
        FROM (SELECT l_suppkey, l_partkey, count(*) AS cnt FROM lineitem GROUP BY l_suppkey, l_partkey))
    WHERE rnk <= 5""",
)
def _(spark, sf_dir):
    """The most frequent parts of a supplier, as neighbours of one pair each."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("sim"))
    weighted = counts.select(F.col("l_suppkey").alias("user_id"), F.lit(0).alias("item_id"), F.col("l_partkey").alias("other"), "sim")
    return recommend.top_neighbours(weighted, 5).select(
        F.col("user_id").alias("l_suppkey"), F.col("other").alias("l_partkey"), F.col("sim").alias("cnt"), F.col("rank").alias("rnk")
    )


@query(
    "win3_first_occurrence",
    with_views("stream") + " SELECT id, min(seq) AS first FROM stream GROUP BY id",
)
def _(spark, sf_dir):
    return sketches.first_seen(views.id_stream(spark, sf_dir))


@query(
    "win4_dense_index",
    with_views("sets")
    + """ SELECT member, row_number() OVER (ORDER BY encode(member)) - 1 AS idx
    FROM (SELECT DISTINCT member FROM sets)""",
)
def _(spark, sf_dir):
    return relational.dense_index(views.word_sets(spark, sf_dir), "member")


# ---------------------------------------------------------------- sorts


@query(
    "srt1_top_k",
    with_views("reviews")
    + """ SELECT user_id, count(*) AS cnt FROM reviews GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 10""",
)
def _(spark, sf_dir):
    return reports.top_counts(views.reviews(spark, sf_dir), "user_id")


@query("srt2_global_sort", CITY_SQL + " ORDER BY 2 DESC, 1")
def _(spark, sf_dir):
    cities = reports.city_average(views.reviews(spark, sf_dir), views.business(spark, sf_dir))
    return cities.select("city", F.round("stars", 6).alias("stars"))


@query(
    "srt4_sort_communities",
    LABELS_SQL
    + """ SELECT community, size, id FROM (
        SELECT min(id) OVER (PARTITION BY label) AS community, count(*) OVER (PARTITION BY label) AS size, id
        FROM labels) ORDER BY size, community, id""",
)
def _(spark, sf_dir):
    members = community_members(label_propagation(edges(spark, sf_dir)))
    return members.orderBy("size", "community", "id").select("community", "size", "id")


@query(
    "srt5_sort_edges",
    EDGES_SQL + " SELECT src, dst, shared FROM edges ORDER BY shared DESC, src, dst",
)
def _(spark, sf_dir):
    return edges(spark, sf_dir).orderBy(F.col("shared").desc(), "src", "dst")


@query(
    "srt6_sort_in_row",
    f"""SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high,
    list_sort([l_partkey, l_suppkey, l_orderkey])[1] || ',' || list_sort([l_partkey, l_suppkey, l_orderkey])[2]
    || ',' || list_sort([l_partkey, l_suppkey, l_orderkey])[3] AS ordered FROM lineitem""",
)
def _(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.least("l_partkey", "l_suppkey").alias("low"),
            F.greatest("l_partkey", "l_suppkey").alias("high"),
            F.concat_ws(
                ",", F.array_sort(F.array("l_partkey", "l_suppkey", "l_orderkey")).cast("array<string>")
            ).alias("ordered"),
        )
        .distinct()
    )


# ---------------------------------------------------------------- sets


@query(
    "set2_both_directions",
    EDGES_SQL + " SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges",
)
def _(spark, sf_dir):
    return relational.symmetric(edges(spark, sf_dir))


@query(
    "set4_subset_test",
    """WITH words AS (SELECT list_distinct(string_split(text, ' ')) AS w, item_id FROM benchmark)
    SELECT item_id, list_has_all(w, ['the']) AS has_the, list_has_all(w, ['the', 'of']) AS has_both FROM words""",
)
def _(spark, sf_dir):
    words = F.array_distinct(F.split("text", " "))

    def contains_all(*items):
        return F.size(F.array_except(F.array(*[F.lit(i) for i in items]), words)) == 0

    return table(spark, sf_dir, "benchmark").select(
        "item_id", contains_all("the").alias("has_the"), contains_all("the", "of").alias("has_both")
    )


@query(
    "set5_remove_edges",
    EDGES_SQL + " SELECT src, dst, shared FROM edges WHERE shared < (SELECT max(shared) FROM edges)",
)
def _(spark, sf_dir):
    graph = edges(spark, sf_dir)
    return remove_edges(graph, top_edges(graph.withColumn("betweenness", F.col("shared").cast("double"))))


# ---------------------------------------------------------------- functions


@query(
    "fn1_nested_json_default",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
    coalesce(TRY_CAST(event_type AS INTEGER), 0) AS bad FROM events""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.to_int_or_zero(F.get_json_object("props", "$.k")).alias("k"),
        text.to_int_or_zero(F.col("event_type")).alias("bad"),
    )


@query(
    "fn2_split_and_strip",
    f"""SELECT strftime(o_orderdate, '%-m/%-d/%Y') AS date, CAST(o_custkey AS VARCHAR) AS customer,
    lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS product FROM {LINES}""",
)
def _(spark, sf_dir):
    line = F.col("value")
    return views.transactions(spark, sf_dir).select(
        text.csv_field(line, 0).alias("date"),
        text.csv_field(line, 1).alias("customer"),
        text.csv_field(line, 5).alias("product"),
    )


@query(
    "fn3_shorten_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%y') AS short,
    strftime(o_orderdate, '%-m/%-d/') || substr(strftime(o_orderdate, '%Y'), 1, 2) AS variant FROM orders""",
)
def _(spark, sf_dir):
    date = F.date_format("o_orderdate", "M/d/yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.shorten_year(date).alias("short"), text.drop_last_two(date).alias("variant")
    )


@query(
    "fn4_composite_key",
    f"SELECT DISTINCT {SHORT_KEY} AS basket_id, l_partkey AS item FROM {LINES}",
)
def _(spark, sf_dir):
    line = F.col("value")
    return (
        views.transactions(spark, sf_dir)
        .select(
            text.date_customer_key(text.csv_field(line, 0), text.csv_field(line, 1)).alias("basket_id"),
            text.csv_field(line, 5).cast("bigint").alias("item"),
        )
        .distinct()
    )


@query(
    "fn8_linear_hash",
    "SELECT p_partkey, (p_partkey * 48271 + 11) % 10007 AS h FROM part",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", hashing.linear_hash(F.col("p_partkey"), 48271, 11, 10007).alias("h")
    )


@query(
    "fn8_linear_hash_wide",
    """SELECT o_orderkey, CAST((CAST(o_orderkey * 1000003 AS HUGEINT) * 3990000011 + 3999999999) % 4000000007 AS BIGINT) AS h
    FROM orders""",
)
def _(spark, sf_dir):
    wide = hashing.linear_hash(F.col("o_orderkey") * 1000003, 3990000011, 3999999999, 4000000007)
    return table(spark, sf_dir, "orders").select("o_orderkey", wide.alias("h"))


@query(
    "fn9_clamp",
    "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 8, 1.0), 5.0) AS x FROM lineitem",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.clamp(F.col("l_quantity") / 8).alias("x")
    )


@query(
    "fn10_asymmetric_weight",
    """SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN c_acctbal * 0.8 ELSE c_acctbal * 1.2 END, 4) AS w
    FROM customer""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(numeric.tilt(F.col("c_acctbal")), 4).alias("w")
    )


@query(
    "fn11_powers",
    """SELECT p_partkey, pow(2, p_size) AS p2, p_size * p_size AS sq, round(sqrt(p_size), 6) AS root,
    abs(p_size - 25) AS dist FROM part""",
)
def _(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.pow(F.lit(2.0), size).alias("p2"),
        (size * size).alias("sq"),
        F.round(F.sqrt(size), 6).alias("root"),
        F.abs(size - 25).alias("dist"),
    )


@query(
    "fn12_round_half_even",
    """SELECT p_partkey, CAST(round_even(p_size / 2, 0) AS BIGINT) AS even,
    CAST(round(p_size / 2) AS BIGINT) AS up FROM part""",
)
def _(spark, sf_dir):
    half = F.col("p_size") / 2
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numeric.round_half_even(half).alias("even"),
        F.round(half, 0).cast("bigint").alias("up"),
    )


@query(
    "fn13_round_five",
    "SELECT l_orderkey, l_partkey, round(l_extendedprice / 7, 5) AS r FROM lineitem",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") / 7, 5).alias("r")
    )


@query(
    "fn14_labels",
    """SELECT p_partkey, '(''' || p_brand || ''')' AS single,
    '(''' || p_brand || ''', ''' || p_type || ''')' AS double_label, '''' || p_name || '''' AS quoted FROM part""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.itemset_label(F.array("p_brand")).alias("single"),
        text.itemset_label(F.array("p_brand", "p_type")).alias("double_label"),
        text.quoted(F.col("p_name")).alias("quoted"),
    )


@query(
    "fn15_combinations",
    with_views("brand_baskets")
    + """, level AS (SELECT a.item AS x, b.item AS y FROM brand_baskets a JOIN brand_baskets b
              ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= """
    + views.sql_basket_support(COMMON_PAIR)
    + """)
    SELECT a.x || '|' || a.y || '|' || b.y AS itemset FROM level a JOIN level b ON a.x = b.x AND a.y < b.y
    JOIN level c ON c.x = a.y AND c.y = b.y""",
)
def _(spark, sf_dir):
    support = views.basket_support(spark, sf_dir, COMMON_PAIR)
    found = itemsets.apriori(views.brand_baskets(spark, sf_dir), support)
    level = found.where(F.col("size") == 2).select(F.lit(0).alias("bucket"), "itemset")
    return itemsets.candidates_from(level, 3).select(F.concat_ws("|", "itemset").alias("itemset"))
