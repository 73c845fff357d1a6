"""Stand-in views over the shared test tables, in Spark and as SQL for the checks.

Each Spark view has a SQL twin in ``CTES`` under the same name; ``with_views`` builds
the WITH clause of a check query from the names it needs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import dealt

LAST_TRAIN_DAY = "2000-12-31"
REPORT_YEAR = "1997"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def stars() -> F.Column:
    return F.ceil(F.col("l_quantity") / 10).cast("double")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("business_id"),
        stars().alias("stars"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers; those in debt go by another key, so their reviews find no business."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(
        F.concat(F.when(F.col("s_acctbal") < 0, "closed-").otherwise(""), F.col("s_suppkey").cast("string")).alias("business_id"),
        F.col("n_name").alias("city"),
    )


def as_ratings(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), stars().alias("stars")
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ratings(order_lines(spark, sf_dir))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings up to the end of 2000; repeats stay in."""
    return as_ratings(order_lines(spark, sf_dir).where(F.col("o_orderdate") < first_test_day()))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later ratings, one per user and item."""
    later = as_ratings(order_lines(spark, sf_dir).where(F.col("o_orderdate") >= first_test_day()))
    return later.groupBy("user_id", "item_id").agg(F.max("stars").alias("stars"))


def first_test_day() -> F.Column:
    """As a timestamp, so the filter reaches the scan of the orders."""
    return F.date_add(F.lit(LAST_TRAIN_DAY).cast("date"), 1).cast("timestamp_ntz")


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later pairs, and per nation a row with an unknown user, item, or both."""
    key = F.col("n_nationkey").cast("bigint") + 1
    cold = table(spark, sf_dir, "nation").select(
        F.explode(
            F.array(
                F.struct((-key).alias("user_id"), key.alias("item_id")),
                F.struct(key.alias("user_id"), (-key).alias("item_id")),
                F.struct((-key).alias("user_id"), (-key).alias("item_id")),
            )
        ).alias("row")
    )
    return truth(spark, sf_dir).select("user_id", "item_id").unionByName(cold.select("row.*"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and items; neither the join nor the sets in a task grow with the tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    n = lines.count()
    lines, orders = dealt(lines, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("user_id", "item")
    return dealt(rows, n, "user_id", "item").distinct()


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        .select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item"))
        .distinct()
    )


def supplier_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("basket_id"), F.col("l_suppkey").alias("item"))
        .distinct()
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted transaction lines: date, customer, three unused fields, padded product."""
    fields = [
        F.date_format("o_orderdate", "M/d/yyyy"),
        F.col("o_custkey").cast("string"),
        F.col("o_orderstatus"),
        F.col("l_returnflag"),
        F.col("l_linestatus"),
        F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
    ]
    quoted = [F.concat(F.lit('"'), f, F.lit('"')) for f in fields]
    return order_lines(spark, sf_dir).select(F.concat_ws(",", *quoted).alias("value"))


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ratings(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("review_count"), F.avg("stars").alias("average_stars")
    )
    customers = table(spark, sf_dir, "customer")
    return counts.join(customers, counts["user_id"] == customers["c_custkey"]).select(
        "user_id", "review_count", "average_stars", F.floor("c_acctbal").alias("useful")
    )


def business_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part profiles whose price attribute is at times missing or not a number."""
    counts = ratings(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("review_count"), F.avg("stars").alias("stars")
    )
    parts = table(spark, sf_dir, "part")
    price = (
        F.when(F.col("p_partkey") % 7 == 0, None)
        .when(F.col("p_partkey") % 11 == 0, "None")
        .otherwise(F.col("p_size").cast("string"))
    )
    attributes = F.when(F.col("p_partkey") % 7 != 0, F.create_map(F.lit("RestaurantsPriceRange2"), price))
    return counts.join(parts, counts["item_id"] == parts["p_partkey"]).select(
        "item_id", "stars", "review_count", attributes.alias("attributes")
    )


def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the outer form keeps Spark from splitting every text twice to filter empty arrays
    words = F.array_distinct(F.split("text", " "))
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("set_id"), F.explode_outer(words).alias("member"))
        .where(F.col("member").isNotNull())
    )


def id_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("props")).alias("id"),
    )


def basket_support(spark: SparkSession, sf_dir: str, of_10000: int) -> int:
    """A fixed share of the baskets, rounded up; ``sql_basket_support`` is its twin."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().count()
    return max(1, -(-n * of_10000 // 10000))


def sql_basket_support(of_10000: int) -> str:
    return f"(SELECT greatest(1, (count(DISTINCT l_orderkey) * {of_10000} + 9999) // 10000) FROM lineitem)"


LEAST_ITEMS = 3  # baskets of the transaction job have more items
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"

CTES = {
    "reviews": f"""reviews AS (
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_suppkey AS VARCHAR) AS business_id,
               ceil(l_quantity / 10) AS stars, strftime(o_orderdate, '%Y-%m-%d') AS date
        FROM {LINES})""",
    "business": """business AS (
        SELECT CASE WHEN s_acctbal < 0 THEN 'closed-' ELSE '' END || CAST(s_suppkey AS VARCHAR) AS business_id,
               n_name AS city
        FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "dated": f"""dated AS (
        SELECT o_custkey AS user_id, l_partkey AS item_id, ceil(l_quantity / 10) AS stars,
               strftime(o_orderdate, '%Y-%m-%d') AS day FROM {LINES})""",
    "ratings": "ratings AS (SELECT user_id, item_id, stars FROM dated)",
    "train": f"train AS (SELECT user_id, item_id, stars FROM dated WHERE day <= '{LAST_TRAIN_DAY}')",
    "truth": f"""truth AS (
        SELECT user_id, item_id, max(stars) AS stars FROM dated WHERE day > '{LAST_TRAIN_DAY}'
        GROUP BY user_id, item_id)""",
    "test": """test AS (
        SELECT user_id, item_id FROM truth
        UNION ALL SELECT -(CAST(n_nationkey AS BIGINT) + 1), n_nationkey + 1 FROM nation
        UNION ALL SELECT n_nationkey + 1, -(CAST(n_nationkey AS BIGINT) + 1) FROM nation
        UNION ALL SELECT -(CAST(n_nationkey AS BIGINT) + 1), -(CAST(n_nationkey AS BIGINT) + 1) FROM nation)""",
    "pairs": "pairs AS (SELECT DISTINCT user_id, item_id AS item FROM ratings)",
    "brand_baskets": """brand_baskets AS (
        SELECT DISTINCT l_orderkey AS basket_id, p_brand AS item
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "transaction_baskets": f"""transaction_baskets AS (
        SELECT basket_id, item FROM (
            SELECT DISTINCT month(o_orderdate) || '/' || day(o_orderdate) || '/'
                   || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-' || o_custkey AS basket_id, l_partkey AS item
            FROM {LINES})
        QUALIFY count(*) OVER (PARTITION BY basket_id) > {LEAST_ITEMS})""",
    "supplier_baskets": """supplier_baskets AS (
        SELECT DISTINCT l_orderkey AS basket_id, l_suppkey AS item FROM lineitem)""",
    "user_profiles": """user_profiles AS (
        SELECT r.user_id, r.review_count, r.average_stars, CAST(floor(c_acctbal) AS BIGINT) AS useful
        FROM (SELECT user_id, count(*) AS review_count, avg(stars) AS average_stars
              FROM ratings GROUP BY user_id) r JOIN customer ON r.user_id = c_custkey)""",
    "business_profiles": """business_profiles AS (
        SELECT r.item_id, r.stars, r.review_count,
               CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'None'
                    ELSE CAST(p_size AS VARCHAR) END AS price
        FROM (SELECT item_id, count(*) AS review_count, avg(stars) AS stars
              FROM ratings GROUP BY item_id) r JOIN part ON r.item_id = p_partkey)""",
    "sets": """sets AS (
        SELECT doc_id AS set_id, unnest(list_distinct(string_split(text, ' '))) AS member FROM documents)""",
    "stream": "stream AS (SELECT event_id AS seq, user_id || '-' || props AS id FROM events)",
}

NEEDS = {
    "ratings": ["dated"],
    "train": ["dated"],
    "truth": ["dated"],
    "test": ["dated", "truth"],
    "pairs": ["dated", "ratings"],
    "user_profiles": ["dated", "ratings"],
    "business_profiles": ["dated", "ratings"],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and what they need."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n] for n in ordered)
