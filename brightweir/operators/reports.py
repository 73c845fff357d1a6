"""Review reports, city averages and partition profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import md5_bucket
from ..runtime import cut


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("cnt"))


def top_counts(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys, ties by key."""
    return best_keys(group_counts(df, key), key, k)


def best_keys(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.col("cnt").desc(), key).limit(k)


def top_array(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """One row: the k most frequent keys as an array of (id, cnt), best first."""
    best = best_keys(counts, key, k).select(
        F.struct((-F.col("cnt")).alias("neg"), F.col(key).alias("id"), "cnt").alias("entry")
    )
    ordered = F.array_sort(F.collect_list("entry"))
    return best.agg(
        F.transform(ordered, lambda e: F.struct(e["id"].alias("id"), e["cnt"].alias("cnt"))).alias("top")
    )


def review_report(reviews: DataFrame, year: str = "2018", k: int = 10) -> DataFrame:
    """Counts, distinct counts and the two top-k lists in one row.

    The reviews are read once: every review counts for its user and its business in
    one grouping, and all figures are taken off the table of grouped counts.
    """
    in_year = F.col("date").startswith(year)
    sides = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")),
        F.struct(F.lit("business").alias("kind"), F.col("business_id").alias("id")),
    )
    counts = cut(
        reviews.select(in_year.alias("in_year"), F.inline(sides))
        .groupBy("kind", "id")
        .agg(F.count("*").alias("cnt"), F.count_if("in_year").alias("cnt_year"))
    )
    users = F.col("kind") == "user"
    businesses = F.col("kind") == "business"
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum(F.when(users, F.col("cnt"))), zero).alias("n_review"),
        F.coalesce(F.sum(F.when(users, F.col("cnt_year"))), zero).alias("n_review_year"),
        F.count(F.when(users, F.col("id"))).alias("n_user"),
        F.count(F.when(businesses, F.col("id"))).alias("n_business"),
    ).select(
        "n_review",
        "n_review_year",
        "n_user",
        top_array(counts.where(users), "id", k).scalar().alias("top_user"),
        "n_business",
        top_array(counts.where(businesses), "id", k).scalar().alias("top_business"),
    )


def review_city(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Every review with its city; an unmatched review gets the empty city."""
    return reviews.join(business.select("business_id", "city"), "business_id", "left").withColumn(
        "city", F.coalesce("city", F.lit(""))
    )


def city_average(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Mean stars per city, best first, ties by city.

    Reviews are summed per business before the join, so a business with a third
    of all reviews enters it as one row.
    """
    per_business = reviews.groupBy("business_id").agg(
        F.sum("stars").alias("stars_sum"), F.count("stars").alias("stars_n")
    )
    return (
        review_city(per_business, business)
        .groupBy("city")
        .agg((F.sum("stars_sum") / F.sum("stars_n")).alias("stars"))
        .orderBy(F.col("stars").desc(), "city")
    )


def bucket_counts(df: DataFrame, bucket: Column, n: int) -> DataFrame:
    """Rows per bucket 0..n-1, empty buckets included."""
    counts = df.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("cnt"))
    return (
        df.sparkSession.range(n)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .select("bucket", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("n_items"))
    )


def hash_bucket_profile(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per md5 bucket of the key; the same in any engine."""
    return bucket_counts(df, md5_bucket(F.col(key), n), n)


def hash_partition_profile(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows each partition of ``repartition(n, key)`` would hold.

    Spark places a row at ``pmod(hash(key), n)``, so the profile needs no move of
    the rows themselves.
    """
    return bucket_counts(df, F.pmod(F.hash(key), F.lit(n)), n)


def layout_profile(df: DataFrame) -> DataFrame:
    """Rows per partition of the layout the scan produces."""
    return df.groupBy(F.spark_partition_id().alias("bucket")).agg(F.count("*").alias("n_items"))


def partition_profile(df: DataFrame, key: str, n: int, portable: bool = False) -> DataFrame:
    """Default layout next to the layout hashed on the key."""
    custom = hash_bucket_profile(df, key, n) if portable else hash_partition_profile(df, key, n)
    return (
        layout_profile(df)
        .select(F.lit("default").alias("layout"), "bucket", "n_items")
        .unionByName(custom.select(F.lit("customized").alias("layout"), "bucket", "n_items"))
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """Number of partitions and the counts in bucket order, one row per layout."""
    return profile.groupBy("layout").agg(
        F.count("*").alias("n_partition"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", "n_items"))), lambda e: e["n_items"]
        ).alias("n_items"),
    )
