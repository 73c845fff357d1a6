"""Item-based collaborative filtering on (user_id, item_id, stars) ratings."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clamp, tilt
from ..runtime import cut, stored
from .overlap import HEAVY, PAIRS_A_TASK, id_sizes, probe_pairs, union_all

PAIRS_A_ROUND = 16 * PAIRS_A_TASK  # ratings that meet at a time, if that is more than
PAIRS_A_RATING = 4  # so many times the ratings


def distinct_ratings(train: DataFrame) -> DataFrame:
    """One rating per user and item; of repeats the highest counts."""
    return train.groupBy("user_id", "item_id").agg(F.max("stars").alias("stars"))


def overall_mean(train: DataFrame) -> DataFrame:
    """Mean over the raw rows, repeats included, as a one-row table."""
    return train.agg(F.avg("stars").alias("overall"))


def key_mean(ratings: DataFrame, key: str, out: str) -> DataFrame:
    """Mean per user or item over de-duplicated ratings."""
    return ratings.groupBy(key).agg(F.avg("stars").alias(out))


def known_rows(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """The different test rows whose item has ratings."""
    return (
        test.select("user_id", "item_id")
        .distinct()
        .join(ratings.select("item_id").distinct(), "item_id", "left_semi")
    )


def other_ratings(ratings: DataFrame, known: DataFrame) -> DataFrame:
    """``(user_id, item_id, other, stars)``: the user's other ratings for each of the known rows."""
    rated = ratings.select("user_id", F.col("item_id").alias("other"), "stars")
    return known.join(rated, "user_id").where(F.col("other") != F.col("item_id"))


def test_neighbours(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """``(user_id, item_id, other, stars)``: the user's other ratings for each known test row."""
    return other_ratings(ratings, known_rows(ratings, test))


def keyed_by_pair(neighbours: DataFrame) -> DataFrame:
    """``neighbours`` with the item pair id1 < id2 whose similarity they ask for."""
    return neighbours.withColumn("id1", F.least("item_id", "other")).withColumn("id2", F.greatest("item_id", "other"))


def needed_pairs(neighbours: DataFrame) -> DataFrame:
    """The item pairs (id1 < id2) whose similarity the test rows ask for."""
    return keyed_by_pair(neighbours).select("id1", "id2").distinct()


def co_ratings(
    ratings: DataFrame, pairs: DataFrame, heavy: int = HEAVY, each: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """``(id1, id2, member, value1, value2)``: every user who rated both items of a wanted pair.

    Users with at most ``heavy`` ratings meet in a bounded self-join that keeps the
    wanted pairs. Users with more never pair up their own ratings: for them each
    wanted pair is looked up from its less rated item. ``pairs`` may name a pair twice.

    Pairs are taken in rounds by a hash of id1, so what lies in shuffle files at a time is bound
    by the number of ratings, not by how many of them meet. With ``each`` the result is made of
    what ``each(met, asked, mine)`` gives for a round: the ratings that met, the pairs asked for
    (which may repeat), and a function that tells whether an id1 belongs to the round.
    """
    rows = ratings.select(
        F.col("item_id").alias("id"), F.col("user_id").alias("member"), F.col("stars").alias("value")
    )
    n = F.col("n")
    big = cut(rows.groupBy("member").agg(F.count("*").alias("n")).where(n > heavy).select("member"))
    light, big_rows = rows, None
    if not big.isEmpty():
        big_rows = cut(rows.join(big, "member", "left_semi"))
        light = rows.join(big, "member", "left_anti")
    sums = light.groupBy("member").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(n * (n - 1) / 2)).first()
    held, made = sums[0] or 0, sums[1] or 0
    wanted = pairs.count()
    turns = max(1, ceil(made / max(PAIRS_A_ROUND, PAIRS_A_RATING * held)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(parts, ceil(max(made, wanted) / turns / PAIRS_A_TASK))

    done = []
    for turn in range(turns):

        def mine(id1: str) -> Column:
            return F.pmod(F.xxhash64(id1), F.lit(turns)) == turn

        asked = pairs.select("id1", "id2").where(mine("id1")).repartition(dealt, "id1", "id2")
        met = bounded_co_ratings(light, asked, mine, made / turns, dealt)
        if big_rows is not None:
            met = met.unionByName(probe_pairs(asked.distinct(), big_rows, id_sizes(big_rows), value="value"))
        result = each(met, asked, mine) if each else met
        done.append(result if turns == 1 else stored(result, "co-ratings"))
    return union_all(done)


def bounded_co_ratings(
    rows: DataFrame, asked: DataFrame, mine: Callable[[str], Column], made: float, dealt: int
) -> DataFrame:
    """The ratings that meet are dealt out by their number and looked up in hashed pairs, not sorted."""
    if made > PAIRS_A_TASK:
        rows = rows.repartition(ceil(made / PAIRS_A_TASK), "member")
    a = rows.where(mine("id")).select(F.col("id").alias("id1"), "member", F.col("value").alias("value1"))
    b = rows.select(F.col("id").alias("id2"), "member", F.col("value").alias("value2"))
    met = a.join(b, "member").where(F.col("id1") < F.col("id2"))
    return met.repartition(dealt, "id1", "id2").join(asked.hint("shuffle_hash"), ["id1", "id2"], "left_semi").select(
        "id1", "id2", "member", "value1", "value2"
    )


def pair_moments(met: DataFrame) -> DataFrame:
    x, y = F.col("value1"), F.col("value2")
    return met.groupBy("id1", "id2").agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
    )


def pearson(min_common: int = 1) -> Column:
    """Pearson correlation from moments; a constant side makes it 1, no co-rater 0."""
    n = F.col("n")
    spread_x = n * F.col("sxx") - F.col("sx") * F.col("sx")
    spread_y = n * F.col("syy") - F.col("sy") * F.col("sy")
    covariance = n * F.col("sxy") - F.col("sx") * F.col("sy")
    return (
        F.when(F.coalesce(n, F.lit(0)) < min_common, 0.0)
        .when((spread_x <= 0) | (spread_y <= 0), 1.0)
        .otherwise(F.least(F.lit(1.0), F.try_divide(covariance, F.sqrt(spread_x) * F.sqrt(spread_y))))
    )


def pearson_item_pairs(
    ratings: DataFrame, pairs: DataFrame, min_common: int = 1, heavy: int = HEAVY, unmet: bool = True
) -> DataFrame:
    """``(item_i, item_j, n, sim)`` for each wanted pair, means over the co-raters only.

    Without ``unmet`` the pairs that nobody rated both of, whose similarity is zero, are left out.
    """

    def similar(met: DataFrame, asked: DataFrame, mine: Callable[[str], Column]) -> DataFrame:
        moments = pair_moments(met)
        rows = asked.distinct().join(moments, ["id1", "id2"], "left") if unmet else moments
        return rows.select(
            F.col("id1").alias("item_i"),
            F.col("id2").alias("item_j"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
            pearson(min_common).alias("sim"),
        )

    return co_ratings(ratings, pairs, heavy, similar)


def similar_ratings(ratings: DataFrame, known: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``(user_id, item_id, other, stars, sim)``: the other ratings whose similarity is not zero."""
    neighbours = keyed_by_pair(other_ratings(ratings, known))

    def found(met: DataFrame, asked: DataFrame, mine: Callable[[str], Column]) -> DataFrame:
        sims = pair_moments(met).select("id1", "id2", pearson().alias("sim")).where(F.col("sim") != 0)
        sims = stored(sims, "similar-items")
        return neighbours.where(mine("id1")).join(sims, ["id1", "id2"]).drop("id1", "id2")

    return co_ratings(ratings, neighbours, heavy, found)


def top_neighbours(weighted: DataFrame, n: int, offered: str | None = None) -> DataFrame:
    """The n most similar neighbours per (user, item), ties by neighbour id.

    With ``offered`` the rows are those whose similarity is not zero, out of so many: those of
    zero similarity, which are not there, stand before the negative ones and are counted.
    """
    row = Window.partitionBy("user_id", "item_id")
    rank = F.row_number().over(row.orderBy(F.col("sim").desc(), "other"))
    if offered is not None:
        rank = rank + F.when(F.col("sim") < 0, F.col(offered) - F.count("*").over(row)).otherwise(0)
    return weighted.withColumn("rank", rank).where(F.col("rank") <= n)


def offered_neighbours(ratings: DataFrame, known: DataFrame) -> DataFrame:
    """``(user_id, item_id, offered)``: how many other items the user of each known row has rated."""
    rated = ratings.where(F.col("item_id").isNotNull())
    held = rated.groupBy("user_id").agg(F.count("*").alias("held"))
    own = rated.select("user_id", "item_id", F.lit(1).alias("own"))
    offered = F.col("held") - F.coalesce("own", F.lit(0))
    return known.join(held, "user_id").join(own, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", offered.alias("offered")
    )


def cf_predict(
    train: DataFrame, test: DataFrame, n: int = 50, variant: str = "standard", heavy: int = HEAVY
) -> DataFrame:
    """``(user_id, item_id, prediction, neighbor_count)``, one row per test row.

    ``standard`` keeps neighbours of zero similarity and starts from
    ``item mean + user mean - overall``; ``midpoint`` drops them and starts from the
    midpoint of the two means. Unknown items get the user mean, unknown users the
    item mean, both unknown the overall mean.
    """
    if variant not in ("standard", "midpoint"):
        raise ValueError(f"unknown variant {variant!r}")
    ratings = stored(distinct_ratings(train), "ratings")
    test = stored(test.select("user_id", "item_id"), "asked")
    overall = overall_mean(train).scalar()
    users = key_mean(ratings, "user_id", "user_mean")
    items = key_mean(ratings, "item_id", "item_mean")

    known = stored(known_rows(ratings, test), "known")
    found = similar_ratings(ratings, known, heavy).withColumn("sim", tilt(F.col("sim")))
    if variant == "midpoint":
        best = top_neighbours(found, n)
    else:
        counts = stored(offered_neighbours(ratings, known), "offered")
        best = top_neighbours(found.join(counts, ["user_id", "item_id"]), n, "offered")
    residual = F.col("stars") - (F.col("other_mean") + F.col("user_mean") - overall)
    gathered = (
        best.join(items.select(F.col("item_id").alias("other"), F.col("item_mean").alias("other_mean")), "other")
        .join(users, "user_id")
        .groupBy("user_id", "item_id")
        .agg(
            F.sum(F.col("sim") * residual).alias("weighted"),
            F.sum(F.abs("sim")).alias("weight"),
            F.count("*").alias("neighbor_count"),
        )
    )
    if variant == "standard":
        shown = counts.withColumn("neighbor_count", F.least("offered", F.lit(n).cast("bigint"))).drop("offered")
        gathered = shown.join(gathered.drop("neighbor_count"), ["user_id", "item_id"], "left")
        baseline = F.col("item_mean") + F.col("user_mean") - overall
    else:
        baseline = (F.col("user_mean") + F.col("item_mean")) / 2
    shift = F.when(F.col("weight") != 0, F.try_divide("weighted", "weight")).otherwise(0.0)
    warm = clamp(baseline + F.coalesce(shift, F.lit(0.0)))
    prediction = F.when(
        F.col("item_mean").isNotNull() & F.col("user_mean").isNotNull(), warm
    ).otherwise(F.coalesce("user_mean", "item_mean", overall))
    return (
        test.select("user_id", "item_id")
        .join(users, "user_id", "left")
        .join(items, "item_id", "left")
        .join(gathered, ["user_id", "item_id"], "left")
        .select(
            "user_id",
            "item_id",
            prediction.alias("prediction"),
            F.coalesce("neighbor_count", F.lit(0).cast("bigint")).alias("neighbor_count"),
        )
    )


def rmse(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``(rmse, n)`` over the keys present in both tables."""
    error = F.col("prediction") - F.col("stars")
    return pred.join(truth, ["user_id", "item_id"]).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n")
    )


def missing_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions whose key has no true rating."""
    return pred.join(truth, ["user_id", "item_id"], "left_anti").select("user_id", "item_id")
