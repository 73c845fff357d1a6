import math
import random

import pytest
from pyspark.sql import functions as F

from brightweir.operators import model, recommend


def ratings(seed=4, users=12, items=15):
    rng = random.Random(seed)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(users) for i in range(items) if rng.random() < 0.5]
    return rows + [(0, i, float(1 + i % 5)) for i in range(items) if (0, i) not in {(u, j) for u, j, _ in rows}]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, stars double")


def correlation(x, y):
    common = x.keys() & y.keys()
    if not common:
        return 0.0
    n = len(common)
    sx, sy = sum(x[u] for u in common), sum(y[u] for u in common)
    vx = n * sum(x[u] ** 2 for u in common) - sx * sx
    vy = n * sum(y[u] ** 2 for u in common) - sy * sy
    if vx == 0 or vy == 0:
        return 1.0
    return min(1.0, (n * sum(x[u] * y[u] for u in common) - sx * sy) / (math.sqrt(vx) * math.sqrt(vy)))


def brute_predictions(train, test, n, midpoint):
    by_item, by_user = {}, {}
    for u, i, s in train:
        by_item.setdefault(i, {})[u] = s
        by_user.setdefault(u, {})[i] = s
    overall = sum(s for *_, s in train) / len(train)
    item_mean = {i: sum(r.values()) / len(r) for i, r in by_item.items()}
    user_mean = {u: sum(r.values()) / len(r) for u, r in by_user.items()}
    out = {}
    for u, i in test:
        if i not in item_mean or u not in user_mean:
            out[(u, i)] = user_mean.get(u, item_mean.get(i, overall))
            continue
        scored = []
        for j, s in by_user[u].items():
            sim = correlation(by_item[i], by_item[j])
            if j == i or (midpoint and sim == 0):
                continue
            scored.append((-(sim * (0.8 if sim < 0 else 1.2)), j, s - (item_mean[j] + user_mean[u] - overall)))
        best = sorted(scored)[:n]
        weight = sum(abs(s) for s, *_ in best)
        base = (item_mean[i] + user_mean[u]) / 2 if midpoint else item_mean[i] + user_mean[u] - overall
        value = base + (sum(-s * r for s, _, r in best) / weight if weight else 0.0)
        out[(u, i)] = min(max(value, 1.0), 5.0)
    return out


@pytest.mark.parametrize("variant", ["standard", "midpoint"])
@pytest.mark.parametrize("n,heavy", [(3, 1000), (50, 5)])
def test_predictions_equal_plain_loop(spark, variant, n, heavy):
    train = ratings()
    test = [(u, i) for u in range(12) for i in range(0, 15, 4)] + [(-1, 3), (2, -1), (-1, -1)]
    df = spark.createDataFrame(test, "user_id bigint, item_id bigint")
    got = recommend.cf_predict(frame(spark, train), df, n, variant, heavy).collect()
    expected = brute_predictions(train, test, n, variant == "midpoint")
    assert len(got) == len(test)
    for r in got:
        assert r.prediction == pytest.approx(expected[(r.user_id, r.item_id)], abs=1e-9)


def test_pearson_rules(spark):
    rows = [(u, 1, 3.0) for u in (1, 2)] + [(u, 2, float(u)) for u in (1, 2)] + [(9, 3, 4.0)]
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id1 bigint, id2 bigint")
    got = {(r.item_i, r.item_j): (r.n, r.sim) for r in recommend.pearson_item_pairs(frame(spark, rows), pairs).collect()}
    assert got == {(1, 2): (2, 1.0), (1, 3): (0, 0.0)}
    strict = recommend.pearson_item_pairs(frame(spark, rows), pairs, min_common=3).collect()
    assert {r.sim for r in strict} == {0.0}


def test_repeated_test_rows_are_kept_and_bad_variant_rejected(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "user_id bigint, item_id bigint")
    assert recommend.cf_predict(frame(spark, ratings()), df).count() == 2
    with pytest.raises(ValueError):
        recommend.cf_predict(frame(spark, ratings()), df, variant="other")


def profiles(spark, rows):
    users = frame(spark, rows).groupBy("user_id").agg(
        F.count("*").alias("review_count"), F.avg("stars").alias("average_stars"), F.lit(3).cast("bigint").alias("useful")
    )
    items = frame(spark, rows).groupBy("item_id").agg(
        F.avg("stars").alias("stars"),
        F.count("*").alias("review_count"),
        F.create_map(F.lit("RestaurantsPriceRange2"), F.when(F.col("item_id") > 3, "2").otherwise("None")).alias(
            "attributes"
        ),
    )
    return users, items


def test_features_default_and_parse(spark):
    rows = ratings()
    users, items = profiles(spark, rows)
    test = spark.createDataFrame([(1, 2), (1, 5), (-1, -1)], "user_id bigint, item_id bigint")
    got = {
        (r.user_id, r.item_id): list(r.features)
        for r in model.feature_table(test, users, items, frame(spark, rows)).collect()
    }
    assert got[(-1, -1)] == [0.0] * 6
    assert got[(1, 2)][5] == 0.0 and got[(1, 5)][5] == 2.0
    assert got[(1, 2)][2] == 3.0


def test_trees_beat_the_mean_and_hybrid_stays_in_range(spark):
    rng = random.Random(9)
    rows = [(u, i, float(min(5, max(1, round(1 + u % 4 + rng.random()))))) for u in range(20) for i in range(20)]
    users, items = profiles(spark, rows)
    train = frame(spark, [r for r in rows if (r[0] + r[1]) % 5])
    truth = frame(spark, [r for r in rows if (r[0] + r[1]) % 5 == 0])
    test = truth.select("user_id", "item_id")
    predicted = model.gbt_predict(train, test, users, items, depth=3, rounds=5)
    error = recommend.rmse(predicted, truth).first()
    mean = train.agg(F.avg("stars")).first()[0]
    flat = recommend.rmse(test.withColumn("prediction", F.lit(mean)), truth).first()
    assert error.n == truth.count() and error.rmse < flat.rmse
    mixed = model.hybrid_predict(train, test, users, items, depth=3, rounds=3).collect()
    assert len(mixed) == truth.count()
    assert all(1.0 <= r.prediction <= 5.0 and 0.0 <= r.alpha <= 1.0 for r in mixed)


def test_missing_truth(spark):
    pred = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0)], "user_id bigint, item_id bigint, prediction double")
    truth = frame(spark, [(1, 1, 5.0)])
    assert [tuple(r) for r in recommend.missing_truth(pred, truth).collect()] == [(1, 2)]
    assert recommend.rmse(pred, truth).first() == (2.0, 1)


@pytest.mark.parametrize("heavy", [1000, 8])
def test_ratings_meet_in_rounds_that_hold_few_of_them(spark, monkeypatch, heavy):
    """The rounds together give what one round gives, and none holds all the ratings that meet."""
    rows = frame(spark, ratings(users=40, items=30))
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, 30) if (a + b) % 3], "id1 bigint, id2 bigint")
    whole = sorted(map(tuple, recommend.co_ratings(rows, pairs, heavy).collect()))

    def similar():
        found = recommend.pearson_item_pairs(rows, pairs, heavy=heavy).collect()
        return sorted((r.item_i, r.item_j, r.n, round(r.sim, 9)) for r in found)

    moments = similar()
    monkeypatch.setattr(recommend, "PAIRS_A_ROUND", 50)
    monkeypatch.setattr(recommend, "PAIRS_A_RATING", 1)
    sizes = []

    def each(met, asked, mine):
        sizes.append((met.count(), asked.count(), met.where(~mine("id1")).count()))
        return met

    assert sorted(map(tuple, recommend.co_ratings(rows, pairs.union(pairs), heavy, each).collect())) == whole
    assert similar() == moments
    assert sum(n for n, _, _ in sizes) == len(whole) and not any(other for *_, other in sizes)
    if heavy == 1000:
        assert len(sizes) > 4 and max(n for n, _, _ in sizes) < len(whole) / 2


def test_zero_similarities_are_counted_without_being_listed(spark):
    """Neighbours nobody shares stand between the positive and the negative ones."""
    # users 1 to 3 make items 1 and 2 alike, 1 and 3 opposed; nobody but user 9 rated 4 and 5
    alike = [(u, 1, float(u)) for u in (1, 2, 3)] + [(u, 2, float(u)) for u in (1, 2, 3)] + [(u, 3, float(6 - u)) for u in (1, 2, 3)]
    train = alike + [(9, 2, 5.0), (9, 3, 1.0), (9, 4, 2.0), (9, 5, 2.0)]
    asked = spark.createDataFrame([(9, 1)], "user_id bigint, item_id bigint")
    for n in (1, 2, 3, 4, 50):
        (got,) = recommend.cf_predict(frame(spark, train), asked, n).collect()
        assert got.neighbor_count == min(n, 4)
        assert got.prediction == pytest.approx(brute_predictions(train, [(9, 1)], n, False)[9, 1], abs=1e-9)
    kept = recommend.similar_ratings(frame(spark, train), asked)
    assert sorted((r.other, round(r.sim, 6)) for r in kept.collect()) == [(2, 1.0), (3, -1.0)]


def test_trees_learn_from_features_and_labels_only(spark, monkeypatch):
    rows = ratings()
    users, items = profiles(spark, rows)
    kept, columns = model.stored, []
    monkeypatch.setattr(model, "stored", lambda df, name: columns.append(df.columns) or kept(df, name))
    asked = frame(spark, rows).select("user_id", "item_id")
    assert model.gbt_predict(frame(spark, rows), asked, users, items, depth=2, rounds=2).count() == len(rows)
    assert columns == [["features", "label"]]
