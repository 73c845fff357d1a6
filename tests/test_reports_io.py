"""Reports, readers, writers and text rules."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from brightweir.functions import text
from brightweir.operators import reports
from brightweir.runtime import new_dir
from brightweir.sinks import writers
from brightweir.sources import readers


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def joined(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*")))


REVIEWS = [
    ("u1", "b1", 5.0, "2018-01-02"),
    ("u1", "b2", 3.0, "2017-01-02"),
    ("u2", "b1", 4.0, "2018-07-01"),
    ("u3", "b9", 1.0, "2016-02-02"),
]


def reviews(spark):
    return spark.createDataFrame(REVIEWS, readers.REVIEW_SCHEMA)


def test_review_report(spark):
    report = reports.review_report(reviews(spark), "2018", k=2).first()
    assert (report.n_review, report.n_review_year, report.n_user, report.n_business) == (4, 2, 3, 3)
    assert [tuple(e) for e in report.top_user] == [("u1", 2), ("u2", 1)]
    assert [tuple(e) for e in report.top_business] == [("b1", 2), ("b2", 1)]


def test_json_report_file(spark):
    path = new_dir(spark, "report")
    writers.write_json_report(reports.review_report(reviews(spark)), path)
    assert json.loads(joined(path))["n_review"] == 4


def test_city_average_keeps_unmatched_reviews(spark):
    business = spark.createDataFrame([("b1", "Rome"), ("b2", "Oslo")], "business_id string, city string")
    got = [tuple(r) for r in reports.city_average(reviews(spark), business).collect()]
    assert got == [("Rome", 4.5), ("Oslo", 3.0), ("", 1.0)]


def test_hash_profile_is_the_layout_of_a_repartition(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 7).alias("k"))
    real = {
        r.bucket: r.n
        for r in df.repartition(5, "k").groupBy(F.spark_partition_id().alias("bucket")).agg(F.count("*").alias("n")).collect()
    }
    got = {r.bucket: r.n_items for r in reports.hash_partition_profile(df, "k", 5).collect()}
    assert got == {b: real.get(b, 0) for b in range(5)}


def test_profile_summary(spark):
    df = spark.range(90).withColumn("k", F.col("id") % 4)
    got = {r.layout: r for r in reports.profile_summary(reports.partition_profile(df, "k", 6)).collect()}
    assert got["customized"].n_partition == 6 == len(got["customized"].n_items)
    assert sum(got["customized"].n_items) == 90 == sum(got["default"].n_items)


def test_json_modes(spark, tmp_path):
    good = '{"user_id": "u", "business_id": "b", "stars": 4, "date": "2018-01-01"}\n'
    path = write(tmp_path, "r.json", good + '{"user_id": \n' + good)
    assert len(readers.read_json_lenient(spark, path, readers.REVIEW_SCHEMA).collect()) == 2
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_json_strict(spark, path, readers.REVIEW_SCHEMA).collect()
    clean = write(tmp_path, "c.json", good)
    assert readers.read_json_inferred(spark, clean, "stars").columns == ["stars"]


def test_header_csv_drops_every_header_line(spark, tmp_path):
    path = write(tmp_path, "p.csv", "user,item,stars\na,x,1.5\nuser,item,stars\nb,y,2\n")
    got = readers.read_header_csv(spark, path, readers.RATING_SCHEMA).collect()
    assert [tuple(r) for r in got] == [("a", "x", 1.5), ("b", "y", 2.0)]


def test_transactions(spark, tmp_path):
    lines = '"D","C","a","b","c","P"\n"11/1/2000","0042","a","b","c","0000123"\n'
    got = readers.read_transactions(spark, write(tmp_path, "t.csv", lines)).collect()
    assert [tuple(r) for r in got] == [("11/1/00-0042", 123)]


def test_dates_and_loose_integers(spark):
    df = spark.createDataFrame([("11/1/2000", " 2 "), ("1/12/1999", "None"), ("1/1/2001", None)], "d string, x string")
    got = df.select(
        text.shorten_year(F.col("d")), text.drop_last_two(F.col("d")), text.to_int_or_zero(F.col("x"))
    ).collect()
    assert [tuple(r) for r in got] == [("11/1/00", "11/1/20", 2), ("1/12/99", "1/12/19", 0), ("1/1/01", "1/1/20", 0)]


def test_itemset_report_text(spark):
    sets = [(["b"], 1), (["a"], 1), (["b", "a"], 2), (["c", "a"], 2)]
    df = spark.createDataFrame([(sorted(s), n) for s, n in sets], "itemset array<string>, size int")
    path = new_dir(spark, "itemsets")
    writers.write_itemset_report(df, df.where("size = 1"), path)
    assert joined(path) == (
        "Candidates:\n('a'),('b')\n\n('a', 'b'),('a', 'c')\n\nFrequent Itemsets:\n('a'),('b')"
    )


def test_community_report_text(spark):
    rows = [("a", "a", 3), ("a", "b", 3), ("a", "z", 3), ("c", "c", 1), ("d", "d", 2), ("d", "e", 2)]
    path = new_dir(spark, "communities")
    writers.write_community_report(spark.createDataFrame(rows, "community string, id string, size bigint"), path)
    assert joined(path) == "'c'\n'd','e'\n'a','b','z'"


def test_edge_report_orders_by_unrounded_score(spark):
    rows = [("a", "b", 1.0000001), ("a", "c", 1.0000002), ("b", "c", 7.0)]
    df = spark.createDataFrame(rows, "src string, dst string, betweenness double")
    path = new_dir(spark, "edges")
    writers.write_edge_report(df, path)
    assert joined(path).split("\n")[:3] == ["('b', 'c'),7.0", "('a', 'c'),1.0", "('a', 'b'),1.0"]


def test_csv_and_table_round_trip(spark):
    path = new_dir(spark, "csv")
    writers.write_csv(reviews(spark), path)
    back = spark.read.schema(readers.REVIEW_SCHEMA).option("header", True).csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(REVIEWS)
    table = writers.write_table(reviews(spark), new_dir(spark, "table"))
    assert sorted(map(tuple, table.collect())) == sorted(REVIEWS)
