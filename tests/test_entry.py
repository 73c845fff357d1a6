"""The driver contract, and a few queries next to their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SAMPLE = [
    "rep1_review_report",
    "fim4_two_pass_frequent",
    "grf6_connected_components",
    "sim5_exact_jaccard",
    "cf2_item_cf",
    "str1_bloom_fpr",
    "str4_reservoir_stream",
]


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["city", "stars"]
    assert contract.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 110


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows
    )


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    result = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = contract.queries()[name](spark, sf_dir)
    assert values(df.columns, df.collect()) == values(columns, result.fetchall())
