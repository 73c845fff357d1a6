"""Small tables for the tests of the llm operators."""

DOCS = "doc_id bigint, text string"


def docs_of(spark, *texts, extra=True):
    """Numbered documents, with columns that clash with names the operators use."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).coalesce(2)
    return df.selectExpr("*", "'x' AS fp", "'y' AS key", "'z' AS block", "1 AS item_id", "'en' AS lang", "'s' AS source") if extra else df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
