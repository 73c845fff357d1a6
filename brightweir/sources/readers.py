"""Readers. Schemas are explicit, so every scan prunes to the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import csv_field, date_customer_key

REVIEW_SCHEMA = "user_id string, business_id string, stars double, date string"
BUSINESS_SCHEMA = (
    "business_id string, city string, stars double, review_count bigint, attributes map<string,string>"
)
USER_SCHEMA = "user_id string, review_count bigint, average_stars double, useful bigint"
RATING_SCHEMA = "user_id string, business_id string, stars double"
PRICE_ATTRIBUTE = "RestaurantsPriceRange2"


def read_json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_inferred(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """JSON lines with inferred schema, projected to the named columns."""
    return spark.read.json(path).select(*columns)


def header_line(spark: SparkSession, path: str) -> str | None:
    """First line of the first file by name that is not empty; None if all are.

    The names and sizes come from the file listing; only the one line is read.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    name = files.agg(F.min("path")).first()[0]
    first = None if name is None else spark.read.text(name).first()
    return None if first is None else first[0]


def read_header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by position. Every line equal to the header is dropped, not only the first."""
    title_line = header_line(spark, path)
    fields = T._parse_datatype_string(schema).fields
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    rows = spark.read.schema(raw).option("header", False).option("enforceSchema", True).csv(path)
    header = title_line.split(",") if title_line else []
    is_header = F.lit(bool(header))
    for field, title in zip(fields, header):
        is_header = is_header & F.col(field.name).eqNullSafe(F.lit(title))
    return rows.where(~is_header).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Quoted transaction lines: field 0 date, 1 customer, 5 product.

    Returns ``basket_id`` (short date and customer) and ``item`` (the product as
    a number, so leading zeros go).
    """
    lines = spark.read.text(path)
    header = header_line(spark, path)
    line = F.col("value")
    if header is not None:
        lines = lines.where(line != header)
    return lines.select(
        date_customer_key(csv_field(line, 0), csv_field(line, 1)).alias("basket_id"),
        csv_field(line, 5).cast("bigint").alias("item"),
    )


def read_rating_folder(
    spark: SparkSession,
    folder: str,
    train: str = "train.csv",
    user: str = "user.json",
    business: str = "business.json",
    names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """One folder with the training ratings and the two profile files.

    ``names`` renames columns of all three, as ``{"business_id": "item_id"}`` does for the
    recommenders.
    """
    base = folder.rstrip("/")
    tables = {
        "train": read_header_csv(spark, f"{base}/{train}", RATING_SCHEMA),
        "user": read_json_strict(spark, f"{base}/{user}", USER_SCHEMA),
        "business": read_json_strict(spark, f"{base}/{business}", BUSINESS_SCHEMA),
    }
    return {name: table.withColumnsRenamed(names or {}) for name, table in tables.items()}


def read_id_stream(
    spark: SparkSession, path: str, batch_size: int, files_per_trigger: int = 1
) -> DataFrame:
    """Streaming source of ``(seq, id)`` rows with the tumbling batch number."""
    rows = (
        spark.readStream.schema("seq bigint, id string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return with_batch(rows, batch_size)


def with_batch(stream: DataFrame, batch_size: int) -> DataFrame:
    """Tumbling count window: batch b holds the events with b*size <= seq < (b+1)*size."""
    return stream.withColumn("batch", F.floor(F.col("seq") / batch_size).cast("bigint"))
