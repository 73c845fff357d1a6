"""Column helpers for delimited text, dates, labels and loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def csv_field(line: Column, position: int) -> Column:
    """Field at a 0-based position of a comma-separated line, double quotes stripped."""
    return F.btrim(F.element_at(F.split(line, ","), position + 1), F.lit('"'))


def shorten_year(date: Column) -> Column:
    """``11/1/2000`` -> ``11/1/00``."""
    return F.concat(F.left(date, F.length(date) - 4), F.right(date, F.lit(2)))


def drop_last_two(date: Column) -> Column:
    """``11/1/2000`` -> ``11/1/20``."""
    return F.left(date, F.length(date) - 2)


def date_customer_key(date: Column, customer: Column) -> Column:
    return F.concat_ws("-", shorten_year(date), customer)


def to_int_or_zero(value: Column) -> Column:
    """Integer held in a string; anything else, or nothing, counts as 0."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value.cast("string"), F.lit("'"))


def itemset_label(items: Column) -> Column:
    """``('a')`` for a single item, ``('a', 'b')`` otherwise."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(items, quoted)), F.lit(")"))


def plain_decimal(value: Column, digits: int) -> Column:
    """A number rounded to ``digits``, without exponent or closing zeros, but with one decimal at least."""
    fixed = F.format_string(f"%.{digits}f", F.round(value, digits))
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def edge_score_line(src: Column, dst: Column, score: Column) -> Column:
    return F.format_string("('%s', '%s'),%s", src.cast("string"), dst.cast("string"), plain_decimal(score, 5))
