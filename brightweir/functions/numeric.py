"""Small numeric rules shared by the recommenders and the sketches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tilt(similarity: Column, damp: float = 0.8, boost: float = 1.2) -> Column:
    """Negative similarities are damped, all others boosted."""
    return F.when(similarity < 0, similarity * damp).otherwise(similarity * boost)


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def trailing_zeros(h: Column) -> Column:
    """Number of zero bits below the lowest set bit; 0 for 0."""
    return F.when(h == 0, 0).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def trailing_zeros_of_text(h: Column) -> Column:
    """Same, read off the text ``0b...``: for 0 the three characters of ``0b0`` remain."""
    return F.when(h == 0, 3).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))
