"""Registry of the named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return register


SHARED: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once for a session and its tables: several queries look at one run."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in SHARED:
        SHARED[key] = make()
    return SHARED[key]
