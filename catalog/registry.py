"""Registry of (query, checking SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.views import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and dates as text, so any reader prints them alike."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz").alias(name)
        elif kind == "date":
            c = c.cast("string").alias(name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark, sf_dir: str) -> DataFrame:
            return plain(build(Tables(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
