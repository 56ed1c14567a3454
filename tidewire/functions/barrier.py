"""Evaluate costly columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, but later filters and projections reuse the values.

    The optimizer merges plain projections and pushes filters through them by
    copying expressions, so a chain of parsing steps would be evaluated many
    times over.  A one-element ``inline`` is a generator, which it leaves alone.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
