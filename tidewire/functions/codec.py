"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (F.trim(text) == "null")


def json_list(text: Column, field: str = "list") -> Column:
    """JSON text to array<string>; blank is empty, corrupt text is an error."""
    parsed = F.from_json(text, "array<string>")
    broken = F.raise_error(F.concat(F.lit(f"corrupt JSON array in {field}: "), text))
    return F.when(_blank(text), F.array().cast("array<string>")).when(
        parsed.isNotNull(), parsed
    ).otherwise(broken.cast("array<string>"))


def json_map(text: Column) -> Column:
    """JSON text to map<string,string>; blank or corrupt text is empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(_blank(text), empty).otherwise(
        F.coalesce(F.from_json(text, "map<string,string>"), empty)
    )


def to_json_text(value: Column) -> Column:
    return F.to_json(value)
