"""Ordered per-key computations that stay bounded when one key is huge.

``fold`` is for rules whose state depends on earlier *decisions* (cooldowns,
learned profiles), which no window frame can express.  Rows are hash
partitioned by key, sorted, and streamed through a small Python step as Arrow
batches: the memory of a task is one batch plus the state of one key, however
many rows the key has.  Callers reduce their input to one row per key and time
slot first, so the rows of a single key are bounded by the length of the time
range and not by its traffic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import epoch

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


def fold(
    df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str
) -> DataFrame:
    """Run ``step(state, row) -> (state, output rows)`` over each key in order.

    ``state`` is None at the first row of a key.
    """
    names = df.columns

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state = None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[n].tolist() for n in names]
            for values in zip(*columns, strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, None
                state, rows = step(state, row)
                out.extend(rows)
            if out:
                yield pd.DataFrame(out, columns=out_names)

    out_names = [f.split()[0] for f in _fields(schema)]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(schema[start:i].strip())
            start = i + 1
    parts.append(schema[start:].strip())
    return parts


def cooldown_step(seconds: int, emit: list[str], ts: str = "at") -> Step:
    """Greedy cooldown: keep a row when the last kept one is ``seconds`` old."""

    def step(last: int | None, row: dict) -> tuple[int | None, list[tuple]]:
        if last is not None and row[ts] - last < seconds:
            return last, []
        return row[ts], [tuple(row[c] for c in emit)]

    return step


def with_last(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, slot: Column, past: bool = False
) -> DataFrame:
    """Add the last non-null ``value`` of the same key up to each row (``past``: before it).

    A plain window would sort a hot key in one task.  Instead the window runs per key and time slot (``slot``, whole
    numbers that ascend with the order), and what a slot starts with comes from a small aggregate of earlier slots.
    """
    slotted = df.withColumn("_slot", slot).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    ends = slotted.filter("_value is not null").groupBy(*keys, "_slot").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    slots = slotted.select(*keys, "_slot").distinct().join(ends, [*keys, "_slot"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.select(*keys, "_slot", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    return (
        slotted.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(before, [*keys, "_slot"], "left")
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_slot", "_value", "_inside", "_before")
    )


def with_previous(
    df: DataFrame, keys: list[str], ts: str, tie: str, out: str, slot_seconds: int = 3600
) -> DataFrame:
    """Add the time of the previous row of the same key."""
    slot = F.floor(epoch(ts) / slot_seconds)
    return with_last(df, keys, [ts, tie], F.col(ts), out, slot, past=True)


def keep_spaced(rows: DataFrame, keys: list[str], gap: Column, slot_seconds: int = 3600) -> DataFrame:
    """Greedy cooldown: the rows that pass once the last kept one of their key is ``gap`` microseconds old.

    ``rows`` has one row per key and instant ``us``; ``gap`` depends on the key alone.  A pause of ``gap`` starts an
    island, whose first row always passes while the rest of its first ``gap`` never does; only what islands hold
    beyond that goes through the ordered pass, keys and times alone, island by island.  Null keys are keys like others.
    """
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    safe = [*named.values()]
    # null is a key of its own, apart from the text "null"
    marked = rows.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k, n in named.items()})
    times = marked.select(*safe, "us", gap.cast("long").alias("_gap"))
    slot = F.expr(f"us div {slot_seconds * 1_000_000}")
    placed = with_last(times, safe, ["us"], F.col("us"), "_previous", slot, past=True)
    first = F.col("_previous").isNull() | (F.col("us") - F.col("_previous") >= F.col("_gap"))
    placed = with_last(placed.withColumn("_first", first), safe, ["us"], F.when(F.col("_first"), F.col("us")), "_island", slot)
    late = placed.filter(F.col("us") - F.col("_island") >= F.col("_gap")).select(*safe, "_island", "us", "_gap")

    def step(last: int | None, row: dict) -> tuple[int, list[tuple]]:
        last = row["_island"] if last is None else last
        if row["us"] - last < row["_gap"]:
            return last, []
        return row["us"], [(*(row[k] for k in safe), row["us"])]

    schema = ", ".join(f"{c} string" for c in safe) + ", us bigint"
    kept = placed.filter("_first").select(*safe, "us").unionByName(fold(late, [*safe, "_island"], ["us"], step, schema))
    return marked.join(kept, [*safe, "us"]).select(*rows.columns)


def one_value(df: DataFrame, value: Column) -> Column:
    """A global aggregate as an uncorrelated scalar subquery, not a join or a window."""
    return df.agg(value).scalar()
