"""Hierarchical weighted hash tree: rows to shards by descending region, rack and shard level.

The tree has fixed room: regions hold racks, racks hold places, each place with a weight; a node weighs what its
places weigh.  A row draws at every level: each child gets ``-ln(u) / weight`` with ``u`` hashed from the row's key,
the attempt and the child's path, and the smallest draw wins.  A place that no shard fills yet sends the row to the
next attempt, which descends anew.  So a further shard changes the way of exactly those rows that had met its empty
place: they move into it, and no row moves between other shards, racks or regions.

Everything is a column expression; nothing is shuffled to place a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Weights = Sequence[Sequence[Sequence[float]]]


def even_room(regions: int = 4, racks: int = 4, places: int = 4) -> Weights:
    return [[[1.0] * places for _ in range(racks)] for _ in range(regions)]


@dataclass(frozen=True)
class HashTree:
    """``room[region][rack]`` lists the weights of the places; ``attempts`` descents come before the flat draw."""

    room: Weights = field(default_factory=even_room)
    attempts: int = 32

    @property
    def places(self) -> list[tuple[int, int, int]]:
        """Places in the order in which shards fill them: over the regions first, then over their racks."""
        spots = [(p, k, r) for r, racks in enumerate(self.room) for k, rack in enumerate(racks) for p in range(len(rack))]
        return [(r, k, p) for p, k, r in sorted(spots)]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _draw(weight: Column, *parts: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(unit) / weight


def _pick(weights: Column, *parts: Column) -> Column:
    """Index of the child with the smallest draw."""
    drawn = F.transform(weights, lambda w, i: F.struct(_draw(w, *parts, i).alias("d"), i.alias("i")))
    return F.array_min(drawn).getField("i")


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def shard_of(tree: HashTree, n_shards: int, *key: Column) -> Column:
    """Shard 0 .. ``n_shards`` - 1 of a row; only the key and the number of shards decide.

    A null key is a key like any other.  More shards than places raise ValueError.
    """
    places = tree.places
    if not 1 <= n_shards <= len(places):
        raise ValueError(f"{n_shards} shards do not fit into {len(places)} places")
    number = {place: i for i, place in enumerate(places)}
    regions = _numbers([sum(map(sum, racks)) for racks in tree.room])
    racks = F.array(*[_numbers([sum(rack) for rack in region]) for region in tree.room])
    weights = F.array(*[F.array(*[_numbers(rack) for rack in region]) for region in tree.room])
    numbers = F.array(
        *[
            F.array(*[F.array(*[F.lit(number[r, k, p]) for p in range(len(rack))]) for k, rack in enumerate(region)])
            for r, region in enumerate(tree.room)
        ]
    )

    def descend(attempt: Column) -> Column:
        def from_rack(r: Column, k: Column) -> Column:
            place = _pick(weights[r][k], *key, attempt, F.lit(3), r, k)
            return numbers[r][k][place]

        def from_region(r: Column) -> Column:
            return _let(_pick(racks[r], *key, attempt, F.lit(2), r), lambda k: from_rack(r, k))

        return _let(_pick(regions, *key, attempt, F.lit(1)), from_region)

    def step(found: Column, attempt: Column) -> Column:
        met = _let(descend(attempt), lambda s: F.when(s < n_shards, s).otherwise(F.lit(-1)))
        return F.when(found >= 0, found).otherwise(met)

    open_weights = _numbers([tree.room[r][k][p] for r, k, p in places[:n_shards]])
    found = F.aggregate(F.sequence(F.lit(0), F.lit(tree.attempts - 1)), F.lit(-1), step)
    return F.when(found >= 0, found).otherwise(_pick(open_weights, *key, F.lit(-1), F.lit(4))).cast("int")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in ``slot``.

    A shard is cut into hash buckets; positions within a bucket and bucket offsets add up, so no task sees a whole
    shard.  Equal rows are counted before the shuffle and numbered together.  Columns of ``rows`` stay; nulls are
    values like others; an empty table stays empty.
    """
    columns = rows.columns
    n, bucket, first, before = "__n", "__bucket", "__first", "__before"
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    counted = counted.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy(shard, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order], *[c for c in columns if c not in order])
    placed = counted.withColumn(first, F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    totals = counted.groupBy(shard, bucket).agg(F.sum(n).alias(n))
    over = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(shard, bucket, F.coalesce(F.sum(n).over(over), F.lit(0)).alias(before))
    start = F.coalesce(F.col(first), F.lit(0)) + F.col(before)
    return placed.join(offsets, [shard, bucket]).select(
        *columns, F.explode(F.sequence(start, start + F.col(n) - 1)).alias("slot")
    )
