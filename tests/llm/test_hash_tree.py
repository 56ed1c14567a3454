import math
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tidewire.llm.hash_tree import HashTree, shard_of, with_slots

SEED = 42


def _hash(*parts):
    """Spark's xxhash64 of (long, int, ...): each value's little-endian bytes, seeded with the hash so far."""
    h = SEED
    for value, width in parts:
        h = xxhash.xxh64_intdigest((value & (1 << 8 * width) - 1).to_bytes(width, "little"), seed=h)
    return h


def _pick(weights, *parts):
    draws = [(-math.log(((_hash(*parts, (i, 4)) >> 11) + 0.5) * 2.0**-53) / w, i) for i, w in enumerate(weights)]
    return min(draws)[1]


def _brute(tree, n, key):
    number = {p: i for i, p in enumerate(tree.places)}
    for a in range(tree.attempts):
        r = _pick([sum(map(sum, x)) for x in tree.room], (key, 8), (a, 4), (1, 4))
        k = _pick([sum(x) for x in tree.room[r]], (key, 8), (a, 4), (2, 4), (r, 4))
        p = _pick(tree.room[r][k], (key, 8), (a, 4), (3, 4), (r, 4), (k, 4))
        if number[r, k, p] < n:
            return number[r, k, p]
    raise AssertionError


def test_descent_equals_brute_force_in_an_uneven_tree(spark):
    tree = HashTree(room=[[[1.0, 2.0], [3.0]], [[1.0], [1.0, 1.0], [0.5]]])
    ids = spark.range(300)
    for n in (5, 7):
        got = ids.select("id", shard_of(tree, n, F.col("id")).alias("s")).collect()
        assert all(r["s"] == _brute(tree, n, r["id"]) for r in got)


def test_a_further_shard_only_takes(spark):
    tree = HashTree()
    ids = spark.range(20_000)
    placed = ids.select(*[shard_of(tree, n, F.col("id")).alias(f"s{n}") for n in (7, 8, 40, 41)]).collect()
    for a, b in ((7, 8), (40, 41)):
        assert all(r[f"s{a}"] == r[f"s{b}"] or r[f"s{b}"] == a for r in placed)
        counts = Counter(r[f"s{b}"] for r in placed)
        assert set(counts) == set(range(b))
        assert max(abs(c - 20_000 / b) for c in counts.values()) < 6 * math.sqrt(20_000 / b)


def test_slots_are_gapless_with_nulls_and_repeats(spark):
    rows = [(i % 50 if i % 7 else None, i % 3, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, shard int, slot_before string")
    got = with_slots(df, "shard", ["id"], buckets=4).collect()
    assert Counter((r["id"], r["shard"], r["slot_before"]) for r in got) == Counter(rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert with_slots(df.limit(0), "shard", ["id"]).count() == 0


def test_query_law(spark):
    from tidewire.llm.queries import QUERIES

    got = QUERIES["op4_hash_tree"](spark, "/root/testdata/sf0.01").toPandas()
    assert (got["law"] == "key").all() and got["shard"].between(0, 39).all()
    assert ((got["shard"] == got["grown_shard"]) | (got["grown_shard"] == 40)).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
