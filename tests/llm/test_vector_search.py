import math

import numpy as np
import pytest

from tidewire.llm import int8_join, kd_search

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, d int, i int, j int, v string"


def _rows(seed, n=400, dims=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[50:90] = x[0]  # many copies: ties by id
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(3, x[3].tolist())] * 3  # repeated rows
    rows += [(900, None), (901, [0.0] * dims), (902, [math.nan] * dims), (903, [math.inf] * dims), (904, [None] * dims), (905, []), (None, x[1].tolist())]
    rows += [(910, [1.0, 2.0]), (911, [2.0, 2.0])]  # other length
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, 2, 3, "y") for i, v in rows], SCHEMA)


def _brute(rows, k, score, zero, largest):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            fine[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q, a in fine.items():
        if q % 10 == 0:
            found = [(score(a, b), i) for i, b in fine.items() if i != q and len(a) == len(b)]
            out[q] = sorted(found, key=lambda x: (-x[0] if largest else x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize(("seed", "group_rows", "group_queries"), [(1, 60, 9), (2, 10_000, 1000)])
def test_nearest_equal_brute_force(spark, seed, group_rows, group_queries):
    rows = _rows(seed)
    df = _frame(spark, rows)
    got = {}
    for r in int8_join.search(df, df.filter("vec_id % 10 = 0"), 10, group_rows=group_rows, group_queries=group_queries).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = _brute(rows, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False, False)
    assert set(got) == set(want)
    for q, ranks in got.items():
        assert [i for _, i in (ranks[k] for k in sorted(ranks))] == [i for _, i in want[q]]
        assert [s for s, _ in (ranks[k] for k in sorted(ranks))] == pytest.approx([s for s, _ in want[q]], rel=1e-12)


@pytest.mark.parametrize(("seed", "shard_rows", "leaf"), [(3, 50, 4), (4, 10_000, 16)])
def test_largest_products_equal_brute_force(spark, seed, shard_rows, leaf):
    rows = _rows(seed)
    df = _frame(spark, rows)
    from pyspark.sql import functions as F

    found = kd_search.search(df, df.filter("vec_id % 10 = 0"), lambda x: F.floor(x * 64), k=20, shard_rows=shard_rows, leaf=leaf, group_queries=11)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = _brute(rows, 20, lambda a, b: int(np.floor(a * 64) @ np.floor(b * 64)), True, True)
    assert {q: [ranks[k] for k in sorted(ranks)] for q, ranks in got.items()} == {q: x for q, x in want.items() if x}


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 16)) * 10.0 ** rng.integers(-6, 6, size=(200, 1))
    codes, scale, lost = int8_join.quantised(x)
    assert (np.linalg.norm(x - codes * scale[:, None], axis=1) <= lost).all() and np.abs(codes).max() <= 127
    tree = kd_search.built(np.floor(x), 8)
    for low, high, (a, b) in zip(tree.low, tree.high, tree.span, strict=True):
        part = np.floor(x)[tree.order[a:b]]
        assert (part.min(axis=0) == low).all() and (part.max(axis=0) == high).all()


def test_empty(spark):
    df = _frame(spark, []) 
    assert int8_join.search(df, df).count() == 0 and kd_search.search(df, df).count() == 0
