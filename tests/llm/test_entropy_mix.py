import math
import random

import pytest

from tidewire.llm.entropy_mix import balance, source_targets


def _targets(sizes, weights, share, cap):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[n] for n in free)
        over = {n for n in free if left * w[n] / total >= cap * sizes[n]}
        if not over:
            return out | {n: left * w[n] / total for n in free}
        out |= {n: cap * sizes[n] for n in over}
        left -= sum(cap * sizes[n] for n in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "a", "b", "Z", "c10", "c2"][: 3 + seed * 2]
    rows = [(i, rng.choice(names) if rng.random() > 0.35 else names[0], rng.choice([0, 1, 3, 50, 400, rng.randrange(3000)]), "q") for i in range(600)]
    rows += [(7, names[1], 12, "q")] * 40 + [(None, names[1], None, "q")]
    got = balance(spark.createDataFrame(rows, "doc_id long, source string, size long, rate string"), ["doc_id", "size"]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = _targets(sizes, (5, 2, 1), 1.0, 3)
    taken = {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * (r["size"] or 0)
    for s, n in sizes.items():
        # whole copies of sizes 1, 3, 50 ... leave a few words where the small documents are used up
        assert abs(taken[s] - want[s]) <= max(3, 1e-3 * want[s]), (s, taken[s], want[s])


def test_rates_are_tilted_in_size_and_reruns_agree(spark):
    rows = [(i, "a" if i % 5 else "b", 10 + i % 37) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    one, two = ({r["doc_id"]: (r["copies"], r["rate"]) for r in balance(x, ["doc_id"]).collect()} for x in (df, df.repartition(7)))
    assert one == two
    by_size = sorted({(s, one[i][1]) for i, n, s in rows if n == "a"})
    odds = [r / (3 - r) for _, r in by_size]
    steps = [b / a for a, b in zip(odds, odds[1:], strict=False)]
    assert max(steps) - min(steps) < 1e-6


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 3, 4)])
def test_very_long_documents_meet_their_targets(spark, weights):
    rng = random.Random(11)
    sizes = {}
    for name, n, k, low, high in (("a", 3000, 40, 20_000, 200_000), ("b", 3000, 40, 20_000, 200_000), ("c", 1000, 60, 2000, 10_000)):
        small = [max(1, int(rng.lognormvariate(5.5, 0.8))) for _ in range(n)]
        sizes[name] = small + [int(math.exp(rng.uniform(math.log(low), math.log(high)))) for _ in range(k)]
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, all_of in sizes.items() for n in all_of)]
    got = balance(spark.createDataFrame(rows, "doc_id long, source string, size long"), ["doc_id"], weights=weights).collect()
    want = _targets({s: sum(x) for s, x in sizes.items()}, weights, 1.0, 3)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(0 <= r["copies"] <= 3 for r in mine)
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(target, rel=1e-6), s
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target) <= 3, s


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert {r["target"] for r in balance(df, ["doc_id"]).collect()} == {0.0}
    assert balance(df.limit(0), ["doc_id"]).count() == 0


def test_targets_of_one_source(spark):
    one = spark.createDataFrame([(False, "a", 10)], "__null boolean, __source string, source_size long")
    assert source_targets(one, (5, 2, 1), 1.0, 3.0).collect()[0]["target"] == pytest.approx(10)
