import random

import pytest

from tidewire.llm import signature_tree
from tidewire.llm.components import components


def _brute(rows):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                own[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(sets[k]), least.get(find(k), -1)) for k, (i, _) in enumerate(rows))


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))]
        if base % 3 == 0:
            words = common + words[:40]
        for _ in range(rng.choice([1, 2, 9, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                words = copy  # chains of edits
            rows.append(" ".join(copy))
    rows += ["", "  \n\t", None, "one two", "ONE\x0btwo", "one two three four", "same words here and there", "Same words here and there", "x" * 5000]
    rng.shuffle(rows)
    return [(10 * k + 3, t) for k, t in enumerate(rows)] + [(None, rows[0]), (3, rows[0])]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4_000_000), (2, 400), (3, 1500), (4, 1)])
def test_components_equal_brute_force(spark, docs_of, seed, chunk):
    rows = _corpus(seed)
    got = signature_tree.join(docs_of(rows).repartition(3), chunk_shingles=chunk).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == _brute(rows)


def test_empty(spark, docs_of):
    assert signature_tree.join(docs_of([])).count() == 0


def test_stars(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = {}
    for a, b in edges:
        if a != b:
            seen.setdefault(a, set()).add(b)
            seen.setdefault(b, set()).add(a)
    for n in seen:
        todo, reached = [n], {n}
        while todo:
            for m in seen[todo.pop()] - reached:
                reached.add(m)
                todo.append(m)
        assert got[n] == min(reached)
    assert set(got) == set(seen)
