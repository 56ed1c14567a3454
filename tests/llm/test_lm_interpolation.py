import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import lm_interpolation as lm


def _corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        at, text = rng.randrange(60), []
        for _ in range(rng.choice([0, 3, 30, 200])):
            at = (at * 7 + rng.choice([1, 1, 1, 5])) % 60
            text.append(words[at] if rng.random() > 0.02 else f"rare{rng.randrange(500)}")
        rows.append((k, " ".join(text).upper() if k % 9 == 0 else "\x0b".join(text)))
    return rows + [(300, None), (301, ""), (302, "é É\x85x"), (7, rows[7][1])]


def _tokens(text):
    return [*("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()), None]


@pytest.mark.parametrize("ranges", [1, 5])
def test_scores_equal_brute_force(spark, docs_of, ranges):
    rows = _corpus()
    role = lambda i: lm.APART if i % 7 == 2 else lm.DELETED if i % 5 == 0 else lm.KEPT
    column = F.when(F.col("doc_id") % 7 == 2, lm.APART).when(F.col("doc_id") % 5 == 0, lm.DELETED).otherwise(lm.KEPT)
    model = lm.fit(docs_of(rows).repartition(4), column, ranges=ranges)
    got = {}
    for r in lm.score(model, docs_of(rows).schema["doc_id"].dataType).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)

    def counts(kinds):
        one, two = Counter(), Counter()
        for i, t in rows:
            if role(i) in kinds:
                tokens = _tokens(t)
                one.update(tokens)
                two.update(zip(["start", *tokens[:-1]], tokens, strict=True))
        return one, two

    one, two = counts((lm.DELETED, lm.KEPT))
    n, v = sum(one.values()), len(one)
    assert model.corpus.tokens == n and model.corpus.distinct == v
    kept, kept_two = counts((lm.KEPT,))
    assert model.corpus.kept_tokens == sum(kept.values()) and model.corpus.kept_distinct == len(kept)
    cells = Counter()
    for i, t in rows:
        if role(i) == lm.DELETED:
            tokens = _tokens(t)
            for a, b in zip(["start", *tokens[:-1]], tokens, strict=True):
                c = kept[None] if a == "start" else kept[a]
                p = (kept_two[a, b] / c if c else 0.0, kept[b] / sum(kept.values()))
                cells[(1 + int(math.log2(c)) if c else 0, *(1 + round(-4 * math.log2(x)) if x else 0 for x in p))] += 1
    weights = lm.learned_weights(np.array([(*k, n) for k, n in cells.items()]), 1 / (len(kept) + 1))
    assert np.allclose(weights, model.weights, atol=1e-3)
    for i, t in rows:
        tokens = _tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in tokens)
        full = 0.0
        for a, b in zip(["start", *tokens[:-1]], tokens, strict=True):
            c = one[None] if a == "start" else one[a]
            w = model.weights[1 + int(math.log2(c)) if c else 0]
            full += math.log10(w[0] * (two[a, b] / c if c else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        for r in got[i]:
            assert (r["role"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (role(i), len(tokens), sum(one[x] > 0 for x in tokens), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(full)
    apart = [r for rs in got.values() for r in rs if r["role"] == lm.APART]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_probabilities_sum_to_one():
    weights = lm.learned_weights(np.array([(3, 5, 9, 40), (1, 0, 12, 7)]), 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()
    assert np.allclose(lm.learned_weights(np.empty((0, 4)), 0.1), 1 / 3)


def test_empty(spark, docs_of):
    model = lm.fit(docs_of([]), F.lit(lm.KEPT))
    assert lm.score(model, docs_of([]).schema["doc_id"].dataType).count() == 0
