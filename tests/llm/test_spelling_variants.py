import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tidewire.llm import spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=10):
    """Brute force over all pairs."""
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = []
    for w in counts:
        end = w
        while end in form:
            end = form[end]
        out.append((w, form.get(w), end, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def result(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()) or [("x", 1)], "word string, n long")
    got = spelling_variants.group(df if counts else df.limit(0), **options)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(rng, letters, bases, each, length=7):
    counts = Counter()
    for _ in range(bases):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(length, 12)))
        counts[base] = rng.choice([3, 40, 600])
        for _ in range(each):
            w, at = list(base), rng.randrange(len(base))
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.insert(at, rng.choice(letters)), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice(letters))])()  # noqa: B023
            if len(w) >= length:
                counts["".join(w)] += rng.choice([2, 3, 50])
    return dict(counts)


@pytest.mark.parametrize("letters", ["ab", "abcdefé", "abcdefghijklmnopqrstuvwxyzàçéö"])
def test_equals_all_pairs(spark, letters):
    counts = variants(random.Random(len(letters)), letters, 40, 8)
    assert result(spark, counts) == grouped(counts)


def test_split_keys_lose_no_pair(spark):
    counts = variants(random.Random(9), "abc", 30, 10, length=4)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    whole = {(r["a"], r["b"]) for r in spelling_variants.near_pairs(df, most=10**9).collect()}
    split = {(r["a"], r["b"]) for r in spelling_variants.near_pairs(df, most=0).collect()}
    assert whole == split == {tuple(sorted(p)) for p in combinations(counts, 2) if one_edit(*p)}


def test_every_edit_of_one_word(spark):
    base, letters = "strange", "aeé"
    words = {base[:i] + c + base[i:] for i in range(8) for c in letters} | {base[:i] + c + base[i + 1 :] for i in range(7) for c in letters}
    words |= {base[:i] + base[i + 1 :] for i in range(7)} - {base}
    counts = {w: 2 for w in words} | {base: 100}
    got = {r[0]: r for r in result(spark, counts)}
    assert got[base][4] == len(counts) - 1
    assert all(got[w][1] == base and got[w][2] == base and got[w][5] == 100 for w in words - {base})


def test_forms_chain_to_one_root_and_ties_take_the_smaller(spark):
    counts = {"abcdefgh": 1000, "abcdefg": 100, "abcdef": 10, "xyzxyzq": 50, "xyzxyzp": 50, "xyzxyzr": 5}
    got = {r[0]: r for r in result(spark, counts)}
    assert got["abcdef"][1:3] == ("abcdefg", "abcdefgh") and got["abcdefgh"][1:3] == (None, "abcdefgh")
    assert got["xyzxyzr"][1] == "xyzxyzp" and got["xyzxyzp"][1] is None and got["xyzxyzp"][4] == 2


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(2)
    for _ in range(300):
        prefix = sorted((p, rng.randint(1, 9)) for p in rng.sample(range(10), rng.randint(3, 6)))
        got = spelling_variants.pivots(prefix)
        cost = dict(prefix)
        best = min(cost[a] + cost[b] for a in cost for b in cost if b - a >= 2)
        assert got[1] - got[0] >= 2 and sum(cost[p] for p in got) == best


def test_words_are_counted_whole_with_planted_errors(spark, docs_of):
    texts = [(1, "Réunion réunion RÉUNION strangers,strangers"), (2, None), (3, ""), (None, "strangers"), (4, "strangers " * 40_000), (4, "strangers"), (5, "ÀÉÎõü×÷ÿabcde 12strangers34")]

    def brute(every):
        counts = Counter()
        for i, t in texts:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if every and h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) >= 7:
                    counts[w] += 1
        return {w: n for w, n in counts.items() if n >= 2}

    for every in (None, 2, 31):
        got = spelling_variants.word_counts(docs_of(texts), every=every, held=2)
        assert {r["word"]: r["n"] for r in got.collect()} == brute(every)


def test_no_words(spark, docs_of):
    assert result(spark, {}) == []
    assert spelling_variants.word_counts(docs_of([(1, None), (2, "a b c")])).count() == 0
    assert result(spark, {"lonesome": 3}) == [("lonesome", None, "lonesome", 3, 0, None)]
