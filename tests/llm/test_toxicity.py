import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import toxicity

CLEAN = "the weather report was long and the river slow for it is that morning in town with some gentle people walking".split()
BAD = ["idiot", "moron", "loser", "scum", "worthless"]


@pytest.fixture(scope="module")
def chars():
    return toxicity.CharModel(toxicity.counted({w: 200 for w in CLEAN + BAD} | {"a": 300, "you": 250, "are": 250}))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("m0r0n!", "moron"), ("iiidiooot", "idiot"), ("L0SER", "loser"), ("5cum", "scum"), ("w0rthle$$", "worthless"),
     ("i.d.i.o.t", "idiot"), ("mo-ron", "moron"), ("scum!!!", "scum"), ("ｉｄｉｏｔ", "idiot"), ("weather,", "weather")],
)
def test_spellings_are_restored(chars, written, meant):
    assert meant in toxicity.restored(chars, written)


def test_spaced_letters_are_joined(chars):
    assert "idiot" in toxicity.spaced_out(chars, "you are a i d i 0 t .".split())
    assert toxicity.spaced_out(chars, "a b weather".split()) == []


@pytest.mark.parametrize(
    ("written", "meant"),
    [("stuupid", "stupid"), ("idioot", "idiot"), ("worthlless!", "worthless"), ("@$$", "ass"), ("1@|0", "lalo"), ("mo-ron", "moron"), ("stu.pid", "stupid"),
     ("wor*thless", "worthless"), ("!d!ot", "idiot"), ("street", "street"), ("less", "less")],
)
def test_the_word_itself_is_restored(written, meant):
    chars = toxicity.CharModel(toxicity.counted({w: 200 for w in [*CLEAN, *BAD, "stupid", "ass", "street", "less", "up", "lalo"]}))
    assert meant in toxicity.restored(chars, written)


def test_words_in_several_tokens():
    chars = toxicity.CharModel(toxicity.counted({w: 200 for w in [*CLEAN, *BAD, "stupid", "up", "worth", "less"]}))
    joined = toxicity.Joined(["stupid", "worthless", "moron"])
    assert joined.words(chars, "you are st up id! and a m0r. on !".split()) == {"stupid", "moron"}
    assert joined.words(chars, "it is worth less than the river".split()) == set()
    weigher = toxicity.Weigher(chars, {"stupid": 0.9}, 0.1)
    assert weigher.text("it was st up id")[0] > weigher.text("it was up id")[0]


def test_dense_signs_have_an_exact_path(chars):
    from itertools import product

    lattice = [[(x, 0.1 * k) for k, x in enumerate("abcdefgh")] for _ in range(4)]

    def cost(path):
        total, now = 0.0, "   "
        for c, price in path:
            total, now = total + price + chars.cost(now, c), now[1:] + c
        return total + chars.cost(now, " ")

    got = toxicity.decode(chars, lattice)
    assert cost([(c, 0.1 * "abcdefgh".index(c)) for c in got]) == pytest.approx(min(map(cost, product(*lattice))))


def test_best_path_equals_brute_force(chars):
    from itertools import product

    for token in ("1d10t", "mooo7", "s$", "a.b", "w0rth"):
        lattice = list(toxicity.readings(token))

        def total(path):
            cost, now, out = 0.0, "   ", ""
            for text, price in path:
                cost += price
                for c in text:
                    if c == " " and now[-1] == " ":
                        continue
                    cost += chars.cost(now, c)
                    now = now[1:] + c if c != " " else "   "
                out += text
            return cost + chars.cost(now, " "), out

        assert toxicity.decode(chars, lattice) == min(map(total, product(*lattice)))[1]


def _corpus(seed=3):
    rng = random.Random(seed)
    hidden = {"idiot": "1d1ot", "moron": "m0r0n", "loser": "looooser", "scum": "s c u m", "worthless": "w0rthle$s"}
    docs, labels = [], []
    for k in range(900):
        words = [rng.choice(CLEAN) for _ in range(rng.choice([5, 40, 300]))]
        toxic = k % 6 == 0
        if toxic:
            bad = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), hidden[bad] if k % 18 == 0 and k > 400 else bad)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy_with_obfuscated_texts(spark, docs_of):
    docs, labels = _corpus()
    frame = docs_of([*docs, (2000, None), (2001, ""), (2002, " \n"), (2003, "i" * 50_000), (None, "fine")])
    taught = spark.createDataFrame([(i, y) for i, y in labels if i % 4 != 2] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.learn(frame, taught)
    scored = toxicity.score(frame, model)
    assert scored.columns == [*[c for c in frame.columns if c != "score"], "score"]
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(got) == len(docs) + 5 and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i, y in labels if i % 4 == 2 and (got[i] >= 0.3) != bool(y)]
    assert len(wrong) <= 2, wrong
    assert all(got[i] < 0.3 for i in (2000, 2001, 2002, None))


def test_character_model_counts_all_texts(spark, docs_of):
    docs = docs_of([(i, "zephyr zephyr, " if i > 50 else "plain words") for i in range(200)] + [(999, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.chars.count("zeph") == 2 * 149 and model.chars.count("plai") == 51


def test_gram_counts_equal_brute_force(spark, docs_of):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    want = Counter()
    for t in texts:
        for w in t.split():
            line = "   " + w + " "
            for k in range(1, toxicity.ORDER + 1):
                want.update(line[i - k + 1 : i + 1] for i in range(3, len(line)))
    model = toxicity.char_model(docs_of(list(enumerate(texts))).select("text").repartition(5))
    assert len(want) > 5000
    off = [g for g, n in want.items() if model.count(g) != n]
    assert len(off) <= len(want) / 1000 and all(model.count(g) >= want[g] for g in off)


def test_no_reading_with_evidence_is_passed_over(chars):
    """Tokens that are not decoded have no reading with a feature: the same words as by decoding all tokens."""
    rng = random.Random(12)
    wanted = {"idiot", "mor*", "scum", "wor*", "loser", "los*", "ass", "b2b", "scummy*", "l*"}
    finder = toxicity.Finder(chars, wanted)
    look = {"i": "1!|", "o": "0", "s": "5$", "a": "4@", "l": "1|", "e": "3", "t": "7+", "c": "(", "b": "86", "g": "9"}
    for _ in range(4000):
        word = rng.choice(["idiot", "moron", "scum", "worthless", "loser", "ass", "weather", "scummyy", "river", "b2b", "asset", "bloom"])
        token = "".join(
            (rng.choice(look[c]) if c in look and rng.random() < 0.3 else c) * rng.choice([1, 1, 1, 1, 2, 3]) + rng.choice([""] * 12 + list(".-*_!$|²½é"))
            for c in word
        )
        token = rng.choice(["", "", "", "(", "!!", "$$$", "x-"]) + token + rng.choice(["", "", ",", "!!", "###", ".x", "|"])
        if len(token.strip(".,;:*-_'\"")) < 2:
            continue
        assert set(finder.token(token)) == {w for w in toxicity.restored(chars, token) if finder.carries(w)}, token


def test_beginnings_equal_brute_force():
    rng = random.Random(3)
    some = lambda most: "".join(rng.choice("abc") for _ in range(rng.randint(0, most)))
    for least in (1, 2, 3):
        held = {t for t in (some(5) for _ in range(12)) if len(t) >= least}
        starts = toxicity.Beginnings(held)
        for text in (some(7) for _ in range(300)):
            assert starts.of(text) == any(text.startswith(h) for h in held)
    assert not toxicity.Beginnings([]).of("abc") and not toxicity.Beginnings([]).of("")


def test_emptied_caches_change_nothing(chars):
    """Texts read with a cache of few tokens, with one of all tokens, and each on its own give the same words."""
    rng = random.Random(8)
    wanted, joined = {"idiot", "mor*", "scum", "loser", "los*"}, ["idiot", "scum", "moron"]
    pieces = [*CLEAN, *BAD, "1d10t", "mo-ron", "id", "iot", "s", "c", "u", "m", "sc", "um!", "m0r.", "on", "...", "!!", "IDIOT|", "ｓｃｕｍ", "é", "12", "Σ", "ΟΔΟΣ"]
    texts = ["", "   ", *(" ".join(rng.choice(pieces) + rng.choice(["", "", "", ",", str(rng.randint(0, 400))]) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    few, many = toxicity.Finder(chars, wanted, joined, most=30), toxicity.Finder(chars, wanted, joined)
    plain = toxicity.Joined(joined)
    got = [many.text(t) for t in texts]
    assert got == [few.text(t) for t in texts] == [toxicity.Finder(chars, wanted, joined).text(t) for t in texts]
    assert len(few.known) < len(many.known) and any(words for words, _ in got)
    assert all(plain.words(chars, t.split()) <= words for t, (words, _) in zip(texts, got, strict=True))


def test_score_equals_brute_force(spark, docs_of):
    """Evidence and scores of 200 texts from decoding every token, counted in plain dictionaries."""
    docs, labels = _corpus(9)
    docs, labels = docs[:200], labels[:200]
    frame = docs_of(docs)
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), prior=2.0, lift=1.2)
    toxic = dict(labels)
    base = (sum(toxic.values()) + 0.1) / (len(toxic) + 1)
    held = {i: toxicity.all_words(model.chars, t, {}) for i, t in docs}
    n, bad = Counter(), Counter()
    for i, found in held.items():
        each = {f for w in found for f in toxicity.features(w)}
        n.update(each)
        if toxic[i]:
            bad.update(each)
    share = {f: (bad[f] + 2.0 * base) / (n[f] + 2.0) for f in n if bad[f] > 2}
    want = {f: q for f, q in share.items() if q > 1.2 * base}
    assert model.evidence == pytest.approx(want) and want
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    joined = toxicity.Joined(f for f, q in want.items() if not f.endswith("*") and q >= toxicity.JOIN_AT)
    for i, t in docs:
        found = held[i] | joined.words(model.chars, t.split())
        strengths = [max(want[f] for f in toxicity.features(w) if f in want) for w in found if any(f in want for f in toxicity.features(w))]
        top = [*sorted(strengths, reverse=True), base, base, base][:3]
        x = np.array([*(math.log(q / (1 - q)) for q in top), math.log1p(len(t.split())), 1.0])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-float(np.clip(x @ model.weights, -30, 30)))))


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs_of([(1, "some words")]), none)
    assert len({r["score"] for r in toxicity.score(docs_of([(1, "a"), (2, "b")]), model).collect()}) == 1
    assert toxicity.score(docs_of([]), model).count() == 0


def test_query_on_held_out_labels(spark):
    from tidewire.llm.queries import QUERIES

    got = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] == 1 for r in rows)
    assert hit >= 0.85 * sum(r["predicted"] == 1 for r in rows)
