import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import language_id as lid
from tidewire.llm.char_grams import keys_of

SYLLABLES = {
    "en": ["the", "ing", "wh", "ou", "sh", "tion", "and", "er", "ly"],
    "de": ["sch", "ung", "ein", "ä", "keit", "ö", "pf", "und", "ver"],
    "fr": ["eau", "oi", "qu", "é", "ment", "eux", "ç", "le", "ère"],
    "ru": ["пр", "ов", "ный", "ста", "ть", "ко", "ла", "ени"],
    "uk": ["при", "ів", "ння", "ста", "ти", "ко", "її", "є"],
    "el": ["κα", "ος", "το", "μεν", "ι", "σα"],
}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(lang, text_of(rng, lang, rng.choice([3, 30, 80]))) for lang in SYLLABLES for _ in range(40)] + [(None, "zz qq"), ("en", None), ("en", "")]
    return lid.learn(spark.createDataFrame(rows, "lang string, text string"))


def labelled(spark, model, rows, **options):
    schema = "doc_id long, text string, lang string, score string, spans string, lang_pred int"
    df = spark.createDataFrame([(i, t, "xx", "s", "s", 1) for i, t in rows], schema)
    return {r["doc_id"]: r for r in lid.label(df, model, **options).collect()}


def total(scores, path, penalty):
    return sum(scores[t][k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, k, penalty = int(rng.integers(1, 7)), int(rng.integers(1, 4)), float(rng.choice([0.0, 0.5, 3.0, 10.0]))
        scores = -rng.integers(0, 7, (n, k)).astype(np.float32)
        scores[np.arange(n), rng.integers(0, k, n)] = 0
        best = max(total(scores, p, penalty) for p in product(range(k), repeat=n))
        assert total(scores, lid.best_path(scores, penalty).tolist(), penalty) == pytest.approx(best)
        path, value = lid.viterbi(scores, penalty)
        assert total(scores, path.tolist(), penalty) == pytest.approx(value) == pytest.approx(best)


def test_one_language_is_taken_among_equal_paths():
    scores = np.array([[0, -5], [-5, 0], [0, -5]], dtype=np.float32)
    assert lid.best_path(scores, 2.5).tolist() == [0, 0, 0]
    assert lid.best_path(scores, 2.0).tolist() == [0, 1, 0]


@pytest.mark.parametrize("lang", SYLLABLES)
def test_held_out_texts(spark, model, lang):
    rng = random.Random(77)
    got = labelled(spark, model, [(k, text_of(rng, lang, 12)) for k in range(60)])
    right = sum(r["lang_pred"] == lang for r in got.values())
    assert right >= 57
    assert all(0 <= r["score"] <= 1 and r["lang"] == "xx" for r in got.values())


def test_scripts_narrow_candidates(model):
    names = model.names
    scores = model.scores(["κατο", "ста", "the", "漢字"])
    candidates = [{n for n, s in zip(names, row, strict=True) if s > -lid.MOST} for row in scores]
    assert candidates[0] == {"el"} and candidates[1] <= {"ru", "uk"} and candidates[2] <= {"en", "de", "fr"}
    assert candidates[3] == set(names) and not scores[3].any()
    assert (scores.max(axis=1) == 0).all() and (scores >= -lid.MOST).all()


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(8)
    parts = [("en", text_of(rng, "en", 25)), ("de", text_of(rng, "de", 25)), ("el", text_of(rng, "el", 12)), ("en", text_of(rng, "en", 25))]
    whole = " -- ".join(p for _, p in parts).replace("the", "The")
    got = labelled(spark, model, [(1, "12 " + whole + " !")])[1]
    assert [s["lang"] for s in got["spans"]] == [lang for lang, _ in parts]
    at = 3
    for span, (_, part) in zip(got["spans"], parts, strict=True):
        assert abs(span["start"] - at) <= 20 and abs(span["end"] - at - len(part)) <= 20
        at += len(part) + 4
    assert got["spans"][0]["start"] == 3 and got["spans"][-1]["end"] == 3 + len(whole)
    assert got["lang_pred"] == "en" and got["score"] < 0.8


def test_texts_without_letters_and_other_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 ½ ² __ ### 😀"), (4, "the" * 20_000), (5, "漢字" * 400), (6, "İİ the and"), (7, "THE AND THING"), (7, "THE AND THING")]
    got = labelled(spark, model, rows)
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, []) for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[4]["spans"][0]["end"] == 60_000
    assert got[5]["lang_pred"] in model.names
    assert got[6]["spans"][-1]["end"] == 10 and got[7]["lang_pred"] == "en"
    assert lid.label(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert lid.label(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model, keep=["doc_id"]).columns == ["doc_id", "lang_pred", "score", "spans"]


def test_without_training_rows(spark):
    empty = lid.learn(spark.createDataFrame([(None, "text"), ("en", None), ("en", "12")], "lang string, text string"))
    got = labelled(spark, empty, [(1, "some words")])[1]
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_counts_cover_all_training_texts(spark):
    rows = [("a", "abab cd")] * 30 + [("b", "Ab")] * 5
    model = lid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(7))
    assert model.names == ["a", "b"]
    want = Counter()
    for lang, text in rows:
        for w in text.lower().split():
            for k, c in enumerate(w + " "):
                for n in range(lid.ORDER):
                    keys = keys_of(("  " + w)[k + 2 - n : k + 2], c)
                    want.update((key % lid.BUCKETS, lang) for key in keys)
    got = {(c, model.names[k]): int(model.counts[c, k]) for c, k in zip(*np.nonzero(model.counts), strict=True)}
    assert got == dict(want)
    assert lid.learn(spark.createDataFrame(rows, "lang string, text string"), most=1).names == ["a"]


def test_query_on_held_out_documents(spark):
    from tidewire.llm.queries import QUERIES

    got = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    n, right = got.filter("held_out").join(docs, "doc_id").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 2000 and right >= 0.98 * n
