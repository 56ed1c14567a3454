from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage kept, written and read as the check does it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near copies", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_no_kept_pair_is_a_near_copy_and_every_group_keeps_one(spark, stages):
    from tests_llm_help import near_components

    _, before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    groups = near_components(texts)
    assert {r["doc_id"] for r in after.collect()} == {min(g) for g in groups}


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Target of each source: weights in the order of names, nothing beyond cap times the size, the excess dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > cap * sizes[s]}
        target |= {s: cap * sizes[s] if s in full else unit * weight[s] for s in (full or free)}
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


def test_mix_meets_its_targets(stages):
    _, before, after = stages[2]
    size = F.expr("regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')")
    had = {r["source"]: r["n"] for r in before.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    got = {r["source"]: r["n"] for r in after.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert max(Counter(r["doc_id"] for r in after.select("doc_id").collect()).values()) <= 3
    longest = max(r["n"] for r in before.select(size.alias("n")).collect())
    for source, target in shares(had).items():
        assert abs(got.get(source, 0) - target) <= max(0.05 * target, longest), source


def test_toxic_documents_go_as_the_scores_say(spark, stages):
    from tidewire.llm.queries import QUERIES

    _, before, after = stages[0]
    toxic = {r["doc_id"] for r in QUERIES["op7_toxicity"](spark, SF).collect() if r["predicted"]}
    assert toxic and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - toxic


def test_everything_kept_is_packed_once(stages):
    _, before, after = stages[3]
    encoder = packing.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(x) // 2 + 1 for x in encoder.texts([r["text"] for r in before.select("text").collect()]))
    assert sum(r["length"] for r in after.collect()) == want


def test_repeated_rows_keep_one(spark, docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, "")]
    got = corpus_pipeline.without_near_copies(spark, docs_of(rows), SF)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([1, None, 3])


def test_run_gives_the_stages_result(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count()


def test_an_id_of_several_texts_keeps_each(spark, docs_of):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue grey black white"
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (3, None), (3, ""), (3, ""), (4, None), (None, a), (None, a)]
    got = corpus_pipeline.without_near_copies(spark, docs_of(rows), SF)
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "text").collect()))) == sorted(
        map(repr, [(0, a), (1, b), (3, c), (3, None), (3, ""), (4, None), (None, a), (None, a)])
    )


def test_empty_table_and_null_texts_pass_all_stages(spark, docs_of):
    columns = corpus_pipeline.COLUMNS
    for rows, left in (([], 0), ([(1, None), (2, ""), (3, None), (4, "plain words of a short text")], 4)):
        docs = docs_of(rows).select(*columns)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns and docs.count() == left
        assert corpus_pipeline.packed(spark, docs, SF).count() == left
