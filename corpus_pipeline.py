"""The corpus pipeline: toxic documents go, near copies go, sources are mixed to target weights, the rest is packed.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.ship import ship_package
from tidewire.llm import entropy_mix, packing, signature_tree, toxicity, words
from tidewire.llm.queries import END_ID, PACK_LENGTH, TOXIC_AT
from tidewire.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.  Learns from labels whose fold is not held out.

    Null and empty texts hold no evidence and stay; repeated rows stay or go alike; an empty table stays empty.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(words.fold_of(F.col("doc_id"), 4) != 2)
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).filter(F.col("score") < TOXIC_AT).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked documents.

    An id may name several texts, so rows are told apart by a 64-bit hash of id and text; of a group's rows of the
    smallest id one of the smallest hash stays.  Rows without id are in no group and stay; null and empty texts are linked
    with nothing; of rows that repeat an id and its text one stays.  Only hashes that go are joined with the texts.
    """
    ship_package(spark)
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    rows = docs.select(*COLUMNS).withColumn("row", row)
    found = signature_tree.join(rows.select(F.col("row").alias("doc_id"), "text")).filter("doc_id is not null")
    groups = stored(found.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count(F.lit(1)).alias("times")), "pipeline-groups")
    linked = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_id")
    members = groups.join(linked, "component_id").join(rows.filter("row is not null").select("doc_id", "row").distinct(), "row")
    best = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    gone = members.join(best, "component_id").filter("row <> best.row").select("row").distinct()
    kept = rows.join(stored(gone, "pipeline-gone"), "row", "left_anti")
    repeated = groups.filter("times > 1").select("row")
    if not repeated.limit(1).count():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    return kept.join(repeated, "row", "left_anti").unionByName(once).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and are taken once; a null source is a source; an empty table stays empty.
    """
    ship_package(spark)
    sized = docs.select(*COLUMNS).withColumns({"size": words.word_count(F.col("text")), "crc": words.crc32_of(F.col("text"))})
    taken = entropy_mix.balance(sized, ["doc_id", "crc"])
    return taken.filter("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids.  A null or empty text is its end mark alone."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_LENGTH, END_ID, with_ids=True)


STAGES = [("toxicity", without_toxic), ("near copies", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither the learned scores nor the tokenizer; tests/llm compares stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
