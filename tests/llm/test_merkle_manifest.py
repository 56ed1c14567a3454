import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes, arity):
    """All levels of a tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for level in levels[:-1]:
        start = i - i % arity
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + arity])))
        i //= arity
    return out


def expected(rows, arity):
    """(id, leaf) -> (subroot, root, path) by lists in memory; rows are (id, group, leaf)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [grow([r[2] for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))], arity) for g in names]
    over = grow([t[-1][0] for t in trees], arity)
    out = []
    for k, (g, t) in enumerate(zip(names, trees, strict=True)):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))):
            out.append((r[0], r[2], t[-1][0], over[-1][0], siblings(t, i, arity) + siblings(over, k, arity)))
    return out


def found(df, arity, depth):
    got = merkle_manifest.manifest(df, "leaf", "lang", ["doc_id"], carry=["doc_id"], arity=arity, depth=depth)
    got = got.withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r["again"] == r["root"] for r in got)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["path"]]) for r in got), key=repr)


@pytest.mark.parametrize(("arity", "depth"), [(2, 1), (2, 2), (3, 1), (2, 8)])
def test_equals_lists_in_memory(spark, arity, depth):
    rng = random.Random(5)
    names = ["en", "de", "zz", None, "é", "", "E"]
    rows = [(k, rng.choice(["en"] * 12 + names), leaf_of(k, rng.random())) for k in range(150)] + [(1000, "alone", leaf_of(1))]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, lang string, leaf string, place string, size int")
    assert found(df, arity, depth) == sorted(expected(rows, arity), key=repr)


def test_ties_repeats_and_null_ids(spark):
    rows = [(None, "a", leaf_of(1)), (None, "a", leaf_of(2)), (3, "a", leaf_of(3)), (3, "a", leaf_of(3)), (3, None, leaf_of(3))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    assert found(df, 2, 2) == sorted(expected(rows, 2), key=repr)


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1, None, leaf_of(1))], "doc_id long, lang string, leaf string")
    assert found(one, 2, 8) == [(1, leaf_of(1), leaf_of(1), leaf_of(1), [])]
    assert found(one.limit(0), 2, 8) == []


def test_leaf_digest_tells_nulls_and_borders_apart(spark):
    rows = [(None, "ab", 1), ("", "ab", 1), ("a", "b", None), ("ab", "", None), ("é", "x" * 300_000, -5)]
    df = spark.createDataFrame(rows, "a string, b string, c long").withColumn("leaf", merkle_manifest.leaf_digest(F.col("a"), F.col("b"), F.col("c")))
    assert [r["leaf"] for r in df.collect()] == [leaf_of(*r) for r in rows]


def test_a_changed_leaf_is_found(spark):
    rows = [(k, "en", leaf_of(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string")
    got = merkle_manifest.manifest(df, "leaf", "lang", ["doc_id"], carry=["doc_id"], depth=3)
    wrong = got.withColumn("leaf", F.when(F.col("doc_id") % 7 == 0, F.lit(leaf_of("other"))).otherwise(F.col("leaf")))
    failed = wrong.filter(merkle_manifest.folded(F.col("leaf"), F.col("path")) != F.col("root"))
    assert sorted(r["doc_id"] for r in failed.collect()) == list(range(0, 50, 7))


def test_query_equals_its_sql_with_nulls(spark, tmp_path):
    import duckdb

    from tidewire.llm.queries import ORACLES, QUERIES

    rows = [(k, None if k % 11 == 0 else f"text {k}" * (k % 5), None if k % 9 == 0 else "abé"[k % 3], None if k % 4 == 0 else "s", None if k % 5 == 0 else k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(ORACLES["op11_merkle_manifest"])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select(names).collect()) == want
