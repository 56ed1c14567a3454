"""Exact top-k by inner product over KD-trees: one tree per shard, best-first by box bounds, kth score passed on.

A shard's tree splits at medians of the widest side and keeps tight boxes.  A query walks it best box first; the
largest inner product within a box is the sum over dimensions of the better border, and a box below the query's kth
score ends the walk.  Every query first searches its home shard; the kth score found there goes with it to all other
shards, so that these start with a bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.int8_join import best, distinct_rows, grid, usable
from tidewire.llm.storage import stored

LEAF = 256


@dataclass
class Tree:
    """Nodes in arrays: boxes, children (or -1), and the span of rows below each."""

    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    span: np.ndarray
    order: np.ndarray


def built(x: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(x))
    low, high, child, span = [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        here = x[order[a:b]]
        low.append(here.min(axis=0))
        high.append(here.max(axis=0))
        child.append([-1, -1])
        span.append((a, b))
        if parent >= 0:
            child[parent][side] = len(low) - 1
        width = high[-1] - low[-1]
        if b - a > leaf and width.max() > 0:
            middle = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(here[:, int(width.argmax())], middle - a)]
            todo += [(a, middle, len(low) - 1, 0), (middle, b, len(low) - 1, 1)]
    return Tree(np.array(low), np.array(high), np.array(child), np.array(span), order)


def walk(tree: Tree, x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard that reach ``bound``; ties with the bound are kept, as a smaller id may win."""
    heap: list[tuple[int, int]] = []
    limits = tree.low @ np.minimum(query, 0) + tree.high @ np.maximum(query, 0)
    ways = [(-limits[0], 0)]
    while ways:
        reach, node = heapq.heappop(ways)
        if -reach < bound:
            break
        a, b = tree.span[node]
        left, right = tree.child[node]
        if left >= 0:
            for way in (left, right):
                if limits[way] >= bound:
                    heapq.heappush(ways, (-limits[way], int(way)))
            continue
        scores = x[a:b] @ query
        keep = np.flatnonzero(scores >= bound)
        if len(keep) > 4 * k:  # the kth of a leaf alone bounds as well
            keep = keep[scores[keep] >= np.partition(scores[keep], -k - 1)[-k - 1]]
        for j in keep.tolist():
            i = int(ids[a + j])
            entry = (int(scores[j]), -i)
            if i == own:
                continue
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == k:
            bound = max(bound, heap[0][0])
    return [(s, -i) for s, i in heap]


def search(
    rows: DataFrame, queries: DataFrame, value: Callable[[Column], Column] | None = None, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    shard_rows: int = 8_192, group_queries: int = 4_096, leaf: int = LEAF,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` long of the k largest inner products of integer vectors.

    ``value`` makes each component (double) an integer; by default it is rounded down.  Scores are exact while they
    stay below 2**53.  Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without id; zero vectors do.  A row of the query's id is not its candidate; exact repeats count
    once; only vectors of the same length compare.  Fewer than k candidates are all returned.  Empty tables give no
    rows; other columns are ignored.
    """
    whole = F.transform("v", lambda x: (value or F.floor)(x).cast("double"))
    shaped = [usable(t, vec_id, vector, zero=True).withColumn("v", whole) for t in (rows, queries)]
    candidates, asked = grid(*shaped, shard_rows, group_queries)
    shards = int(candidates.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0]) + 1
    home = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(shards))
    schema = T.StructType.fromDDL("query_id long, vec_id long, score long")

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = distinct_rows(left)
            tree = built(x, leaf)
            x, ids = x[tree.order], ids[tree.order]
            known = dict(zip(right.column("vec_id").to_pylist(), right.column("kth").to_pylist(), strict=True))
            query_ids, q = distinct_rows(right)
            for one, vector_of in zip(query_ids.tolist(), q, strict=True):
                bound = known[one] if known[one] is not None else -np.inf
                out += [(one, i, s) for s, i in walk(tree, x, ids, vector_of, one, k, bound)]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=schema.names)

    def run(part: DataFrame) -> DataFrame:
        return candidates.groupBy("d", "i", "j").cogroup(part.groupBy("d", "i", "j")).applyInArrow(cell, schema)

    at_home = stored(best(run(asked.filter(F.col("i") == home).withColumn("kth", F.lit(None).cast("long"))), k, descending=True), "kd-home")
    kth = at_home.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    elsewhere = run(asked.filter(F.col("i") != home).join(kth, "vec_id", "left"))
    return best(elsewhere.unionByName(at_home.drop("rank")), k, descending=True)
