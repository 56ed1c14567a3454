"""Nearest neighbours by a block matrix join: int8 product tiles bound every distance, few pairs are computed again.

Rows are dealt to candidate groups, queries to query groups; a cell of the grid (candidate group, query group) is one
task's work.  Inside, both sides are quantised to int8 with one scale per vector.  The tile of products gives the
distance of the quantised vectors; the true one differs by no more than the two quantisation errors (triangle
inequality).  A query keeps the k smallest upper bounds; pairs whose lower bound lies below the k-th are computed
again in double precision and merged into the query's heap.  The result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Products of int8 vectors up to this length are exact in single precision.
SINGLE_DIMS = (1 << 24) // (127 * 127)
TILE = 4096
#: Relative slack for the rounding of the bounds themselves.
SLACK = 1e-9


def usable(rows: DataFrame, vec_id: str, vector: str, zero: bool = False) -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of rows whose vector is not null or empty and has only finite components;
    zero vectors only on demand.  Rows without an id are left out, and exact repeats of a row count once."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    found = rows.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & fine)
    if not zero:
        found = found.filter(F.exists(v, lambda x: x != 0))
    return found.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each vector, and norm of what quantisation lost, rounded up."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, lost * (1 + SLACK)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest rows of each query, as (distance, id) in order; a row of the query's own id is no candidate."""
    work = np.float32 if queries.shape[1] <= SINGLE_DIMS else np.float64
    q_codes, q_scale, q_lost = quantised(queries)
    q_norm = (q_codes.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    kth = np.full(len(query_ids), np.inf)
    for a in range(0, len(row_ids), TILE):
        part, ids = rows[a : a + TILE], row_ids[a : a + TILE]
        codes, scale, lost = quantised(part)
        norm = (codes.astype(np.float64) ** 2).sum(axis=1) * scale**2
        tile = (q_codes.astype(work) @ codes.T.astype(work)).astype(np.float64)
        square = q_norm[:, None] + norm[None, :] - 2 * tile * q_scale[:, None] * scale[None, :]
        slack = SLACK * (q_norm[:, None] + norm[None, :])
        error = q_lost[:, None] + lost[None, :]
        high = np.sqrt(np.maximum(square + slack, 0)) + error
        low = np.sqrt(np.maximum(square - slack, 0)) - error
        own = query_ids[:, None] == ids[None, :]
        high[own] = low[own] = np.inf
        if len(ids) > k:
            kth = np.minimum(kth, np.partition(high, k - 1, axis=1)[:, k - 1])
        near = low <= kth[:, None]
        near &= ~own
        for i, j in zip(*np.nonzero(near), strict=True):
            # added up in the order of components, as SQL does
            exact = -float(np.sqrt(np.cumsum((queries[i] - part[j]) ** 2)[-1]))
            entry = (exact, -int(ids[j]))
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)
        kth = np.minimum(kth, [-h[0][0] * (1 + SLACK) if len(h) == k else np.inf for h in heaps])
    return [sorted((-d, -i) for d, i in h) for h in heaps]


def grid(rows: DataFrame, queries: DataFrame, group_rows: int, group_queries: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells they take part in: ``d`` (dimensions), ``i`` (candidate group), ``j`` (query group)."""
    n_i = max(1, math.ceil(rows.count() / group_rows))
    n_j = max(1, math.ceil(queries.count() / group_queries))
    key = F.xxhash64("vec_id", "v")
    candidates = rows.select(
        F.size("v").alias("d"), F.pmod(key, F.lit(n_i)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))).alias("j"), "vec_id", "v",
    )
    asked = queries.select(
        F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))).alias("i"),
        F.pmod(key, F.lit(n_j)).cast("int").alias("j"), *queries.columns,
    )
    return candidates, asked


def distinct_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a cell, exact repeats once, in id order."""
    ids, x = table.column("vec_id").to_numpy(), matrix(table)
    if not len(ids):
        return ids, x
    _, first = np.unique(np.concatenate([ids[:, None].view(np.float64), x], axis=1).view(np.uint8).reshape(len(ids), -1), axis=0, return_index=True)
    order = first[np.argsort(ids[first], kind="stable")]
    return ids[order], np.ascontiguousarray(x[order])


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """Merge the cells' heaps: the k best of each query, ties to the smaller id, ``rank`` from 1."""
    score = F.col("score").desc() if descending else F.col("score")
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", group_rows: int = 16_384, group_queries: int = 4_096
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance in double precision) of the k nearest rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without id; a
    row of the query's id is not its candidate; exact repeats count once; only vectors of the same length compare.
    Fewer than k candidates are all returned; empty tables give no rows.  Other columns are ignored.
    """
    candidates, asked = grid(usable(rows, vec_id, vector), usable(queries, vec_id, vector), group_rows, group_queries)

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = distinct_rows(left)
            query_ids, q = distinct_rows(right)
            for query, found in zip(query_ids.tolist(), nearest(q, query_ids, x, ids, k), strict=True):
                out += [(query, i, d) for d, i in found]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["query_id", "vec_id", "score"])

    grouped = candidates.groupBy("d", "i", "j").cogroup(asked.groupBy("d", "i", "j"))
    return best(grouped.applyInArrow(cell, T.StructType.fromDDL("query_id long, vec_id long, score double")), k, descending=False)
