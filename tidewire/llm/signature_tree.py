"""N-gram Jaccard join over signature trees.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least the threshold.  Only
shingles of more than one document can lie in an intersection, so a pass in blocks first finds those: a block sends
each distinct shingle once to the range of the hash space that owns it and gets back what is shared, with document
counts.  If rare shingles come first, linked sets share one of their first ``n - ceil(t * n) + 1`` shingles, so
documents without a shared shingle there link with nothing.  Equal sets become one class.  Sharing such a shingle
joins classes to clusters that no link leaves.

A cluster is laid out in chunks by size; each chunk is a signature tree.  Its nodes hold the range of set sizes and an
OR-combined bitmap that keeps, per bit, the largest number of shingles with which one member sets it; the sum of the
smaller numbers over common bits is the largest overlap two nodes can have.  A dual traversal drops node pairs by
sizes and overlap, and pairs that are connected already.  Clusters of several chunks compare one pivot per component
first, then those pairs of chunks that hold different components and pass the nodes' bounds.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.blocks import (
    WordHashes, expand, expand_sorted, mixed, range_slices, squeeze, squeeze_sorted, text_runs, words_of,
)
from tidewire.llm.components import components
from tidewire.llm.storage import stored

BLOCK_BYTES = 5_000_000
BITS = 4096
FACTOR = 0x9E3779B97F4A7C15
MANY = np.uint32(0xFFFFFFFF)
ASK, HEAD = 0, 1
_ROWS = "r int, block long, kind int, keys binary, counts binary, docs binary"


def shingle_sets(texts: list[str], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    flat = [np.array([*map(hashes.__getitem__, words_of(t))], dtype=np.uint64) for t in texts]
    hashes.trim()
    joined = np.concatenate([*flat, np.zeros(width, dtype=np.uint64)])
    rolled = np.zeros(len(joined) - width + 1, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(FACTOR) + joined[i : len(rolled) + i]
    rolled = mixed(rolled)
    sets, at = [], 0
    for w in flat:
        if len(w) >= width:
            sets.append(np.unique(rolled[at : at + len(w) - width + 1]))
        elif len(w):
            sets.append(np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], dtype=np.uint64))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
        at += len(w)
    return sets


def _send(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL(_ROWS), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("sizes", T.BinaryType()), T.StructField("prints", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        for batch in batches:
            for start, texts in text_runs(batch.column(1), BLOCK_BYTES):
                sets = shingle_sets(texts, hashes, width)
                sizes = np.array([len(s) for s in sets], dtype=np.uint32)
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, dtype=np.int64)
                counts = np.diff(np.append(first, len(flat))).astype(np.uint32)
                keys, docs_of = flat[first], np.where(counts == 1, owner[first], MANY).astype(np.uint32)
                many = np.repeat(counts > 1, counts)
                prints = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) >> 64 * j & (1 << 64) - 1 for s in sets for j in (1, 0)], dtype=np.uint64)
                ids = batch.column(0)[start : start + len(texts)].to_pylist()
                out = [(number % ranges, number, HEAD, squeeze_sorted(keys[counts > 1]), squeeze(counts[counts > 1]), squeeze(owner[many]), ids, squeeze(sizes), squeeze(prints))]
                for r, a, b in range_slices(keys, ranges):
                    out.append((r, number, ASK, squeeze_sorted(keys[a:b]), squeeze(counts[a:b]), squeeze(docs_of[a:b]), None, None, None))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(batch.column(0).type), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)
                number += 1

    return docs.mapInArrow(send, schema)


def _answer(table: pa.Table) -> pa.Table:
    """What of each block's shingles other documents hold too, with document counts; heads pass."""
    heads = table.filter(pc.equal(table.column("kind"), HEAD))
    asked = table.filter(pc.equal(table.column("kind"), ASK)).select(["block", "keys", "counts", "docs"]).to_pylist()
    if not asked:
        return heads
    keys, counts = [expand_sorted(x["keys"]) for x in asked], [expand(x["counts"], np.uint32) for x in asked]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    out, at = [], 0
    for x, k in zip(asked, keys, strict=True):
        df = total[where[at : at + len(k)]]
        at += len(k)
        shared = df > 1
        if shared.any():
            out.append((0, x["block"], ASK, squeeze_sorted(k[shared]), squeeze(df[shared]), squeeze(expand(x["docs"], np.uint32)[shared]), None, None, None))
    if not out:
        return heads
    types = table.schema.types
    rows = pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=table.schema.names)
    return pa.concat_tables([heads, rows])


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _documents(percent: int, schema: T.StructType):
    def documents(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(x for x in rows if x["kind"] == HEAD)
        n = expand(head["sizes"], np.uint32).astype(np.int64)
        prints = expand(head["prints"], np.uint64).view(np.int64).reshape(-1, 2)
        parts = [(expand_sorted(x["keys"]), expand(x["counts"], np.uint64), expand(x["docs"], np.uint32)) for x in rows if x["kind"] == ASK]
        empty = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint32))
        keys, df, docs = (np.concatenate(c) for c in zip(empty, *parts, strict=True))
        spots, single = np.argsort(keys), docs != MANY
        often, held = expand_sorted(head["keys"]), expand(head["counts"], np.uint32).astype(np.int64)
        repeated = df[spots[np.searchsorted(keys, often, sorter=spots)]] if len(often) else empty[1]
        owner = np.concatenate([docs[single], expand(head["docs"], np.uint32)]).astype(np.int64)
        key = np.concatenate([keys[single], np.repeat(often, held)])
        order = np.lexsort((key, np.concatenate([df[single], np.repeat(repeated, held)]), owner))
        owner, key = owner[order], key[order]
        shared = np.bincount(owner, minlength=len(n))
        ends = np.cumsum(shared)
        prefix = np.maximum(0, n - _least_overlap(n, percent) + 1 - (n - shared)) * (n > 0)
        ids = head["doc_ids"]
        sets, firsts = [], []
        for i in range(len(n)):
            mine = key[ends[i] - shared[i] : ends[i]]
            use = prefix[i] > 0 and len(mine) > 0 and ids[i] is not None
            sets.append(squeeze_sorted(np.sort(mine)) if use else None)
            firsts.append(mine[: prefix[i]].view(np.int64) if use else None)
        id_type = table.schema.field("doc_ids").type.value_type
        return pa.table(
            [pa.array(ids, id_type), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(sets, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
            names=schema.names,
        )

    return documents


@dataclass
class Tree:
    """Binary tree over sets in an order that keeps alike ones together; node 0 is the root."""

    sets: list[np.ndarray]
    sizes: np.ndarray
    order: np.ndarray
    span: list[tuple[int, int]]
    child: list[tuple[int, int] | None]
    most: list[np.ndarray]
    low: list[int]
    high: list[int]


def tree_of(sets: list[np.ndarray], sizes: np.ndarray) -> Tree:
    order = np.array(sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), int(sizes[i]))), dtype=np.int64)
    tree = Tree(sets, sizes, order, [], [], [], [], [])

    def add(a: int, b: int) -> int:
        here = len(tree.span)
        for part, value in ((tree.span, (a, b)), (tree.child, None), (tree.most, None), (tree.low, int(sizes[order[a:b]].min())), (tree.high, int(sizes[order[a:b]].max()))):
            part.append(value)
        if b - a == 1:
            bits = np.bincount((sets[order[a]] & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
            tree.most[here] = np.minimum(bits, 65535).astype(np.uint16)
        else:
            left, right = add(a, (a + b) // 2), add((a + b) // 2, b)
            tree.child[here] = (left, right)
            tree.most[here] = np.maximum(tree.most[left], tree.most[right])
        return here

    add(0, len(sets))
    return tree


def _may_link(low_a: int, high_a: int, most_a: np.ndarray, low_b: int, high_b: int, most_b: np.ndarray, percent: int) -> bool:
    """Whether sets of two nodes can reach the threshold: by sizes, then by the largest possible overlap."""
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    return (100 + percent) * int(np.minimum(most_a, most_b).sum(dtype=np.int64)) >= percent * (low_a + low_b)


class Labels:
    """Component label of each set, the smaller side relabelled when two components join."""

    def __init__(self, labels: np.ndarray):
        self.now = np.asarray(labels).copy()
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.now.tolist()):
            self.members.setdefault(x, []).append(i)
        self.joined: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = int(self.now[i]), int(self.now[j])
        self.joined.append((a, b))
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.now[moved] = a
        self.members[a] += moved


def traverse(a: Tree, b: Tree, labels: Labels, shift: int, percent: int) -> None:
    """Join the labels of linked sets of two trees (or of one: ``a is b``); ``shift`` places the labels of ``b``."""
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        (xa, xb), (ya, yb) = a.span[x], b.span[y]
        same = a is b and x == y
        if same and xb - xa == 1:
            continue
        left, right = labels.now[a.order[xa:xb]], labels.now[b.order[ya:yb] + shift]
        if (left == left[0]).all() and (right == left[0]).all():
            continue
        if not same and not _may_link(a.low[x], a.high[x], a.most[x], b.low[y], b.high[y], b.most[y], percent):
            continue
        if same:
            l, r = a.child[x]
            todo += [(l, r), (r, r), (l, l)]
        elif xb - xa == 1 and yb - ya == 1:
            i, j = int(a.order[xa]), int(b.order[ya])
            common = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
            if (100 + percent) * common >= percent * int(a.sizes[i] + b.sizes[j]):
                labels.join(i, j + shift)
        elif yb - ya == 1 or (xb - xa > 1 and xb - xa >= yb - ya):
            todo += [(c, y) for c in a.child[x]]
        else:
            todo += [(x, c) for c in b.child[y]]


_CHUNK = "rep long, cluster long, chunk long, n long, shared binary, component long"


def _chunks(members: DataFrame, percent: int, chunk_shingles: int) -> DataFrame:
    """Link the sets of each chunk; rows (rep, cluster, chunk, n, shared, component), component the smallest label linked.

    ``members``: rep, cluster, n, shared, component.  Clusters within the limit are one chunk wherever they lie.
    """
    sizes = members.groupBy("cluster").agg((F.sum("n") + 64 * F.count(F.lit(1))).alias("weight"))
    small = F.col("weight") <= chunk_shingles
    keyed = members.join(sizes, "cluster").withColumns(
        {"by_size": F.when(small, F.lit(0)).otherwise(F.col("n")), "by_rep": F.when(small, F.lit(0)).otherwise(F.col("rep"))}
    )
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(spread, "cluster", "by_size", "by_rep").sortWithinPartitions("cluster", "n", "rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, weight = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            reps, cluster, n, shared, component = (list(c) for c in zip(*held, strict=True))
            labels = Labels(np.array(component, dtype=np.int64))
            tree = tree_of([expand_sorted(s) for s in shared], np.array(n, dtype=np.int64))
            traverse(tree, tree, labels, 0, percent)
            least = {label: min(component[i] for i in mine) for label, mine in labels.members.items()}
            found = [least[x] for x in labels.now.tolist()]
            arrays = (reps, cluster, [number] * len(reps), n, shared, found)
            return pa.record_batch([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(arrays)], [x.split()[0] for x in _CHUNK.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] != held[0][1] or weight >= chunk_shingles):
                    yield close()
                    held, weight, number = [], 0, number + 1
                held.append(row)
                weight += row[2] + 64
        if held:
            yield close()

    return laid.select("rep", "cluster", "n", "shared", "component").mapInArrow(link, _CHUNK)


def _relabelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    kept = rows.join(found.select(F.col("node").alias("component"), F.col("component").alias("__c")), "component", "left")
    return kept.withColumn("component", F.coalesce("__c", "component")).drop("__c")


def _across(chunks: DataFrame, percent: int, chunk_shingles: int) -> DataFrame:
    """Finish clusters of several chunks: pivots, then the pairs of chunks that may still hold a link."""
    pivots = chunks.filter("rep = component").select("rep", "cluster", "n", "shared", "component")
    linked = _chunks(pivots, percent, chunk_shingles).select(F.col("rep").alias("a"), F.col("component").alias("b"))
    now = stored(_relabelled(chunks, linked), "sig-pivoted")

    def node(table: pa.Table) -> pa.Table:
        sets = [expand_sorted(s) for s in table.column("shared").to_pylist()]
        n, c = table.column("n").to_numpy(), table.column("component").to_numpy()
        most = np.max([np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) for s in sets], axis=0)
        alike = int(c[0]) if (c == c[0]).all() else None
        columns = [table.column(k)[:1].combine_chunks() for k in ("cluster", "chunk")]
        return pa.table([*columns, pa.array([int(n.min())]), pa.array([int(n.max())]), pa.array([alike], pa.int64()), pa.array([squeeze(np.minimum(most, 65535).astype(np.uint16))])],
                        names=["cluster", "chunk", "low", "high", "alike", "most"])

    mixed_clusters = now.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("cluster")
    open_rows = now.join(mixed_clusters, "cluster", "left_semi")
    nodes = stored(open_rows.groupBy("cluster", "chunk").applyInArrow(node, "cluster long, chunk long, low long, high long, alike long, most binary"), "sig-nodes")
    other = nodes.select("cluster", *[F.col(c).alias(f"{c}_2") for c in ("chunk", "low", "high", "alike", "most")])
    differ = (F.col("chunk") < F.col("chunk_2")) & ~F.coalesce(F.col("alike") == F.col("alike_2"), F.lit(False))
    near = (100 * F.col("high") >= percent * F.col("low_2")) & (100 * F.col("high_2") >= percent * F.col("low"))
    pairs = nodes.join(other, "cluster").filter(differ & near)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            keep = [_may_link(x["low"], x["high"], expand(x["most"], np.uint16), x["low_2"], x["high_2"], expand(x["most_2"], np.uint16), percent) for x in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["chunk", "chunk_2"])

    pairs = stored(pairs.select("chunk", "low", "high", "most", "chunk_2", "low_2", "high_2", "most_2").mapInArrow(possible, "chunk long, chunk_2 long"), "sig-pairs")
    sets = open_rows.select("chunk", "n", "shared", "component")
    left = pairs.join(sets, "chunk")
    # aliases, as both sides of the cogroup come from the same rows
    again = [t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (pairs, sets)]
    right = again[0].join(again[1].withColumnRenamed("chunk", "chunk_2"), "chunk_2")

    def cross(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        trees = [tree_of([expand_sorted(s) for s in t.column("shared").to_pylist()], t.column("n").to_numpy()) for t in (one, two)]
        labels = Labels(np.concatenate([t.column("component").to_numpy() for t in (one, two)]))
        traverse(*trees, labels, one.num_rows, percent)
        return pa.table([pa.array([x[k] for x in labels.joined], pa.int64()) for k in (0, 1)], names=["a", "b"])

    edges = left.groupBy("chunk", "chunk_2").cogroup(right.groupBy("chunk", "chunk_2")).applyInArrow(cross, "a long, b long")
    return _relabelled(now, edges)


def join(
    docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None, chunk_shingles: int = 4_000_000
) -> DataFrame:
    """``doc_id`` long, ``n_shingles`` long and ``component_id`` (smallest doc_id reachable by links) of every row.

    Two texts link when ``100 * intersection >= percent * union`` of their shingles (``width`` words, A-Z lower-cased).
    A text of fewer words is one shingle; null, empty and blank texts have none, link with nothing and are their own
    component.  Rows of equal text and repeated rows are linked; a row without id takes part in nothing and has a null
    component.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = _send(chosen, width, ranges)
    schema = T.StructType.fromDDL("doc_id long, n long, p1 long, p2 long, shared binary, prefix array<long>")
    answered = asked.groupBy("r").applyInArrow(_answer, asked.schema)
    found = stored(answered.groupBy("block").applyInArrow(_documents(percent, schema), schema), "sig-docs")
    candidates = found.filter(F.col("prefix").isNotNull())
    classes = stored(
        candidates.groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix")),
        "sig-classes",
    )
    keys = classes.select("rep", F.explode("prefix").alias("key"))
    centres = keys.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b <> last").select("key", "b")
    edges = keys.join(centres, "key").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    clusters = components(edges)
    members = classes.join(clusters.withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "rep")
    members = members.select("rep", "cluster", "n", "shared", F.col("rep").alias("component"))
    chunks = stored(_chunks(members, percent, chunk_shingles), "sig-chunks")
    several = chunks.groupBy("cluster").agg(F.min("chunk").alias("x"), F.max("chunk").alias("y")).filter("x <> y").select("cluster")
    result = chunks.select("rep", "component")
    if several.limit(1).count():
        wide = chunks.join(several, "cluster", "left_semi")
        result = chunks.join(several, "cluster", "left_anti").select("rep", "component").unionByName(_across(wide, percent, chunk_shingles).select("rep", "component"))
    by_print = classes.select("p1", "p2", "rep").join(result, "rep", "left").select("p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    linked = candidates.select("doc_id", "n", "p1", "p2").join(by_print, ["p1", "p2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.filter(F.col("prefix").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(linked)
