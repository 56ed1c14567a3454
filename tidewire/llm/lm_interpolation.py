"""Deleted interpolation: bigram, unigram and uniform estimates, mixed by weights that depend on how often the context
was seen; the weights are learned by expectation-maximisation on counts with a held-out part of the corpus deleted.

Documents are read once into blocks (word codes of some megabytes of text, stored).  A block sends each distinct
word and bigram once, with its count, to the range of the hash space that owns it; the range adds the blocks up and
answers every block with totals in the block's own order, without keys.  So a word that is in every document costs one
entry a block, no count table is broadcast, and no token is shuffled on its own.  Blocks of the held-out part also
get totals without that part; they reduce to a histogram over a fixed grid (context bucket and two probabilities
in quarter octaves), on which expectation-maximisation runs.  The final estimates count all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.blocks import (
    WordHashes, expand, expand_sorted, mixed, range_slices, squeeze, squeeze_sorted, text_runs, words_of,
)
from tidewire.llm.storage import stored

#: Hashes of the two marks that are no words, and the roles of blocks. (fixed values)
START, END = 0x53544152545F5F31, 0x454E445F5F5F5F32
APART, DELETED, KEPT = 0, 1, 2
WORDS, PAIRS, SUMS = 1, 2, 0
BLOCK_BYTES = 6_000_000
BUCKETS, STEPS = 64, 4  # context-frequency octaves; grid steps an octave


@dataclass(frozen=True)
class Corpus:
    """Tokens and distinct tokens of the training part, and of it without the deleted part."""

    tokens: int
    distinct: int
    kept_tokens: int
    kept_distinct: int


@dataclass
class Model:
    corpus: Corpus
    totals: DataFrame
    blocks: DataFrame
    ranges: int
    weights: np.ndarray = field(default_factory=lambda: np.full((BUCKETS, 3), 1 / 3))


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the octave of the count."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def block_rows(docs: DataFrame, role: Column, doc_id: str, text: str) -> DataFrame:
    """Stored blocks: ``block``, ``role``, ``doc_ids``, ``lengths``, ``hashes`` (of the block's words), ``codes``.

    Each text becomes its words and one end mark.
    """
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("role", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        ]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        for batch in batches:
            roles = batch.column(2).to_numpy()
            for kind in (APART, DELETED, KEPT):
                chosen = batch.filter(pa.array(roles == kind))
                for start, texts in text_runs(chosen.column(1), BLOCK_BYTES):
                    local: dict[bytes, int] = {}
                    spoken, lengths = [], np.empty(len(texts), dtype=np.uint32)
                    for i, t in enumerate(texts):
                        words = words_of(t)
                        for w in words:
                            if w not in local:
                                local[w] = len(local) + 1
                        spoken.append(np.fromiter(map(local.__getitem__, words), dtype=np.uint32, count=len(words)))
                        spoken.append(np.zeros(1, dtype=np.uint32))
                        lengths[i] = len(words) + 1
                    codes = np.concatenate(spoken)
                    known = np.fromiter(map(hashes.__getitem__, local), dtype=np.uint64, count=len(local))
                    known = np.concatenate([np.array([END], dtype=np.uint64), known])
                    order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
                    place = np.empty(len(order), dtype=np.uint32)
                    place[order] = np.arange(len(order), dtype=np.uint32)
                    hashes.trim()
                    yield pa.record_batch(
                        [[number], pa.array([kind], pa.int32()), pa.array([chosen.column(0)[start : start + len(texts)].to_pylist()], pa.list_(chosen.column(0).type)),
                         [squeeze(lengths)], [squeeze(known[order])], [squeeze(place[codes])]], schema.names,
                    )
                    number += 1

    return stored(docs.select(doc_id, F.col(text).cast("string"), role.cast("int")).mapInArrow(make, schema), "lm-blocks")


class Block:
    """Words, pairs and documents of one stored block, in the order in which totals come back."""

    def __init__(self, lengths: bytes, hashes: bytes, codes: bytes):
        self.lengths, hashes, self.codes = expand(lengths, np.uint32).astype(np.int64), expand(hashes, np.uint64), expand(codes, np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word_order = np.argsort(hashes)
        self.words = hashes[self.word_order]
        self.end = int(np.flatnonzero(hashes == np.uint64(END))[0])
        before = np.empty_like(self.codes)
        before[1:], before[self.starts] = self.codes[:-1], len(hashes)
        self.before = before
        pairs, self.pair_of = np.unique(before * len(hashes) + self.codes, return_inverse=True)
        first = np.append(hashes, np.uint64(START))[pairs // len(hashes)]
        keys = mixed(first * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs % len(hashes)])
        self.pair_order = np.argsort(keys)
        self.pairs = keys[self.pair_order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        words, pairs = np.bincount(self.codes, minlength=len(self.words)), np.bincount(self.pair_of, minlength=len(self.pairs))
        return words[self.word_order], pairs[self.pair_order]

    def spread(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: count of the token, of its pair and of its context, from totals in key order."""
        by_code, by_pair = np.empty_like(words), np.empty_like(pairs)
        by_code[self.word_order], by_pair[self.pair_order] = words, pairs
        return by_code[self.codes], by_pair[self.pair_of], np.append(by_code, by_code[self.end])[self.before]


def _ask(blocks: DataFrame, ranges: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["lengths"], row["hashes"], row["codes"])
                out = []
                for kind, keys, counts in zip((WORDS, PAIRS), (block.words, block.pairs), block.counts(), strict=True):
                    for r, a, b in range_slices(keys, ranges):
                        n = squeeze(counts[a:b].astype(np.uint32)) if row["role"] != APART else None
                        out.append((r, row["block"], row["role"], kind, squeeze_sorted(keys[a:b]), n))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["r", "block", "role", "kind", "keys", "counts"])

    schema = "r int, block long, role int, kind int, keys binary, counts binary"
    return blocks.select("block", "role", "lengths", "hashes", "codes").mapInArrow(send, schema)


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one range, for each block in the order it asked; and the sums of the range's words."""
    rows, out = table.to_pylist(), []
    for kind in (WORDS, PAIRS):
        asked = [x for x in rows if x["kind"] == kind]
        if not asked:
            continue
        keys = [expand_sorted(x["keys"]) for x in asked]
        counts = [expand(x["counts"], np.uint32).astype(np.int64) if x["counts"] is not None else np.zeros(len(k), dtype=np.int64) for x, k in zip(asked, keys, strict=True)]
        kept = [n if x["role"] == KEPT else np.zeros_like(n) for x, n in zip(asked, counts, strict=True)]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        part = np.bincount(where, weights=np.concatenate(kept), minlength=len(distinct)).astype(np.int64)
        at = 0
        for x, k in zip(asked, keys, strict=True):
            mine = where[at : at + len(k)]
            at += len(k)
            less = squeeze(part[mine]) if x["role"] == DELETED else None
            out.append((x["block"], x["role"], kind, x["r"], squeeze(total[mine]), less, 0, 0, 0, 0))
        if kind == WORDS:
            out.append((-1, -1, SUMS, asked[0]["r"], None, None, int(total.sum()), int((total > 0).sum()), int(part.sum()), int((part > 0).sum())))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[n.split()[0] for n in _TOTALS.split(", ")])


_TOTALS = "block long, role int, kind int, r int, total binary, less binary, tokens long, distinct long, kept_tokens long, kept_distinct long"


def _gathered(block: Block, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(((x["kind"], x["r"], x[column]) for x in answers.select(["kind", "r", column]).to_pylist()), key=lambda x: x[:2])
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *(expand(blob, np.int64) for kind, _, blob in rows if kind == k)]) for k in (WORDS, PAIRS))


def _estimates(words: np.ndarray, pairs: np.ndarray, context: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pairs / np.maximum(context, 1), 0.0), words / max(tokens, 1)


def _grid(p: np.ndarray) -> np.ndarray:
    """Quarter octaves below 1, from 1; 0 for probability 0."""
    return np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.where(p > 0, p, 1))).astype(np.int64), 0)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)


def learned_weights(cells: np.ndarray, uniform: float, rounds: int = 40) -> np.ndarray:
    """Mixture weights (pair, word, uniform) for each context bucket, from rows (bucket, pair step, word step, count).

    A bucket leans on the weights of all buckets as if by ten tokens more, so rare buckets stay sensible.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 3].astype(float)
    p = np.stack([_value(cells[:, 1]), _value(cells[:, 2]), np.full(len(cells), uniform)], axis=1)

    def posterior(w: np.ndarray) -> np.ndarray:
        share = w * p
        return share / share.sum(axis=1, keepdims=True) * n[:, None]

    common = np.full(3, 1 / 3)
    for _ in range(rounds):
        common = (posterior(common[None, :]).sum(axis=0) + 1e-3) / (n.sum() + 3e-3)
    weights[:] = common
    for _ in range(rounds):
        found = posterior(weights[bucket])
        sums = np.stack([np.bincount(bucket, weights=found[:, j], minlength=BUCKETS) for j in range(3)], axis=1)
        weights = (sums + 10 * common) / (sums.sum(axis=1, keepdims=True) + 10)
    return weights


def fit(docs: DataFrame, role: Column, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> Model:
    """Count and learn.  ``role``: APART (scored only), DELETED (trains; weights are learned on it) or KEPT (trains)."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_rows(docs, role, doc_id, text)
    totals = stored(_ask(blocks, ranges).groupBy("r").applyInArrow(_answer, _TOTALS), "lm-totals")
    sums = totals.filter(F.col("kind") == SUMS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "kept_tokens", "kept_distinct")]).first()
    corpus = Corpus(*sums)

    def histogram(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        one = Block(row["lengths"], row["hashes"], row["codes"])
        words, pairs, context = one.spread(*_gathered(one, answers, "less"))
        second, first = _estimates(words, pairs, context, corpus.kept_tokens)
        steps = np.stack([_bucket(context), _grid(second), _grid(first)], axis=1)
        cells, n = np.unique(steps, axis=0, return_counts=True)
        return pa.table([*(pa.array(cells[:, j]) for j in range(3)), pa.array(n)], names=["bucket", "pair", "word", "n"])

    deleted = blocks.filter(F.col("role") == DELETED).drop("doc_ids")
    answers = totals.filter(F.col("role") == DELETED).select("block", "kind", "r", "less")
    seen = deleted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(histogram, "bucket long, pair long, word long, n long")
    # at most one row per cell of the grid: buckets x steps x steps
    cells = seen.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas().to_numpy()
    return Model(corpus, totals, blocks, ranges, learned_weights(cells, 1 / (corpus.kept_distinct + 1)))


def score(model: Model, id_type: T.DataType) -> DataFrame:
    """``doc_id``, ``role``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every document.

    ``base_score`` adds one to every count.  A null or empty text is its end mark alone; repeated rows are scored each.
    """
    corpus, weights = model.corpus, model.weights
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("role", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
         T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def rate(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        one = Block(row["lengths"], row["hashes"], row["codes"])
        words, pairs, context = one.spread(*_gathered(one, answers, "total"))
        second, first = _estimates(words, pairs, context, corpus.tokens)
        w = weights[_bucket(context)]
        p = w[:, 0] * second + w[:, 1] * first + w[:, 2] / (corpus.distinct + 1)
        base = np.log10((words + 1) / (corpus.tokens + corpus.distinct + 1))
        known, low, high = (np.add.reduceat(x, one.starts) for x in ((words > 0).astype(np.int64), base, np.log10(p)))
        size = len(one.lengths)
        columns = [pa.array(np.full(size, row["role"], dtype=np.int32)), pa.array(one.lengths), pa.array(known), pa.array(np.full(size, corpus.tokens)), pa.array(low), pa.array(high)]
        return pa.table([block.column("doc_ids").combine_chunks().flatten(), *columns], names=schema.names)

    answers = model.totals.filter(F.col("kind") != SUMS).select("block", "kind", "r", "total")
    return model.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, schema)
