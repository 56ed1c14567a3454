"""Spelling variants: words one edit apart, and the frequent word that a rare one most likely stands for.

Pivotal grams: grams (two letters) are ordered by how many words hold them, rarest first.  A word's prefix is its three
first grams in that order (all places of the third); two disjoint ones of least frequency are its pivots, chosen by
dynamic programming over their places.  One edit spoils at most one pivot, so of two words one edit apart the one whose
prefix ends earlier in the order has a pivot among the prefix grams of the other.

Position limits: beside a spared gram the edit is on one side, so the other side is the same in both words.  That side
is part of the join key, which fixes the gram's place from that end, and the lengths may differ by one.  Keys under
which too many pairs would meet are split once more: the side with the edit has an equal first or last half.  Every
pair that meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import text_runs
from tidewire.llm.storage import stored

#: What a word is made of once A-Z is lower-cased: 90 letters and signs, so at most 8,100 grams exist. (fixed values)
RUN = re.compile("[a-zÀ-ÿ]+")
GRAM, EDITS = 2, 1
RUN_BYTES = 4_000_000


def spelled(word: str, salt: int, every: int | None) -> str:
    """The word, or where ``every`` divides its salted crc32, the word without the letter that the crc32 names."""
    if every:
        h = zlib.crc32(word.encode(), salt)
        if not h % every:
            at = h % len(word)
            return word[:at] + word[at + 1 :]
    return word


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least: int = 2,
                every: int | None = None, held: int = 400_000) -> DataFrame:
    """``word``, ``n`` of the words of all whole texts, of at least ``least_length`` code points and ``least`` occurrences.

    Words are maximal runs of A-Z (lower-cased), a-z and U+00C0 to U+00FF.  ``every``: plant misspellings, see
    ``spelled``; the salt is the document's id and a colon, a null id is the empty text.  Null and empty texts hold no
    words; repeated rows count each.  A task holds ``held`` distinct words before it hands them on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            ids = batch.column(0)
            for start, run in text_runs(batch.column(1), RUN_BYTES):
                for i, t in zip(ids.slice(start, len(run)).to_pylist(), run, strict=True):
                    salt = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word, n in Counter(RUN.findall(t.encode().lower().decode())).items():
                        if len(word) >= least_length and len(word := spelled(word, salt, every)) >= least_length:
                            seen[word] += n
                    if len(seen) > held:
                        yield flush()
        yield flush()

    texts = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def pivots(prefix: list[tuple[int, int]], need: int = EDITS + 1) -> list[int]:
    """Places of ``need`` disjoint grams of least total cost among (place, cost) in the order of places.

    ``best[j]`` is the cheapest choice of j grams so far that ends before the place at hand; ties keep the earlier one.
    """
    best: list[list[tuple[int, list[int]] | None]] = []
    for at, (place, cost) in enumerate(prefix):
        here = list(best[-1]) if best else [(0, []), *[None] * need]
        free = next((best[k] for k in range(at - 1, -1, -1) if prefix[k][0] + GRAM <= place), [(0, []), *[None] * need])
        for j in range(need):
            if free[j] and (here[j + 1] is None or free[j][0] + cost < here[j + 1][0]):
                here[j + 1] = (free[j][0] + cost, [*free[j][1], place])
        best.append(here)
    return best[-1][need][1]


def marked(word: str, rank: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """(rank of the prefix's last gram, places of the prefix, places of the pivots); ``rank``: gram to (order, words)."""
    grams = sorted((*rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[GRAM * EDITS][0]
    prefix = sorted((place, words) for order, words, place in grams if order <= last)
    return last, [place for place, _ in prefix], pivots(prefix)


def _indexed(words: DataFrame) -> DataFrame:
    """``words`` with ``last``, ``prefix`` and ``pivots``."""
    grams = words.select(F.explode(F.expr(f"array_distinct(transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM})))")).alias("gram"))
    # at most one row per pair of letters, see RUN
    held = sorted((r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect())
    rank = {gram: (order, n) for order, (n, gram) in enumerate(held)}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [marked(w, rank) for w in batch.column(0).to_pylist()]
            last, prefix, chosen = ([r[k] for r in rows] for k in range(3))
            extra = [pa.array(last, pa.int32()), pa.array(prefix, pa.list_(pa.int32())), pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.record_batch([*batch.columns, *extra], ["word", "n", "last", "prefix", "pivots"])

    return words.select("word", "n").mapInArrow(mark, "word string, n long, last int, prefix array<int>, pivots array<int>")


def _entries(indexed: DataFrame, places: str) -> DataFrame:
    """One row per word, gram and side: ``key`` of the gram and the side taken to be equal, ``rest`` is the other side."""
    each = indexed.select("word", "n", "last", F.explode(places).alias("at"))
    before, gram, after = F.expr("left(word, at)"), F.expr(f"substring(word, at + 1, {GRAM})"), F.expr(f"substring(word, at + {GRAM + 1})")
    sides = F.explode(F.array(
        F.struct(F.xxhash64(F.lit(0), gram, before).alias("key"), after.alias("rest")),
        F.struct(F.xxhash64(F.lit(1), gram, after).alias("key"), before.alias("rest")),
    ))
    return each.select("word", "n", "last", sides.alias("x")).select("word", "n", "last", "x.key", "x.rest")


def _halved(entries: DataFrame, pivotal: bool) -> DataFrame:
    """The same with keys that also hold one half of the rest, for each length that the partner's rest may have.

    Rests of m and m letters, or of m and m + 1, one edit apart: their first m div 2 letters are equal or their last
    m - m div 2.  The partner is as long (0), or the pivot's rest is the shorter (1) or the longer one (2).
    """
    m = F.length("rest")
    options = []
    for kind, shorter in ((0, m), (1, m if pivotal else m - 1), (2, m - 1 if pivotal else m)):
        first = F.floor(shorter / 2).cast("int")
        for half, text in ((0, F.left(F.col("rest"), first)), (1, F.right(F.col("rest"), shorter - first))):
            options.append(F.when(shorter >= 0, F.xxhash64("key", shorter, F.lit(kind), F.lit(half), text)))
    keys = F.explode(F.filter(F.array(*options), lambda k: k.isNotNull()))
    return entries.withColumn("key", keys)


def _met(chosen: DataFrame, held: DataFrame) -> DataFrame:
    """Verified pairs of entries under one key: other words, one edit apart on the side that may differ."""
    a, b = chosen.alias("a"), held.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & (F.abs(F.length("a.rest") - F.length("b.rest")) <= 1)
    pairs = a.join(b, same & (F.levenshtein(F.col("a.rest"), F.col("b.rest"), 1) == 1))
    turned = F.col("a.word") > F.col("b.word")
    return pairs.select(
        F.least("a.word", "b.word").alias("a"), F.when(turned, F.col("b.n")).otherwise(F.col("a.n")).alias("na"),
        F.greatest("a.word", "b.word").alias("b"), F.when(turned, F.col("a.n")).otherwise(F.col("b.n")).alias("nb"),
    )


def near_pairs(words: DataFrame, most: int = 10_000) -> DataFrame:
    """``a``, ``na``, ``b``, ``nb``: every pair of distinct words (a < b) one inserted, deleted or replaced letter apart.

    ``words``: ``word`` (of the letters of ``word_counts``, at least four), ``n``; one row per word.  Keys where more
    than ``most`` pairs meet are split by halves, so a gram that very many words share is no single group.
    """
    indexed = stored(_indexed(words), "spelling-words")
    chosen, held = _entries(indexed, "pivots"), _entries(indexed, "prefix")
    sizes = chosen.groupBy("key").agg(F.count(F.lit(1)).alias("p")).join(held.groupBy("key").agg(F.count(F.lit(1)).alias("q")), "key")
    wide = stored(sizes.filter(F.col("p") * F.col("q") > most).select("key"), "spelling-wide")
    direct = _met(chosen.join(wide, "key", "left_anti"), held.join(wide, "key", "left_anti"))
    split = _met(_halved(chosen.join(wide, "key", "left_semi"), True), _halved(held.join(wide, "key", "left_semi"), False))
    return direct.unionByName(split).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` from ``word``, ``form``: where following forms ends.  Forms must not lead back.

    Every round doubles the steps taken, so a chain of length d takes log2(d) rounds.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left").withColumn("end", F.coalesce("further", "root"))
        step = stored(moved.select("word", F.col("end").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``words`` (``word``, ``n``).

    ``form``: the near word of largest n (ties: smallest) if it has at least ``ratio`` (2 or more) times the word's n,
    else null; ``root``: where following forms ends, the word itself without form; ``n_near``: number of near words.
    Words without near words have 0 and null; an empty table gives none.
    """
    counted = stored(words.select("word", "n"), "spelling-counts")
    pairs = stored(near_pairs(counted), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("n"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    judged = counted.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = stored(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
