"""Language identification with spans: script ranges narrow the candidates of a word, a character model scores it, and
Viterbi decoding with a switching penalty labels the words of a text.

Model: for every language the counts of grams of one to three characters over the words of all its training texts, in
``BUCKETS`` hashed cells, and the share of its letters in each script.  A word's score for a language is the mean log
probability of its letters, interpolated over shorter contexts, times its length up to ``LONG`` letters; candidates
are the languages that use the word's script.  Every word costs its distance from its best language, at most ``MOST``.

Decoding: a path through the words pays ``penalty`` for every change of language.  Where no run of words can win that
penalty back against the cheapest single language, that language is the best path (the largest sum of a run tells);
only other texts go through the full recursion.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.blocks import text_runs
from tidewire.llm.char_grams import Grams
from tidewire.llm.storage import stored

#: First code points of script ranges; letters outside these scripts are "other". (fixed values)
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = [first for first, _ in RANGES]
_SCRIPT_OF = [SCRIPTS.index(name) for _, name in RANGES]
#: A letter and the letters and marks after it; long runs are cut into consecutive words.
PIECE = 32
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{PIECE - 1}}}")
_ASCII = regex.compile(rf"[a-z]{{1,{PIECE}}}")
ORDER, BUCKETS = 3, 1 << 16
LONG, MOST, LEAN, USES = 8, 6.0, 5.0, 0.001
RUN_BYTES = 4_000_000
UNKNOWN = "und"




def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    found = text.lower()
    return found if len(found) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_pattern(lower: str) -> regex.Pattern:
    return _ASCII if lower.isascii() else _WORD


def cells(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(BUCKETS)).astype(np.int64)


def script_of(word: str) -> int:
    """Script of a word's first letter, by the ranges."""
    return _SCRIPT_OF[bisect_right(_STARTS, ord(word[0])) - 1]


@dataclass
class Model:
    """``names`` by falling number of training letters; counts by cell and language; scripts that a language uses."""

    names: list[str]
    counts: np.ndarray
    uses: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages: 0 for a word's best language, down to -``MOST`` for others.

        Languages that do not use the word's script are no candidates; where none uses it, all are alike.
        """
        found = Grams.of(words, ORDER)
        p = np.full((len(found.owner), len(self.names)), 1e-4, dtype=np.float32)
        for grams, contexts in zip(found.grams, found.contexts, strict=True):
            p = (self.counts[cells(grams)] + LEAN * p) / (self.counts[cells(contexts)] + LEAN)
        starts = np.cumsum(found.lengths + 1) - found.lengths - 1
        total = np.add.reduceat(np.log(p), starts, axis=0)
        chars = (found.lengths + 1)[:, None]
        total = total / chars * np.minimum(chars, LONG)
        scripts = np.fromiter(map(script_of, words), dtype=np.int64, count=len(words))
        candidates = self.uses[scripts]
        best = np.where(candidates, total, -np.inf).max(axis=1, keepdims=True)
        out = np.where(candidates, np.maximum(total - best, -MOST), -MOST)
        out[~candidates.any(axis=1)] = 0.0
        return out.astype(np.float32)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word (rows of ``scores``) on the best path; of equal ones a path without changes is taken.

    One language throughout is best if no run of words, however labelled, gains more than the penalty against it.
    """
    totals = scores.sum(axis=0, dtype=np.float64)
    one = int(totals.argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), dtype=np.int64)
    others = scores.astype(np.float64)
    gain = -others[:, one]
    others[:, one] = -np.inf
    gain += others.max(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    if (sums - np.minimum.accumulate(sums)).max() <= penalty:
        return np.full(len(scores), one)
    path, total = viterbi(scores, penalty)
    return path if total > totals[one] else np.full(len(scores), one)


def viterbi(scores: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """(path, its total): sums of scores less the penalty for every change; ties stay, else go to the first language."""
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        best = max(value)
        top, moved = value.index(best), best - penalty
        back.append([k if v >= moved else top for k, v in enumerate(value)])
        value = [(v if v >= moved else moved) + x for v, x in zip(value, row, strict=True)]
    best = max(value)
    path = [value.index(best)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1], dtype=np.int64), best


class Labeller:
    """Labels texts; scores of recent words are kept, at most 64 MB."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.rows = max(1000, min(300_000, (64 << 20) // (4 * max(1, len(model.names)))))
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.names)), dtype=np.float32)

    def texts(self, texts: list[str]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
        """(lower-cased text, words, scores, path) of each text."""
        if len(self.place) > self.rows:
            self.place, self.table = {}, self.table[:0]
        lower = [lowered(t) for t in texts]
        found = [word_pattern(t).findall(t) for t in lower]
        new = [w for w in dict.fromkeys(w for each in found for w in each) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            parts = [self.table] + [self.model.scores(new[k : k + 50_000]) for k in range(0, len(new), 50_000)]
            self.table = np.concatenate(parts)
        for t, words in zip(lower, found, strict=True):
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            scores = self.table[at]
            yield t, words, scores, best_path(scores, self.penalty) if words else np.empty(0, dtype=np.int64)

    def judged(self, words: list[str], scores: np.ndarray, path: np.ndarray) -> tuple[str, float]:
        """(language with most letters on the path, its share of them times its probability on its own words)."""
        letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        share = np.bincount(path, weights=letters, minlength=len(self.model.names))
        top = int(share.argmax())
        sums = scores[path == top].sum(axis=0, dtype=np.float64)
        return self.model.names[top], float(share[top] / letters.sum() / np.exp(np.minimum(sums - sums[top], 700)).sum())

    def spans(self, lower: str, words: list[str], path: np.ndarray) -> list[dict]:
        """Runs of words of one language: code points from the first letter to behind the last."""
        if not words:
            return []
        if (path == path[0]).all():  # no letter stands before the first or behind the last word
            start, end = lower.index(words[0]), lower.rindex(words[-1]) + len(words[-1])
            return [{"start": start, "end": end, "lang": self.model.names[path[0]]}]
        out: list[dict] = []
        for m, language in zip(word_pattern(lower).finditer(lower), path.tolist(), strict=True):
            name = self.model.names[language]
            if out and out[-1]["lang"] == name:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": name})
        return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 256) -> Model:
    """Count the words of all texts of known language; rows with a null language or text teach nothing.

    The model has ``BUCKETS`` counts per language, so it is as large for any corpus.  At most ``most`` languages are
    learned, those with the most letters, the bound of this classifier; without rows the model knows none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def add() -> None:
            for name, words in held.items():
                to = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                kinds = list(words)
                for k in range(0, len(kinds), 50_000):
                    part = kinds[k : k + 50_000]
                    times = np.fromiter(map(words.__getitem__, part), dtype=np.int64, count=len(part))
                    found = Grams.of(part, ORDER)
                    for keys in (*found.grams, *found.contexts):
                        to += np.bincount(cells(keys), weights=times[found.owner], minlength=len(to)).astype(np.int64)
                    scripts = BUCKETS + np.fromiter(map(script_of, part), dtype=np.int64, count=len(part))
                    to += np.bincount(scripts, weights=times * found.lengths, minlength=len(to)).astype(np.int64)
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            add()
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "cell", "n"])
            sums.clear()

        for batch in batches:
            names = batch.column(0)
            for start, texts in text_runs(batch.column(1), RUN_BYTES):
                for name, t in zip(names.slice(start, len(texts)).to_pylist(), texts, strict=True):
                    lower = lowered(t)
                    held.setdefault(name, Counter()).update(word_pattern(lower).findall(lower))
                if sum(map(len, held.values())) > 300_000:
                    add()
                if len(sums) + len(held) > 64:
                    yield from flush()
        yield from flush()

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    summed = stored(known.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "language-cells")
    letters = summed.filter(F.col("cell") >= BUCKETS).groupBy("lang").agg(F.sum("n").alias("letters"))
    names = [r["lang"] for r in letters.orderBy(F.desc("letters"), "lang").limit(most).collect()]
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(names)), dtype=np.float32)
    if names:
        # at most `most` times BUCKETS rows
        rows = summed.filter(F.col("lang").isin(names)).toArrow()
        place = {name: k for k, name in enumerate(names)}
        column = np.fromiter((place[x] for x in rows.column("lang").to_pylist()), dtype=np.int64, count=len(rows))
        counts[rows.column("cell").to_numpy(), column] = rows.column("n").to_numpy()
    used = counts[BUCKETS:]
    return Model(names, counts[:BUCKETS], used > USES * np.maximum(used.sum(axis=0), 1))


def label(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = 10.0) -> DataFrame:
    """``keep`` (all columns if None) with ``lang_pred``, ``score`` (0 to 1) and ``spans`` of every whole text.

    Columns of these names are replaced.  A null text, one without a letter, and any text under a model that knows no
    language are ``und`` with score 0 and no spans.  Very long texts are decoded whole; repeated rows give the same.
    """
    out_names = ("lang_pred", "score", "spans")
    kept = [f for f in docs.schema.fields if f.name not in out_names and (keep is None or f.name in keep)]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            names, scores, spans = [], [], []
            for _, texts in text_runs(batch.column(len(kept)), RUN_BYTES):
                for lower, words, each, path in labeller.texts(texts if model.names else [""] * len(texts)):
                    name, score = labeller.judged(words, each, path) if words else (UNKNOWN, 0.0)
                    names.append(name)
                    scores.append(score)
                    spans.append(labeller.spans(lower, words, path))
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, arrow_span)]
            yield pa.record_batch([*batch.columns[:-1], *found], schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("the text to label")).mapInArrow(run, schema)
