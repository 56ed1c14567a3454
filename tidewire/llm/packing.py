"""Concatenate and cut: token streams laid end to end and cut into windows of fixed length.

First pass: every partition tokenises its documents, notes where each starts in its own stream, and the ids are
written once.  Prefix sums over the partitions' totals then turn these into global offsets.  Second pass: a document
is cut where its global interval crosses a window border, one boundary record per piece.  No sequence is gathered
anywhere unless ``sequences`` is called, and then one group is one window.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewire.llm.blocks import text_runs
from tidewire.llm.storage import stored

#: Units kept with their ids by one worker (twice as many at most), and the length up to which a unit is kept.
KEPT_PARTS, KEPT_LENGTH = 300_000, 40
#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 2_000_000
#: Documents are cut in runs of about so many ids.
CUT_IDS = 1_000_000
#: Latin letters and signs whose normal form is their lower case alone. (fixed values)
PLAIN = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if c.lower() <= "\u024f" and len(c.lower()) == 1]
LETTERS, DIGITS = ("".join(c for c in PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
#: What the whole tokenizer has to see: other characters, and what may be a control string.
ODD = f"[^{re.escape(''.join(PLAIN))}]|<\\|"
ODD_PART = re.compile(ODD)
#: The pre-tokenizer's pieces of plain parts, and the end of each part. (fixed values)
PIECES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\n{LETTERS}{DIGITS}]+")


def _byte_letters() -> list[str]:
    """Letters of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Parts(dict):
    """Ids of units, worked out on first sight: pieces of plain parts in lower case, all other parts as they stand.

    A part's end has no ids.  Two generations of recent units bound the memory.
    """

    def __init__(self, path: str):
        super().__init__({"\n": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def ids(self, unit: str) -> bytes:
        """Pieces are merged at once, all others go through the whole tokenizer."""
        if ODD_PART.search(unit):
            return array(self.code, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if not unit.isascii():
            unit = "".join([self.letters[b] for b in unit.encode()])
        return array(self.code, [t.id for t in self.merge(unit)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.ids(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) > KEPT_PARTS:
                self.age()
            self[unit] = found
        return found

    def age(self) -> None:
        self.old.clear()
        self.old.update(self)
        self.clear()
        self["\n"] = b""


def binaries(blobs: list[bytes], ends: np.ndarray) -> pa.Array:
    """The bytes of all ``blobs`` end to end, as one value up to each of ``ends``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(b"".join(blobs))])


class TextEncoder:
    """Ids of whole texts, for tokenizers whose pre-tokenizer drops white space, so that no token crosses it."""

    def __init__(self, path: str):
        self.parts = Parts(path)
        self.code = self.parts.code

    def texts(self, texts: list[str]) -> list[bytes]:
        """Each distinct space-separated part of ``texts`` is looked up once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        parts = split.values.dictionary_encode()
        odd = pc.match_substring_regex(parts.dictionary, ODD)
        plain, others = parts.dictionary.filter(pc.invert(odd)), parts.dictionary.filter(odd).to_pylist()
        get, total = self.parts.__getitem__, len(plain)
        found = list(map(get, PIECES.findall("\n".join([*plain.to_numpy(zero_copy_only=False), ""]).lower())))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = [binaries(found, np.cumsum(sizes)[sizes == 0])]
        found = list(map(get, others))
        ids.append(binaries(found, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        late = odd.to_numpy(zero_copy_only=False)
        place = np.where(late, total + np.cumsum(late) - 1, np.cumsum(~late) - 1)
        flat = pa.concat_arrays(ids).take(pa.array(place[parts.indices.to_numpy()]))
        _, starts, held = flat.buffers()
        bounds = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), held]).to_pylist()


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def released() -> None:
    """Empty what this worker keeps of encoding: later steps run in the same process."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()


def id_runs(counts: np.ndarray, most: int = CUT_IDS) -> list[tuple[int, int]]:
    """(start, end) of consecutive documents of together at most ``most`` ids, or of one larger document."""
    runs, start, total = [], 0, 0
    for i, n in enumerate(counts.tolist()):
        if i > start and total + n > most:
            runs.append((start, i))
            start, total = i, 0
        total += n
    return [*runs, (start, len(counts))] if len(counts) else runs


def token_streams(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows ``doc_id``, ``part``, ``local_start``, ``n_tokens``, ``ids`` (binary, 2 or 4 bytes an id)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type), T.StructField("part", T.LongType()), T.StructField("local_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        end, width = array(encoder.code, [end_id]).tobytes(), array(encoder.code).itemsize
        for batch in batches:
            for a, texts in text_runs(batch.column(1), RUN_BYTES):
                b = a + len(texts)
                blobs = [x + end for x in encoder.texts(texts)]
                counts = np.array([len(x) // width for x in blobs], dtype=np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part)), pa.array(starts), pa.array(counts), pa.array(blobs, pa.binary())],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
        pa.default_memory_pool().release_unused()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(chosen.mapInArrow(encode, schema), "tokens")


def pack(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (all long but the id) and, on demand, ``ids`` array<int>.

    A null or empty text is its end id alone.  Repeated rows are repeated documents; a null id is kept; a text longer
    than a window spans several.  Other columns are ignored; an empty table gives no pieces.  All sequences but the
    last are full.
    """
    streams = token_streams(docs, tokenizer, end_id, doc_id, text)
    totals = streams.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per input partition; stored, so that the planner knows its size when it chooses the join
    offsets = stored(totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")), "offsets")
    placed = streams.join(offsets, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")
    long = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *long, *ids_field])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in (x.slice(a, b - a) for x in batches for a, b in id_runs(x.column(2).to_numpy())):
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row]
            begin = np.maximum(at[row], window * length)
            size = np.minimum(at[row] + n[row], (window + 1) * length) - begin
            start = begin - at[row]
            sums, chosen = np.empty(len(row), dtype=np.int64), []
            blob, held = -1, np.empty(0, dtype="<u4")
            for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), (start + size).tolist(), strict=True)):
                if r != blob:
                    raw = batch.column(3)[r].as_buffer()
                    held, blob = np.frombuffer(raw, dtype="<u2" if raw.size == 2 * n[r] else "<u4").astype("<u4"), r
                sums[i] = zlib.crc32(held[s:e].tobytes())
                if with_ids:
                    chosen.append(held[s:e].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (start, size, sums, n[row], window, begin - window * length))]
            if with_ids:
                columns.append(pa.array(chosen, pa.list_(pa.int32())))
            yield pa.record_batch(columns, schema.names)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """``sequence_id``, ``ids`` and ``pieces`` (doc_id, start, offset, length) of pieces that carry ids.

    Short sequences are padded to ``length``, except where their length is a power of two.
    """
    one = F.struct("offset", "doc_id", "start", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size(ids)
    bare = F.bit_count(n) == 1
    padded = F.when(bare, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - n)))
    return whole.select("sequence_id", padded.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
