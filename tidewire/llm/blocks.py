"""Numbers in blocks: hashes of words and word sequences, and arrays as small binaries for shuffles and stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Multipliers and shifts of a 64-bit finaliser. (fixed values)
FINAL = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of each 64-bit number."""
    out = values.astype(np.uint64)
    for shift, factor in FINAL:
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed on first sight; emptied by ``trim`` when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split() breaks at exactly space, tab, LF, VT, FF and CR."""
    return text.encode().lower().split() if text else []


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte planes of an integer array."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges of the hash space each key is in; ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def range_slices(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of the ranges that ascending ``keys`` reach."""
    if not len(keys):
        return []
    found = range_of(keys, ranges)
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    ends = np.append(starts[1:], len(found))
    return [(int(found[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def text_runs(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of consecutive texts of together about ``most`` bytes; nulls are empty.

    Only one run at a time is turned into Python strings.
    """
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        total += n + 16
        if total >= most:
            yield start, texts.slice(start, i + 1 - start).fill_null("").to_pylist()
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts.slice(start).fill_null("").to_pylist()
