"""Hashed character grams of words: 64-bit keys of every gram and its context, for many words at once or one by one.

A word stands between borders (a space, code 0 here); its closing border is a character, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewire.llm.blocks import FINAL, mixed

#: Multiplier of the rolling key, above any code point. (fixed value)
STEP = 0x110001
_MASK = (1 << 64) - 1


@dataclass
class Grams:
    """Keys of the grams of 1 to ``order`` characters that end at each character of some words, and of their contexts."""

    grams: list[np.ndarray]
    contexts: list[np.ndarray]
    owner: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str], order: int) -> Grams:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1)
        chars = np.zeros(int(lengths.sum()) + len(words), dtype=np.uint64)
        inside = np.ones(len(chars), dtype=bool)
        inside[ends - 1] = False
        chars[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.arange(len(chars)) - np.repeat(ends - lengths - 1, lengths + 1)
        grams, contexts, context = [], [], np.zeros(len(chars), dtype=np.uint64)
        for k in range(order):
            if k:
                before = np.zeros_like(chars)
                before[k:] = chars[:-k]
                before[place < k] = 0
                context = context * np.uint64(STEP) + before + np.uint64(1)
            contexts.append(mixed(mixed(context) + np.uint64(2 * k)))
            grams.append(mixed(mixed(context * np.uint64(STEP) + chars + np.uint64(1)) + np.uint64(2 * k + 1)))
        return cls(grams, contexts, np.repeat(np.arange(len(words)), lengths + 1), lengths)


def _mixed(value: int) -> int:
    for shift, factor in FINAL:
        value ^= value >> shift
        value = value * factor & _MASK
    return value


def keys_of(context: str, char: str) -> tuple[int, int]:
    """(key of the context, key of the gram that ends with ``char``); a space is the border."""
    key = 0
    for c in reversed(context):
        key = (key * STEP + (0 if c == " " else ord(c)) + 1) & _MASK
    gram = (key * STEP + (0 if char == " " else ord(char)) + 1) & _MASK
    k = len(context)
    return _mixed((_mixed(key) + 2 * k) & _MASK), _mixed((_mixed(gram) + 2 * k + 1) & _MASK)
