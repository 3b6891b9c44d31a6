"""Words of whole Arrow columns as integers: runs of kept bytes, numbered by an exact dictionary, without Python strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that share one dictionary, if no single text is longer.
BLOCK = 8 << 20
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def kept(*dropped: tuple[int, int]) -> np.ndarray:
    """Which byte values are part of words: all but these ranges, ends included.

    Only ASCII may be dropped, so a word of UTF-8 is whole characters.
    """
    table = np.ones(256, bool)
    for low, high in dropped:
        if high > 127:
            raise ValueError("bytes of longer characters cannot be dropped")
        table[low : high + 1] = False
    return table


@dataclass(frozen=True)
class Words:
    """Rows lo to hi of a batch: the words' ids in order, where each row's begin, and the word of each id."""

    lo: int
    hi: int
    ids: np.ndarray
    first: np.ndarray
    words: pa.BinaryArray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null ones are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def numbered(column: pa.Array, inside: np.ndarray, to: np.ndarray = LOWER, block: int = BLOCK, cuts: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Words]:
    """The words of a column of texts, block by block; bytes are first replaced by `to`.

    cuts tells at which bytes a word begins though the byte before is part of one too.
    """
    data, offsets = _buffers(column)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1), len(column))
        part, edges = to[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        in_word = inside[part]
        begins, ends = in_word.copy(), in_word.copy()
        begins[1:] &= ~in_word[:-1]
        ends[:-1] &= ~in_word[1:]
        if len(part):
            cut = edges[(edges > 0) & (edges < len(part))]  # a text's end ends its last word
            if cuts is not None:
                cut = np.concatenate([cut, np.flatnonzero(cuts(part))])
            begins[cut] |= in_word[cut]
            ends[cut - 1] |= in_word[cut - 1]
        starts = np.flatnonzero(begins)
        lengths = np.flatnonzero(ends) + 1 - starts
        places = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=places[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(part[in_word])]).dictionary_encode()
        yield Words(lo, hi, words.indices.to_numpy().astype(np.int64), np.searchsorted(starts, edges), words.dictionary)
        lo = hi


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array of integers, and how often each occurs."""
    return np.unique(keys, return_counts=True)
