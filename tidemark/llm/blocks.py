"""Whole texts as blocks of bytes, so that numpy works on many documents at once.

A block holds the UTF-8 bytes of consecutive rows of an Arrow batch and the offsets at which they begin. Nothing is cut:
a text longer than the block size forms a block of its own. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))


class Block(NamedTuple):
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        """The i-th row of the block."""
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, content = texts.buffers()
    count = len(texts)
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + count + 1].astype(np.int64) if count else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that gives memory back when its task ends: Python workers outlive tasks, and an executor has several."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        grown = np.full(max(count, BLOCK_BYTES + 1), base, np.uint64)
        grown[0] = 1
        _powers[int(base)] = known = np.cumprod(grown)
    return known[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xA0761D6478BD642F | 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """From these, span_hashes has the hash of any span in constant time."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    plain = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mixed(plain + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each, the distinct ones in order of appearance, the first place of each)."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return codes, values, first


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start .. start+count-1 of each pair, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


class Table:
    """Open-addressing map from unsigned 64-bit keys (0 excluded) to integers, for whole arrays of keys at a time."""

    def __init__(self, capacity: int = 1 << 16):
        size = 1 << max(4, (2 * capacity - 1).bit_length())
        self.keys, self.values, self.mask, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.uint64(size - 1), 0

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(32))

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and not yet there."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.__init__(self.used + len(keys))
            self.put(*old)
        self.used += len(keys)
        slots = self._slots(keys) & self.mask
        while len(keys):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[free]
            there = self.keys[slots] == keys
            self.values[slots[there]] = values[there]
            keys, values, slots = keys[~there], values[~there], (slots[~there] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that aren't there."""
        slots = self._slots(keys) & self.mask
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1).astype(np.int64)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slots[left] = (slots[left] + np.uint64(1)) & self.mask
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found != 0)]
        return out
