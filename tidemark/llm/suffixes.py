"""Suffix arrays by two-stage sorting, for whole arrays at a time.

Suffixes that are smaller than their successors are sorted directly; every other one follows from its successor, which a scan over the buckets of
first bytes, from the least upwards, has always placed before. Order is needed to a depth only: suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import numpy as np


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number in their order; past the end there are zeros."""
    out = np.zeros(len(data) + 8, np.uint64)
    out[: len(data)] = data
    for size in (1, 2, 4):
        out[: len(out) - size] = out[: len(out) - size] << np.uint64(8 * size) | out[size:]
    return out[: len(data)]


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the least."""
    size = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    decided = np.append(data[1:][change] > data[:-1][change], False)
    return decided[np.searchsorted(change, np.arange(size), "left")] if size else np.zeros(0, bool)


def direct_sort(names: np.ndarray, bits: int, places: np.ndarray, depth: int) -> np.ndarray:
    """These suffixes in order of their first `depth` bytes. names: the rank of the eight bytes from each place, of so many bits, padded by zeros."""
    order, spot, group, done = places.copy(), np.arange(len(places)), np.zeros(len(places), np.int64), 0
    end = len(names) - 1
    while done < depth and len(spot):
        together = max(1, (63 - int(group[-1]).bit_length()) // bits)
        at, keys = order[spot] + done, group
        for _ in range(together):
            keys = keys << bits | names[np.minimum(at, end)]
            at += 8
        by = np.argsort(keys)
        order[spot] = order[spot[by]]
        keys, done = keys[by], done + 8 * together
        same = keys[1:] == keys[:-1]
        tied = np.zeros(len(spot), bool)
        tied[1:] = same
        tied[:-1] |= same
        starts = np.ones(len(spot), np.int64)
        starts[1:] = ~same
        spot, group = spot[tied], np.cumsum(starts[tied]) - 1
    return order


def suffix_array(data: np.ndarray, depth: int, ranks: tuple[np.ndarray, int] | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order of at least their first `depth` bytes; or those wanted (a mask), and the few that they follow from."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    names, bits = ranks or word_ranks(data)
    small = smaller_than_next(data)
    wanted = np.ones(size, bool) if wanted is None else wanted.copy()
    # what isn't smaller than its successor follows from that one, up to the first that is sorted directly
    ends = np.flatnonzero(wanted & ~small & ~np.append(wanted[1:], False))
    sorted_places = np.append(np.flatnonzero(small), size - 1)
    stops = sorted_places[np.minimum(np.searchsorted(sorted_places, ends), len(sorted_places) - 1)]
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, ends, 1)
    np.add.at(marks, stops + 1, -1)
    wanted |= np.cumsum(marks[:-1]) > 0
    direct = direct_sort(names, bits, np.flatnonzero(small & wanted), depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        queues[data[-1]].append(np.array([size - 1]))
    follows = wanted & ~small
    out = []
    for byte in range(256):
        induced = []
        front = np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, np.int64)
        while len(front):  # a run of this byte is entered from its end
            induced.append(front)
            front = front[front > 0] - 1
            front = front[(data[front] == byte) & follows[front]]
        queues[byte] = []
        placed = np.concatenate([*induced, direct[bounds[byte] : bounds[byte + 1]]]) if induced else direct[bounds[byte] : bounds[byte + 1]]
        if not len(placed):
            continue
        out.append(placed)
        before = placed[placed > 0] - 1
        before = before[follows[before]]
        first = data[before]
        larger = first > byte
        before, first = before[larger], first[larger]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        if len(first):
            edges = np.flatnonzero(np.diff(first)) + 1
            for part, value in zip(np.split(before, edges), first[np.append(0, edges)].tolist(), strict=True):
                queues[value].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def word_ranks(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(the rank, from 1, of the eight bytes from each place among all there are, padded by zeros; the bits that it needs)."""
    values = words(data)
    by = np.argsort(values)
    values = values[by]
    new = np.ones(len(data), np.int64)
    new[1:] = values[1:] != values[:-1]
    rank = np.cumsum(new)
    names = np.zeros(len(data) + 1, np.int64)
    names[by] = rank
    return names, max(1, int(rank[-1]).bit_length()) if len(data) else 1


def common_at_least(names: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether suffixes a and b have a common prefix of `depth` bytes (8 at least); both must have so many bytes."""
    together = max(1, 63 // bits)
    packed, size = names[:-1].copy(), 8
    for _ in range(together - 1):
        if size + 8 > depth:
            break
        packed[: max(0, len(packed) - size)] = packed[: max(0, len(packed) - size)] << bits | names[size:-1]
        size += 8
    live = np.arange(len(a))
    for at in [depth - size, *range(0, depth - size, size)]:  # the far end first: most of those that differ do so there
        live = live[packed[a[live] + at] == packed[b[live] + at]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated(data: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
    """Of the places asked for (a mask), those whose first `depth` bytes also stand at another one of them."""
    ranks = word_ranks(data)
    order = suffix_array(data, depth, ranks, asked)
    order = order[asked[order]]
    out = np.zeros(len(data), bool)
    if len(order) > 1:
        same = common_at_least(*ranks, order[:-1], order[1:], depth)
        out[order[:-1][same]] = True
        out[order[1:][same]] = True
    return out
