"""Anchors: places that every window of a text chooses by its own content, so that equal windows choose the same."""

from __future__ import annotations

import numpy as np

GRAM = 32


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes that begin at each place, built by doubling; the last 31 places have none."""
    out = data.astype(np.uint64) + np.uint64(1)
    size = 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        if len(out) <= size:
            return out[:0]
        out = out[:-size] * np.uint64(factor) + out[size:]
        out ^= out >> np.uint64(29)
        size *= 2
    return out * np.uint64(0x8EBC6AF09C88C6E3)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchor_runs(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, gram hash) of each run of consecutive windows of one text with one anchor.

    The anchor of a window is the leftmost of its places whose gram has the least hash.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window or not (np.diff(offsets) >= window).any():
        return none, none, none, none.astype(np.uint64)
    grams = gram_hashes(data)
    spread = window - GRAM + 1
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keys, spread) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(anchor) + 1, np.int8)
    starts, stops = offsets[:-1], np.diff(offsets) - window + 1
    some = stops > 0
    whole[starts[some]] += 1
    whole[(starts + stops)[some]] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    new[starts[starts < len(anchor)]] = True
    first = np.flatnonzero(new & whole)
    edge = np.append(new | ~whole, True)
    stops = np.flatnonzero(edge)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    return first, last, anchor[first], grams[anchor[first]]
