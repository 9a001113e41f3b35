"""Places at which a pre-tokenising pattern always cuts, found for a whole block at once, and a store of encoded pieces.

The tokenizers used here cut a text by a regular expression before any merge. Only some of its cuts are needed: pieces between
them may still be cut further, by the pattern itself, but each distinct piece only once. Every place used is safe by
the patterns: a space before a character that isn't white space begins a piece; one newline between visible characters stands
alone; a run of letters ends at ASCII punctuation; and ASCII punctuation other than the apostrophe never joins a letter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .blocks import Block, Table, distinct, prefix_sums, ragged, span_hashes

LETTER, PUNCTUATION, SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
for _a, _b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    PUNCTUATION[_a : _b + 1] = True
PUNCTUATION[ord("'")] = False
SPACE[[9, 10, 11, 12, 13, 32]] = True
VISIBLE = ~SPACE & (np.arange(256) < 0x80)
#: First bytes of characters that can't be white space: ASCII but for the above, and lead bytes that no white space has.
BEGINS_VISIBLE = VISIBLE.copy()
BEGINS_VISIBLE[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _classes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(where documents begin, where letters meet punctuation)."""
    data = block.data
    begins = np.zeros(len(data) + 1, bool)
    begins[block.offsets] = True
    letter, mark = LETTER[data], PUNCTUATION[data]
    meets = np.zeros(len(data), bool)
    meets[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    return begins[:-1], meets


def spaced_pieces(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of pieces that keep the space before them; together they cover the block."""
    data = block.data
    cuts, meets = _classes(block)
    cuts |= meets
    ends_document = np.zeros(len(data) + 1, bool)
    ends_document[block.offsets] = True
    opens = np.zeros(len(data), bool)
    opens[:-1] = BEGINS_VISIBLE[data[1:]] & ~ends_document[1:-1]
    cuts |= (data == 32) & opens
    alone = np.zeros(len(data), bool)
    alone[1:] = (data[1:] == 10) & VISIBLE[data[:-1]] & opens[1:]
    alone &= ~ends_document[:-1]
    cuts |= alone
    cuts[1:] |= alone[:-1]
    starts = np.flatnonzero(cuts)
    return starts, np.append(starts[1:], len(data))


def visible_pieces(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of pieces between white space, which is left out."""
    data = block.data
    cuts, meets = _classes(block)
    space = SPACE[data]
    after = np.ones(len(data), bool)
    after[1:] = space[:-1]
    cuts |= meets | after
    starts = np.flatnonzero(cuts & ~space)
    stops = np.append(np.flatnonzero(cuts | space), len(data))
    return starts, stops[np.searchsorted(stops, starts, "right")]


#: Of each number of bytes, a mask of the first ones of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPARE = 8


def same_spans(one: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes that begin at starts in one and at others in other hold the same bytes; both arrays have SPARE bytes more than their spans."""
    same = np.ones(len(sizes), bool)
    left, right = (np.ndarray(len(x) - SPARE + 1, "<u8", x, strides=(1,)) for x in (one, other))
    at, done = np.arange(len(sizes)), 0
    while len(at) and done < 64:
        mask = FIRST_BYTES[np.minimum(sizes[at] - done, 8)]
        same[at] &= (left[starts[at] + done] ^ right[others[at] + done]) & mask == 0
        done += 8
        at = at[sizes[at] > done]
    for i in at.tolist():
        a, b, size = int(starts[i]), int(others[i]), int(sizes[i])
        same[i] &= bool((one[a : a + size] == other[b : b + size]).all())
    return same


class Encoded:
    """Ids of every distinct piece seen so far; emptied when it holds `most` pieces or `most_bytes` of them, so memory is bounded.

    Pieces are found by hashes and then compared byte by byte; one that shares its hash with another piece is encoded each time.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: type, most: int = 1_000_000, most_bytes: int = 32 << 20):
        self.encode, self.kind, self.most, self.most_bytes = encode, kind, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.table, self.count, self.size, self.held = Table(1 << 16), 0, 0, 0
        self.starts, self.counts, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.kind)
        self.places, self.sizes, self.bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint8)

    def _append(self, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> None:
        while self.count + len(counts) > len(self.counts):
            self.starts, self.counts, self.places, self.sizes = (np.resize(x, 2 * len(x)) for x in (self.starts, self.counts, self.places, self.sizes))
        while self.size + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.held + len(raw) + SPARE > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        own = slice(self.count, self.count + len(counts))
        self.starts[own], self.counts[own] = self.size + np.cumsum(counts) - counts, counts
        self.places[own], self.sizes[own] = self.held + np.cumsum(sizes) - sizes, sizes
        self.ids[self.size : self.size + len(ids)] = ids
        self.bytes[self.held : self.held + len(raw)] = raw
        self.count, self.size, self.held = self.count + len(counts), self.size + len(ids), self.held + len(raw)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in their order, number of ids of each piece)."""
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        codes, hashes, first = distinct(span_hashes(prefix_sums(data), starts, ends) | np.uint64(1))
        if self.count + len(hashes) > self.most or self.held > self.most_bytes:
            self.clear()
        padded, sizes, like = np.append(data, np.zeros(SPARE, np.uint8)), ends - starts, first[codes]
        known = self.table.get(hashes)
        new, old = np.flatnonzero(known < 0), np.flatnonzero(known >= 0)
        one, other = first[old], known[old]
        fits = np.ones(len(hashes), bool)
        fits[old] = self.sizes[other] == sizes[one]
        equal = fits[old]
        fits[old[equal]] = same_spans(padded, starts[one[equal]], self.bytes, self.places[other[equal]], sizes[one[equal]])
        same = fits[codes] & (sizes[like] == sizes)
        same[same] = same_spans(padded, starts[same], padded, starts[like[same]], sizes[same])
        raw = data.tobytes() if len(new) or not same.all() else b""
        if len(new):
            a, size = starts[first[new]], sizes[first[new]]
            ids, counts = self.encode([raw[x:y] for x, y in zip(a.tolist(), (a + size).tolist(), strict=True)])
            known[new] = np.arange(self.count, self.count + len(new))
            self._append(counts, ids, size, data[ragged(a, size)])
            self.table.put(hashes[new], known[new])
        at = known[codes]
        begins, counts, pool = self.starts[at].astype(np.int64), self.counts[at].astype(np.int64), self.ids
        if not same.all():
            apart = np.flatnonzero(~same)
            ids, own = self.encode([raw[x:y] for x, y in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True)])
            begins[apart], counts[apart] = self.size + np.cumsum(own) - own, own
            pool = np.concatenate([self.ids[: self.size], ids.astype(self.kind)])
        return pool[ragged(begins, counts)], counts


def by_document(block: Block, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """From counts of each piece, the offsets of each document's ids."""
    sums = np.append(0, np.cumsum(counts))
    return sums[np.searchsorted(starts, block.offsets, "left")]
