"""Packing of tokenised documents into sequences of fixed length.

Documents are dealt at random into groups of bounded expected size; each group is packed by itself. Full sequences are cut from the front of
long documents; what is left is packed by first-fit decreasing, where a tournament tree over the bins' free room finds the leftmost bin that
fits in logarithmic time. The bins that remain open then give their pieces, emptiest first, to fill the gaps of the others, and the last
one is cut into runs of power-of-two length, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .blocks import Block, Table, blocks, lean, mixed, ragged
from .pieces import LOWER, Encoded, by_document, visible_pieces

GROUP_DOCUMENTS = 1024
ASK_AT_ONCE = 4096


class FirstFit:
    """Bins of equal capacity under a tournament tree whose inner nodes hold the most free room below them."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.width, self.room = capacity, 0, 1, [0, 0]

    def place(self, size: int) -> int:
        """Put a piece into the leftmost bin with room for it, a new one if there is none."""
        if self.room[1] < size:
            if self.count == self.width:
                leaves = self.room[self.width :] + [0] * self.width
                self.width *= 2
                self.room = [0] * self.width + leaves
                for node in range(self.width - 1, 0, -1):
                    self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
            node = self.width + self.count
            self.room[node] = self.capacity
            self.count += 1
        else:
            node = 1
            while node < self.width:
                node *= 2
                if self.room[node] < size:
                    node += 1
        found = node - self.width
        self.room[node] -= size
        node //= 2
        while node:
            most = max(self.room[2 * node], self.room[2 * node + 1])
            self.room[node] = most
            node //= 2
        return found


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document's place in lengths, start, length, sequence, offset) of every piece."""
    full, rest = [], []
    for i, length in enumerate(lengths):
        whole = length // capacity
        full += [[(i, k * capacity, capacity)] for k in range(whole)]
        if length % capacity:
            rest.append((length % capacity, i, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = FirstFit(capacity), []
    for size, i, start in rest:
        at = tree.place(size)
        if at == len(bins):
            bins.append([])
        bins[at].append((i, start, size))
    open_ = []
    for content in bins:
        used = sum(p[2] for p in content)
        if used == capacity:
            full.append(content)
        else:
            open_.append((used, content))
    open_.sort(key=lambda x: -x[0])
    while len(open_) > 1:  # the fullest takes from the emptiest
        used, content = open_[0]
        gap = capacity - used
        while gap and len(open_) > 1:
            least, giver = open_[-1]
            i, start, size = giver.pop()
            taken = min(size, gap)
            content.append((i, start, taken))
            gap -= taken
            if taken < size:
                giver.append((i, start + taken, size - taken))
            if giver:
                open_[-1] = (least - taken, giver)
            else:
                open_.pop()
        if gap:
            open_[0] = (capacity - gap, content)
        else:
            full.append(content)
            open_.pop(0)
    for used, content in open_:
        run, room = [], 1 << (used.bit_length() - 1)
        for i, start, size in content:
            while size:
                taken = min(size, room)
                run.append((i, start, taken))
                start, size, room, used = start + taken, size - taken, room - taken, used - taken
                if not room:
                    full.append(run)
                    run, room = [], 1 << (used.bit_length() - 1) if used else 0
    out = []
    for sequence, content in enumerate(full):
        offset = 0
        for i, start, size in content:
            out.append((i, start, size, sequence, offset))
            offset += size
    return out


class Repeats:
    """Of each of the names asked for, how often it has been asked for before."""

    def __init__(self):
        self.table, self.counts, self.used = Table(1 << 12), np.zeros(1 << 12, np.uint64), 0

    def __call__(self, names: np.ndarray) -> np.ndarray:
        codes, values = pd.factorize(np.maximum(names, 1))
        at = self.table.get(values)
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(self.used, self.used + len(new))
        self.table.put(values[new], at[new])
        self.used += len(new)
        while self.used > len(self.counts):
            self.counts = np.append(self.counts, np.zeros_like(self.counts))
        within = pd.Series(codes).groupby(codes).cumcount().to_numpy().astype(np.uint64)
        before = self.counts[at][codes] + within
        self.counts[at] += np.bincount(codes, minlength=len(values)).astype(np.uint64)
        return before


class WordTokenizer:
    """Ids of a lower-casing word-level BPE by the tokenizers library, asked once for each distinct piece of text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encoded = Encoded(self._encode, np.uint32, 500_000)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for low in range(0, len(pieces), ASK_AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[low : low + ASK_AT_ONCE]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for own in found for i in own), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        plain = Block(block.first, block.last, LOWER[block.data], block.offsets)
        starts, ends = visible_pieces(plain)
        ids, counts = self.encoded(plain.data, starts, ends)
        offsets = by_document(plain, starts, counts)
        raw = block.data.tobytes()
        if any(s in raw for s in self.special):
            parts = []
            for i in range(len(offsets) - 1):
                text = block.text(i)
                own = any(s in text for s in self.special)
                parts.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if own else ids[offsets[i] : offsets[i + 1]])
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, offsets


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", group_documents: int = GROUP_DOCUMENTS, seed: int = 7) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids followed by end_id; null and empty texts are just end_id. Every id lies in one piece. Rows that repeat are packed
    each for itself; a null key stays null. No rows give no pieces. Only key and text are read, so other columns may have any name.
    The number of groups follows the number of rows; rows are dealt to them by a hash of key, text and how many equal rows of its task came before, so
    equal rows don't meet in one group. As equal rows can stand for each other, a task that runs again deals the same rows whatever their order.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, -(-docs.count() // group_documents))

    @lean
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, earlier = word_tokenizer(path), Repeats()
        for batch in batches:
            names = batch.column(2).to_numpy().view(np.uint64)
            dealt = pa.array((mixed(names + mixed(earlier(names) + np.uint64(int(seed)))) % np.uint64(groups)).astype(np.int64))
            for block in blocks(batch.column(1)):
                ids, offsets = words.encode_block(block)
                counts = np.diff(offsets)
                held = np.full(len(ids) + len(counts), end_id, "<u4")
                held[ragged(offsets[:-1] + np.arange(len(counts)), counts)] = ids
                places = (offsets + np.arange(len(offsets))) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(held)])
                part = batch.slice(block.first, len(counts))
                yield pa.RecordBatch.from_arrays([dealt.slice(block.first, len(counts)), part.column(0), raw], ["grp", "doc_id", "ids"])

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        group, ids, doc_ids = key[0].as_py(), table.column("ids"), table.column("doc_id").to_pylist()
        raws = [x.as_buffer() for x in ids]
        rows = pack([len(x) // 4 for x in raws], capacity)
        parts = [bytes(raws[i][4 * start : 4 * (start + size)]) for i, start, size, _, _ in rows]
        return pa.table(
            {
                "doc_id": pa.array([doc_ids[r[0]] for r in rows], table.schema.field("doc_id").type),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int64()),
                "ids": pa.array(parts, pa.binary()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                "doc_tokens": pa.array([len(raws[r[0]]) // 4 for r in rows], pa.int64()),
                "sequence_id": pa.array([(group << 32) + r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("name", F.xxhash64("doc_id", "text")).mapInArrow(tokens, f"grp long, doc_id {kind}, ids binary")
    return rows.groupBy("grp").applyInArrow(packed, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
