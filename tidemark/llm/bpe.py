"""Byte-pair encoding by dynamic programming over prefixes, and its decoding.

For every prefix of a piece there is exactly one token that can end its encoding. An automaton over the reversed vocabulary reads
backwards from the prefix's end and names all tokens that are its suffixes; a token is the one if it is compatible with the last
token of the prefix before it. Two tokens are compatible if no merge across their border would have come earlier than the merges that
built them, which is seen by undoing those merges one by one along the border. Following the stored last tokens from the end gives
exactly the ids that merging by rank gives. Many pieces are worked on at once: each step is done for all pieces of one length.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .blocks import Block, Table, blocks, distinct, lean, ragged
from .pieces import Encoded, by_document, spaced_pieces

NEVER = np.int64(1 << 40)
LONG = 48
#: Beyond so many the store of prefixes is emptied, so that memory is bounded.
MOST_PREFIXES = 1_000_000
#: Bytes of texts whose pieces are encoded together; fewer make numpy calls of too few pieces.
ENCODED_AT_ONCE = 2 << 20
#: The pattern of byte-level BPE, with its white space written out.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The printable characters by which vocabulary files of this kind write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, letters = parts["model"], byte_letters()
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        ids = {k: v for k, v in model["vocab"].items() if k not in self.special}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for k, v in ids.items():
            self.tokens[v] = bytes(letters[c] for c in k)
        for k, v in self.special.items():
            self.tokens[v] = k.encode()
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        pairs, made = np.zeros(len(model["merges"]), np.uint64), np.zeros(len(model["merges"]), np.int64)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            new = ids[a + b]
            self.left[new], self.right[new], self.rank[new] = ids[a], ids[b], rank
            pairs[rank], made[rank] = (ids[a] << 32 | ids[b]) + 1, rank
        self.pairs = Table(len(pairs))
        self.pairs.put(pairs, made)
        self._automaton(ids.values())
        self.seen_keys, self.seen = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21, bool)
        whole = np.flatnonzero(self.rank >= 0)
        self.holds = np.ones(size, bool)
        fits = self.meet(self.left[whole], self.right[whole], self.rank[whole])
        for token, good in sorted(zip(whole.tolist(), fits.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            self.holds[token] = good and self.holds[self.left[token]] and self.holds[self.right[token]]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.forget()
        self.encoded = Encoded(self.encode_pieces, np.uint16 if size <= 1 << 16 else np.uint32)

    def forget(self) -> None:
        """Empty the store of prefixes: a trie whose nodes hold the last token of their prefix, which doesn't depend on what follows."""
        self.nodes, self.node_tokens, self.node_count = Table(), np.full(1 << 16, -1, np.int32), 1

    def _automaton(self, ids) -> None:
        """States of the reversed tokens; a step reads one byte further to the left."""
        steps: dict[int, int] = {}
        ends = [-1]
        for token in sorted(ids, key=lambda t: len(self.tokens[t])):
            state = 0
            for byte in reversed(self.tokens[token]):
                key = state << 8 | byte
                state = steps.get(key, -1)
                if state < 0:
                    state = steps[key] = len(ends)
                    ends.append(-1)
            ends[state] = token
        self.steps = Table(len(steps))
        self.steps.put(np.fromiter(steps, np.uint64, len(steps)) + np.uint64(1), np.fromiter(steps.values(), np.int64, len(steps)))
        self.ends, self.step_of = np.array(ends), steps
        first = [steps.get(byte, -1) for byte in range(256)]
        self.near = np.full((max(first) + 1, 256), -1, np.int64)  # of the states after no and one byte, without hashing
        for state in (0, *filter(lambda x: x >= 0, first)):
            self.near[state] = [steps.get(state << 8 | byte, -1) for byte in range(256)]

    def meet(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether tokens a and b can stand side by side; a merge over the border of rank `limit` or later doesn't count."""
        good, at = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.broadcast_to(np.asarray(limit, np.int64), len(a)).copy()
        while len(at):
            over = self.pairs.get((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1))
            bad = (over >= 0) & (over < limit)
            ra, rb = self.rank[a], self.rank[b]
            done = ~bad & (ra < 0) & (rb < 0)
            good[at[done]] = True
            on = ~bad & ~done
            # of equal ranks the merge further left comes first: to the left of b's own an equal rank still counts, to the right of a's it doesn't
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)[on]
            a, b, at = np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on], at[on]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        slots = (keys * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(43)
        out = self.seen[slots]
        new = np.flatnonzero(self.seen_keys[slots] != keys)
        if len(new):
            out[new] = self.meet(a[new], b[new]) & self.holds[b[new]]
            self.seen_keys[slots[new]], self.seen[slots[new]] = keys[new], out[new]
            clash = self.seen_keys[slots[new]] != keys[new]  # another pair took the slot: its answer must be stored with it
            taken = slots[new[clash]]
            self.seen_keys[taken] = 0
        return out

    def _same_length(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (from the left, then -1) and their number for words of one length, a row of bytes each."""
        count, length = words.shape
        last = np.full((length + 1, count), -1, np.int64)
        columns = np.ascontiguousarray(words.T).astype(np.int64)
        node = np.zeros(count, np.int64)
        for end in range(1, length + 1):
            keys = (node << 8 | columns[end - 1]).astype(np.uint64) + np.uint64(1)
            node = self.nodes.get(keys)
            new = np.flatnonzero(node < 0)
            if len(new):
                codes, values, first = distinct(keys[new])
                made = np.arange(self.node_count, self.node_count + len(values))
                while self.node_count + len(values) > len(self.node_tokens):
                    self.node_tokens = np.resize(self.node_tokens, 2 * len(self.node_tokens))
                self.node_tokens[made] = self._last_token(columns, last, end, new[first])
                self.nodes.put(values, made)
                self.node_count += len(values)
                node[new] = made[codes]
            last[end] = self.node_tokens[node]
        ids, counts = np.full((count, length), -1, np.int64), np.zeros(count, np.int64)
        place, rows = np.full(count, length), np.arange(count)
        while len(rows):
            token = last[place[rows], rows]
            ids[rows, length - 1 - counts[rows]] = token
            counts[rows] += 1
            place[rows] -= self.lengths[token]
            rows = rows[place[rows] > 0]
        return ids, counts

    def _last_token(self, columns: np.ndarray, last: np.ndarray, end: int, rows: np.ndarray) -> np.ndarray:
        """The token that ends the encoding of the first `end` bytes of each of these rows."""
        out = np.full(len(rows), -1, np.int64)
        at, state, matches = np.arange(len(rows)), np.zeros(len(rows), np.int64), []
        for size in range(1, end + 1):
            byte = columns[end - size][rows[at]]
            state = self.near[state, byte] if size <= 2 else self.steps.get((state << 8 | byte).astype(np.uint64) + np.uint64(1))
            live = state >= 0
            at, state = at[live], state[live]
            token = self.ends[state]
            some = np.flatnonzero(token >= 0)
            matches.append((size, at[some], token[some]))
            if not len(at):
                break
        for size, who, what in reversed(matches):  # only one can hold; it is most often a long one
            open_ = out[who] < 0
            who, what = who[open_], what[open_]
            if len(who):
                good = self.holds[what] if size == end else self.compatible(last[end - size][rows[who]], what)
                out[who[good]] = what[good]
        return out

    def _one(self, word: bytes) -> list[int]:
        """The same for one long piece, without arrays."""
        last, backs, steps, ends = [-1] * (len(word) + 1), [0] * (len(word) + 1), self.step_of, self.ends
        known: dict[tuple[int, int], bool] = {}
        for end in range(1, len(word) + 1):
            state = 0
            for size in range(1, end + 1):
                state = steps.get(state << 8 | word[end - size], -1)
                if state < 0:
                    break
                token = int(ends[state])
                if token < 0:
                    continue
                if size == end:
                    good = bool(self.holds[token])
                elif (good := known.get((last[end - size], token))) is None:
                    good = known[last[end - size], token] = bool(self.compatible(np.array([last[end - size]]), np.array([token]))[0])
                if good:
                    last[end], backs[end] = token, end - size
                    break
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end = backs[end]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each word)."""
        if self.node_count > MOST_PREFIXES:
            self.forget()
        lengths = np.array([len(w) for w in words], np.int64)
        counts, parts = np.zeros(len(words), np.int64), {}
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length > LONG:
                for i in rows.tolist():
                    parts[i] = np.array(self._one(words[i]), np.int64)
                    counts[i] = len(parts[i])
            elif length:
                ids, n = self._same_length(np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), length))
                counts[rows] = n
                parts[-length] = rows, ids, n
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for key, part in parts.items():
            if key < 0:
                rows, ids, n = part
                out[ragged(starts[rows], n)] = ids[ids >= 0]
            elif isinstance(part, np.ndarray):
                out[starts[key] : starts[key] + len(part)] = part
            else:
                raise AssertionError
        return out, counts

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cut pieces by the pattern, then encode each distinct word."""
        order: dict[str, int] = {}
        sizes, places, find = [], [], self.pattern.findall
        for piece in pieces:
            words = find(piece.decode())
            sizes.append(len(words))
            places += [order.setdefault(w, len(order)) for w in words]
        ids, counts = self.encode_words([w.encode() for w in order])
        starts, places = np.cumsum(counts) - counts, np.array(places, np.int64)
        sums = np.append(0, np.cumsum(counts[places]))
        ends = np.cumsum(np.array(sizes, np.int64))
        return ids[ragged(starts[places], counts[places])], sums[ends] - sums[ends - sizes]

    def encode_text(self, text: bytes) -> np.ndarray:
        """Ids of one text in which special tokens may stand."""
        if not self.special:
            return self.encode_pieces([text])[0]
        out = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text.decode()):
            out.append(np.array([self.special[part]]) if part in self.special else self.encode_pieces([part.encode()])[0])
        return np.concatenate(out)

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        starts, ends = spaced_pieces(block)
        ids, counts = self.encoded(block.data, starts, ends)
        offsets = by_document(block, starts, counts)
        raw = block.data.tobytes()
        if any(s.encode() in raw for s in self.special):
            parts = []
            for i in range(len(block.offsets) - 1):
                text = block.text(i)
                own = any(s.encode() in text for s in self.special)
                parts.append(self.encode_text(text).astype(ids.dtype) if own else ids[offsets[i] : offsets[i + 1]])
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, offsets

    def decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts that each run of ids stands for; bytes that aren't UTF-8 become replacement characters."""
        sizes = self.lengths[ids]
        raw = self.flat[ragged(self.starts[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_block(ids.astype(np.int64), np.array([0, len(ids)]))[0]


@lru_cache(maxsize=2)
def _loaded(path: str, _changed: float) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, kept between tasks."""
    return _loaded(path, os.path.getmtime(path))


def encode_documents(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of docs, with `ids` (little-endian unsigned 32-bit integers) and n_tokens; with `decoded` too if asked for: what the ids stand for.

    Null and empty texts have no ids. A column of docs named like an added one is replaced. Repeated rows are encoded each for itself.
    """
    added = {"ids": "binary", "n_tokens": "long"} | ({"decoded": "string"} if decoded else {})
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*(f"`{c}`" for c in kept))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for block in blocks(batch.column(kept.index(text)), ENCODED_AT_ONCE):
                ids, offsets = words.encode_block(block)
                raw = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                cells = [raw, pa.array(np.diff(offsets))]
                if decoded:
                    cells.append(pa.array(words.decode_block(ids, offsets), pa.binary()).cast(pa.string()))
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*part.columns, *cells], [*kept, *added])

    schema = StructType([*docs.schema.fields])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of encoded, with `decoded`, the text that its ids stand for; null ids give the empty text."""
    kept = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*(f"`{c}`" for c in kept))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for block in blocks(batch.column(kept.index(ids)), 8 << 20):
                values = block.data.view("<u4")
                texts = words.decode_block(values, block.offsets // 4)
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*kept, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", "string"))

