"""Exact removal of repeated substrings by suffix arrays.

Every window of `window` bytes chooses an anchor by its content, so equal windows lie in blocks (runs of windows with one anchor) whose anchors'
grams are equal. Only blocks whose gram stands at two anchors or more go on; blocks that are equal as a whole are brought together first, with their
number. The blocks of one gram meet in one task, where a suffix array over many grams' blocks puts equal windows side by side, and
common prefixes of neighbours tell which are repeated. A gram with very many different blocks would be too much for one task: its windows
are counted one by one by their digests instead, spread over all tasks, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import anchor_runs
from .blocks import Block, blocks, lean, prefix_sums, span_hashes
from .pieces import SPACE
from .session import cut, neutral, stored
from .suffixes import repeated

WINDOW = 400
#: A passage of so many words is over 50 words long. Bytes that stand for a word; bytes of a word that counts as several, and of their pieces.
PASSAGE, TOKEN, LONG_WORD, PIECE = 51, 4, 64, 8
#: Blocks of one gram that may meet in one task; the bytes of blocks that are sorted together.
MOST_BLOCKS, BATCH_BYTES = 4096, 1 << 19
#: Bits of the broadcast table that tells which texts are needed.
MARKS = 1 << 24
NAME = ["gram", "c1", "c2"]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def find_blocks(docs: DataFrame, window: int, of_words: bool = False) -> DataFrame:
    """(k1, k2, gram, c1, c2, low, count, times) of every block: its text, gram, digest, first window, number of windows, and how often it
    comes at once again, as it does in a text that repeats a few bytes over and over. With `of_words`, texts are taken as word_tokens gives them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in map(token_block, blocks(batch.column(2))) if of_words else blocks(batch.column(2)):
                first, last, _, grams = anchor_runs(block.data, block.offsets, window)
                if not len(first):
                    continue
                raw, digest = memoryview(block.data), xxhash.xxh3_128_digest
                digests = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)]), "<i8").reshape(-1, 2)
                row = np.searchsorted(block.offsets, first, "right") - 1
                new = np.ones(len(first), bool)
                new[1:] = (digests[1:] != digests[:-1]).any(axis=1) | (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(first)))
                columns = [k1[block.first + row], k2[block.first + row], grams.view(np.int64), digests[:, 0], digests[:, 1], (first - block.offsets[row]).astype(np.int32), (last - first + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c[at])) for c in columns), pa.array(times.astype(np.int32))], ["k1", "k2", *NAME, "low", "count", "times"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, gram long, c1 long, c2 long, low int, count int, times int")


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `__likely`: true if keys have the row's key, a hash, and for few others, so that only such rows' texts need to be shuffled.

    It is looked up in a table of MARKS bits, one for each value of the key's last bits, that is broadcast; with more keys it says true more often.
    """
    word = F.shiftright(F.col(key), 6).bitwiseAND(F.lit(MARKS // 64 - 1))
    bit = F.expr(f"shiftleft(1L, CAST(`{key}` & 63 AS INT))")
    marks = keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    found = rows.withColumn("__word", word).join(F.broadcast(marks), "__word", "left")
    return found.withColumn("__likely", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def with_spans(named: DataFrame, spans: DataFrame) -> DataFrame:
    """named rows with the columns of spans, which has a row for each (__k1, __k2) at most; texts that have none aren't shuffled."""
    marked = likely(named, spans, "__k1")
    none = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spans.columns if c not in ("__k1", "__k2")]
    found = marked.where("__likely").drop("__likely").join(spans, ["__k1", "__k2"], "left")
    return found.unionByName(marked.where("NOT __likely").select(*named.columns, *none))


def repeated_spans(docs: DataFrame, window: int = WINDOW, most_blocks: int = MOST_BLOCKS, of_words: bool = False, marked: bool = True) -> DataFrame:
    """From (k1, k2, text): (k1, k2, low, high), bytes of each text that lie in a window that starts anywhere else too; rows may overlap.

    k1 and k2 name a text; rows of one name must have the same text, and each counts. With `of_words`, texts and spans are as word_tokens gives them.
    `marked` shuffles only texts that are likely to be needed; it takes a broadcast, so some of the driver's memory.
    """
    # one shuffle by gram tells how often a block's gram and the block as a whole come, and which row stands for blocks that are equal as a whole
    kind = Window.partitionBy(*NAME)
    first = (F.row_number().over(kind.orderBy("k1", "k2", "low")) == 1).cast("int")
    found = find_blocks(docs, window, of_words).withColumn("first", first).withColumn("n", F.sum("times").over(kind)).withColumn("kinds", F.sum("first").over(Window.partitionBy("gram")))
    found = stored(found.where("kinds > 1 OR n > 1"))
    way = F.when(F.col("kinds") == 1, 0).when(F.col("kinds") <= most_blocks, 1).otherwise(2).alias("way")
    kinds = found.where("first = 1").select(*NAME, "n", "k1", "k2", "low", "count", way)
    alone = kinds.where("way = 0").select(*NAME, F.lit(0).cast("long").alias("start"), F.col("count").cast("long").alias("stop"))

    wanted = kinds.where("way > 0")
    if marked:
        docs = likely(docs.select("k1", "k2", "text"), wanted, "k1").where("__likely").drop("__likely")
    docs = word_tokens(docs) if of_words else docs
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*NAME, "n", "low", "count", "way")).alias("blocks"))

    @lean
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(1)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                items = lists.flatten()
                low, count = items.field("low").to_numpy(), items.field("count").to_numpy()
                raws = [part.column(0)[k].as_buffer() for k in range(part.num_rows)]
                cells = [bytes(raws[k][a:b]) for k, a, b in zip(owner.tolist(), low.tolist(), (low + count + window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(items.field(c) for c in (*NAME, "n", "way")), pa.array(cells, pa.binary())], [*NAME, "n", "way", "content"])

    # rows of one name have the same text, so they give the same contents; those are met again and skipped below
    held = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "blocks").mapInArrow(contents, "gram long, c1 long, c2 long, n long, way int, content binary")

    def sort_batch(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        sizes = np.array([len(r[4]) for r in rows])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        marks = np.zeros(len(data) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, ends - window + 1, -1)
        asked = np.cumsum(marks[:-1]) > 0
        hit = repeated(data, asked, window)
        out = []
        for row, a, b in zip(rows, starts.tolist(), ends.tolist(), strict=True):
            mine = hit[a : b - window + 1]
            if row[3] > 1:
                out.append((*row[:3], 0, len(mine)))
            elif mine.any():
                out += [(*row[:3], s, e) for s, e in zip(*(x.tolist() for x in _runs(mine)), strict=True)]
        names = [*NAME, "start", "stop"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names)

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                for row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    if row[0] != last:
                        if size >= BATCH_BYTES:
                            yield sort_batch(rows)
                            rows, size = [], 0
                        last = row[0]
                    elif rows and row[:3] == rows[-1][:3]:
                        continue  # a row of docs that repeats another one
                    rows.append(row)
                    size += len(row[4])
        if rows:
            yield sort_batch(rows)

    spans = "gram long, c1 long, c2 long, start long, stop long"
    sorted_ = held.where("way = 1").select(*NAME, "n", "content").repartition("gram").sortWithinPartitions(*NAME).mapInArrow(sort, spans)

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, digest = memoryview(batch.column(4)[row].as_buffer()), xxhash.xxh3_128_digest
                count = len(raw) - window + 1
                digests = np.frombuffer(b"".join([digest(raw[k : k + window]) for k in range(count)]), "<i8").reshape(-1, 2)
                fixed = [pa.array(np.full(count, batch.column(k)[row].as_py(), np.int64)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(count)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], [*NAME, "n", "start", "w1", "w2"])

    each = held.where("way = 2").select(*NAME, "n", "content").dropDuplicates(NAME).mapInArrow(windows, "gram long, c1 long, c2 long, n long, start long, w1 long, w2 long")
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    counted = each.join(often, ["w1", "w2"], "left_semi").select(*NAME, "start", (F.col("start") + 1).alias("stop"))

    hits = alone.unionByName(sorted_).unionByName(counted)
    # blocks that come at once again lie `count` bytes apart, less than a window, so what they cover hangs together
    high = F.col("low") + (F.col("times") - 1) * F.col("count") + F.col("stop") + window - 1
    return found.select("k1", "k2", *NAME, "low", "count", "times").join(hits, NAME).select("k1", "k2", (F.col("low") + F.col("start")).alias("low"), high.alias("high"))


def text_spans(texts: DataFrame, window: int, most_blocks: int, of_words: bool = False, marked: bool = True) -> DataFrame:
    """(__k1, __k2, __spans) of each text that has repeated spans."""
    return repeated_spans(texts, window, most_blocks, of_words, marked).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_set(F.struct("low", "high")).alias("__spans"))


def passage_words(texts: DataFrame, words: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(__k1, __k2, __words): how many words of each text lie in a run of `words` words that also starts elsewhere; texts without any have no row."""
    low, high = F.ceil(F.col("low") / TOKEN), F.floor(F.col("high") / TOKEN)  # a word counts only as a whole
    spans = repeated_spans(texts, TOKEN * words, most_blocks, of_words=True).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), low.alias("low"), high.alias("high")).distinct()
    before = F.max("high").over(Window.partitionBy("__k1", "__k2").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("high") - F.greatest("low", F.coalesce(before, F.lit(0))), F.lit(0))
    return spans.withColumn("__new", new).groupBy("__k1", "__k2").agg(F.sum("__new").alias("__words"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", most_blocks: int = MOST_BLOCKS, key: str = "doc_id", characters: bool = False, words: int | None = None) -> DataFrame:
    """All columns of docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that are left).

    Removed is each byte covered by a window of bytes that also starts at another place: in another row, a repeated one too, or in the same text,
    overlaps included. With `characters`, kept is a string and has every character of which any byte is left. Null and empty texts lose nothing; windows don't cross texts.
    With `words`, n_passage_words is the number of words that remove_repeated_words would remove; nothing is removed on their account. Columns named like added ones are replaced.
    """
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "string" if characters else "binary"} | ({"n_passage_words": "long"} if words else {})
    columns = [c for c in docs.columns if c not in added]
    docs = neutral(docs.select(*(F.col(f"`{c}`") for c in columns)), key, text)
    named = docs.select("*", F.xxhash64(F.col(key), F.col(text)).alias("__k1"), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("__k2"))
    texts = named.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    spans = text_spans(texts, window, most_blocks)
    if words:
        spans = spans.join(passage_words(texts, words, most_blocks), ["__k1", "__k2"], "full")
    joined = with_spans(named, cut(spans)).select(*docs.columns, "__spans", *(["__words"] if words else []))

    place, names = docs.columns.index(text), [*docs.columns, *added]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns))
            for block in blocks(batch.column(place)):
                out = []
                for i in range(len(block.offsets) - 1):
                    own = block.data[block.offsets[i] : block.offsets[i + 1]]
                    mine = spans[block.first + i]
                    if not mine.is_valid:
                        out.append((len(own), 0, 0, own.tobytes()))
                        continue
                    marks = np.zeros(len(own) + 1, np.int64)
                    np.add.at(marks, mine.values.field("low").to_numpy(), 1)
                    np.add.at(marks, mine.values.field("high").to_numpy(), -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    removed, runs = int(gone.sum()), len(_runs(gone)[0])
                    if characters:
                        leads = np.flatnonzero((own & 0xC0) != 0x80)
                        gone = np.repeat(np.logical_and.reduceat(gone, leads), np.diff(np.append(leads, len(own))))
                    out.append((len(own), removed, runs, own[~gone].tobytes()))
                part = batch.slice(block.first, len(out))
                cells = [pa.array([r[k] for r in out], pa.binary() if k == 3 else pa.int64()) for k in range(4)]
                if characters:
                    cells[3] = cells[3].cast(pa.string())
                if words:
                    cells.append(part.column(len(columns) + 1).fill_null(0))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *cells], names)

    schema = StructType([*docs.schema.fields])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema).toDF(*columns, *added)


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each text's words) of the runs of bytes that aren't space.

    A character from U+3000 on, of scripts without spaces, is a word; a word of over LONG_WORD bytes is cut into pieces of about PIECE bytes.
    """
    data, size = block.data, len(block.data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.offsets), np.int64)
    seen = ~SPACE[data]
    begins = np.zeros(size + 1, bool)
    begins[block.offsets] = True
    lead = (data & 0xC0) != 0x80
    wide = data[np.maximum.accumulate(np.where(lead, np.arange(size), 0))] >= 0xE3
    edge = begins[:-1] | ~np.append(False, seen[:-1]) | lead & (wide | np.append(False, wide[:-1]))
    starts = np.flatnonzero(seen & edge)
    ends = np.flatnonzero(seen & np.append(edge[1:] | ~seen[1:], True)) + 1
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            edge[a:b:PIECE] |= lead[a:b:PIECE]
        starts = np.flatnonzero(seen & edge)
        ends = np.flatnonzero(seen & np.append(edge[1:] | ~seen[1:], True)) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def token_block(block: Block) -> Block:
    starts, ends, offsets = block_words(block)
    tokens = (span_hashes(prefix_sums(block.data), starts, ends) >> np.uint64(32)).astype("<u4")
    return Block(block.first, block.last, tokens.view(np.uint8), TOKEN * offsets)


def word_tokens(texts: DataFrame) -> DataFrame:
    """From (k1, k2, text): the same with TOKEN bytes of a hash in place of each word, so that equal runs of words are equal bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                tokens = token_block(block)
                cells = [tokens.text(i) for i in range(len(block.offsets) - 1)]
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], ["k1", "k2", "text"])

    return texts.mapInArrow(run, "k1 long, k2 long, text binary")


def remove_repeated_words(docs: DataFrame, words: int = PASSAGE, text: str = "text", most_blocks: int = MOST_BLOCKS, key: str = "doc_id") -> DataFrame:
    """All columns of docs with n_removed (words) and kept (the text that is left).

    Removed is each word of a run of `words` words that also starts at another place: in another row, a repeated one too, or in the same text,
    overlaps included. What stands between removed words goes with them; white space doesn't tell runs apart. Null and empty texts lose nothing.
    """
    columns = [c for c in docs.columns if c not in ("n_removed", "kept")]
    docs = neutral(docs.select(*(F.col(f"`{c}`") for c in columns)), key, text)
    named = docs.select("*", F.xxhash64(F.col(key), F.col(text)).alias("__k1"), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("__k2"))
    texts = named.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # not marked: the pipeline, which calls this, is near its limit of the driver's memory
    spans = cut(text_spans(texts, TOKEN * words, most_blocks, of_words=True, marked=False))
    joined = named.join(spans, ["__k1", "__k2"], "left").select(*docs.columns, "__spans")
    place, names = docs.columns.index(text), [*docs.columns, "n_removed", "kept"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns))
            for block in blocks(batch.column(place)):
                starts, ends, offsets = block_words(block)
                removed, kept = [], []
                for i in range(len(block.offsets) - 1):
                    own, mine, a, b = block.text(i), spans[block.first + i], int(offsets[i]), int(offsets[i + 1])
                    if not mine.is_valid:
                        removed.append(0)
                        kept.append(own)
                        continue
                    marks = np.zeros(b - a + 1, np.int64)
                    # a word goes only as a whole
                    np.add.at(marks, -(-mine.values.field("low").to_numpy() // TOKEN), 1)
                    np.add.at(marks, mine.values.field("high").to_numpy() // TOKEN, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    out, at = [], 0
                    for first, last in zip(*(x.tolist() for x in _runs(gone)), strict=True):
                        out.append(own[at : int(starts[a + first] - block.offsets[i])])
                        at = int(ends[a + last - 1] - block.offsets[i])
                    removed.append(int(gone.sum()))
                    kept.append(b"".join([*out, own[at:]]))
                part = batch.slice(block.first, len(kept))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return joined.mapInArrow(run, StructType([*docs.schema.fields]).add("n_removed", "long").add("kept", "string")).toDF(*columns, "n_removed", "kept")
