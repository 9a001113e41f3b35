"""Ranked lexical search: shards of documents with compressed posting blocks that keep their greatest impact, searched by Block-Max WAND.

Terms are runs of ASCII letters, digits and other characters from U+0080 on, with A-Z lower-cased. Statistics (N, L, df) are of all documents. A shard
is a run of documents of one task, so postings are never shuffled to be built; only queries' terms are indexed, a bounded block of queries at a time.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import stored

#: Postings of a block, documents and bytes of text of a shard, and bytes of the terms that are searched together.
BLOCK, SHARD_DOCS, SHARD_BYTES, VOCABULARY_BYTES = 128, 1 << 14, 1 << 26, 1 << 24
#: Runs of documents scored first, those with the highest bounds, so that the threshold isn't zero when the others are passed in order.
SEEDS = 16
#: Fixed value: the form of a term.
FORM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "shard string, term string, block int, first int, last int, n int, most long, payload binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in their order. All bytes of a character from U+0080 on are above 127, so runs of bytes are runs of characters."""
    return (text or "").encode().translate(_LETTERS).split()


def pack(values: np.ndarray) -> bytes:
    """The width in bits of the greatest value, then all values in that many bits each."""
    width = int(values.max()).bit_length() if len(values) else 0
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8)).tobytes()


def unpack(raw: bytes, count: int) -> tuple[np.ndarray, int]:
    """(count values, the bytes that they took)."""
    width, size = raw[0], -(-count * raw[0] // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, 1), count=count * width).reshape(count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)), 1 + size


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def decode(payload: bytes, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, frequencies) of a block's postings."""
    gaps, used = unpack(payload, count - 1)
    return first + np.concatenate([[0], np.cumsum(gaps)]), unpack(payload[used:], count)[0] + 1


def _shard(name: str, names: list[bytes], ids: array, sizes: array, found: array, counts: array, total: tuple[int, int]) -> pa.RecordBatch:
    """A shard's rows. Its documents stand in order of their ids, so places compare as ids do; the row without a term has the ids and lengths."""
    doc_ids, lengths = np.array(ids, np.int64), np.array(sizes, np.int64)
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys = np.array(found, np.int64) << 32 | np.repeat(place, np.array(counts, np.int64))
    keys, tf = np.unique(keys, return_counts=True)
    term, at = keys >> 32, keys & 0xFFFFFFFF
    lengths = lengths[order]
    m = 100 - 50 + 50 * lengths * total[0] // max(1, total[1])
    impacts = impact(tf, m[at])
    new = np.flatnonzero(np.diff(term, prepend=-1))
    begin = np.repeat(new, np.diff(np.append(new, len(term))))
    starts = np.flatnonzero((np.arange(len(term)) - begin) % BLOCK == 0)
    ends = np.append(starts, len(term))[1:]
    most = np.maximum.reduceat(impacts, starts) if len(starts) else np.zeros(0, np.int64)
    payloads = [pack(np.diff(at[a:b])) + pack(tf[a:b] - 1) for a, b in zip(starts, ends, strict=True)]
    rows = [
        [name] * (len(starts) + 1),
        [None, *(names[t].decode() for t in term[starts])],
        [0, *((starts - begin[starts]) // BLOCK)],
        [0, *at[starts]],
        [len(order) - 1, *at[ends - 1]],
        [len(order), *(ends - starts)],
        [0, *most],
        [doc_ids[order].tobytes() + lengths.tobytes(), *payloads],
    ]
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(N, L): the documents that have a term, and all their terms with repeats."""
    n = docs.select(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(FORM)).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row.docs, row.terms


def build_index(docs: DataFrame, vocabulary: list[bytes], total: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Posting blocks of the vocabulary's terms, as rows of INDEX.

    Every task makes shards of its documents, at most SHARD_DOCS and (but for a single longer text) SHARD_BYTES each. A block's most is the greatest
    impact of its postings, before the term's weight. Rows that repeat are documents each; null and empty texts have no terms; rows with a null key count
    in blocks' numbers under the least id there is, which a search never gives out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most VOCABULARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        number = {t: i for i, t in enumerate(names)}.get
        made, size = 0, 0
        held = [array("q"), array("q"), array("q"), array("q")]
        task = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text_ in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                words = terms_of(text_)
                hits = [i for i in map(number, words) if i is not None]
                for column, value in zip(held, (-(1 << 63) if doc_id is None else doc_id, len(words), hits, len(hits)), strict=True):
                    column.extend(value) if isinstance(value, list) else column.append(value)
                size += len(text_ or "")
                if len(held[0]) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield _shard(f"{task}-{made}", names, *held, total)
                    made, size, held = made + 1, 0, [array("q"), array("q"), array("q"), array("q")]
        if held[0]:
            yield _shard(f"{task}-{made}", names, *held, total)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, INDEX)


class Shard:
    """A shard's blocks by term, each decoded once and only when a run of documents that it touches can reach the threshold."""

    def __init__(self, frame: pd.DataFrame) -> None:
        own = frame[frame.term.isna()].iloc[0]
        self.size = int(own.n)
        self.ids, self.lengths = (np.frombuffer(own.payload, np.int64, self.size, k * 8 * self.size) for k in (0, 1))
        rows = frame[frame.term.notna()].sort_values(["term", "block"])
        self.first, self.last, self.n, self.most = (rows[c].to_numpy(np.int64) for c in ("first", "last", "n", "most"))
        self.payload = rows.payload.to_numpy()
        terms = rows.term.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
        self.of = {terms[a]: (a, b) for a, b in zip(new, np.append(new, len(terms))[1:], strict=True)}
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, block: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if block not in self.decoded:
            at, tf = decode(self.payload[block], self.first[block], self.n[block])
            self.decoded[block] = at.astype(np.int32), impact(tf, m[at]).astype(np.int32)
        return self.decoded[block]


def search_shard(shard: Shard, m: np.ndarray, query: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents with a score above 0, equal scores by place. query has (term, weight) pairs.

    The ends of all blocks of the query's terms cut the shard into runs of documents; in a run every term stays in one block, so the sum of these blocks'
    maxima bounds its scores, found by moving over blocks' ends without decoding (the shallow move). A run below the k-th score so far is passed over; the
    pivot run that isn't has the blocks that touch it decoded and its documents scored.
    """
    spans = [(shard.of[t], w) for t, w in query if t in shard.of]
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = np.concatenate([np.arange(a, b) for (a, b), _ in spans])
    weight = np.concatenate([np.full(b - a, w, np.int64) for (a, b), w in spans])
    edges = np.unique(np.concatenate([shard.first[blocks], shard.last[blocks] + 1]))
    start, stop = np.searchsorted(edges, shard.first[blocks]), np.searchsorted(edges, shard.last[blocks] + 1)
    steps = np.zeros(len(edges), np.int64)
    np.add.at(steps, start, shard.most[blocks] * weight)
    np.subtract.at(steps, stop, shard.most[blocks] * weight)
    bound = np.cumsum(steps)[:-1]
    seeds = np.argsort(-bound, kind="stable")[:SEEDS]
    left = np.ones(len(bound), bool)
    left[seeds] = False
    rest = np.flatnonzero(left)
    score = np.zeros(shard.size, np.int64)
    best_at, best, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    turn, wide = seeds, SEEDS
    while len(turn):
        live = np.zeros(len(bound), bool)
        live[turn[bound[turn] >= threshold]] = True
        if live.any():
            upto = np.concatenate([[0], np.cumsum(live)])
            touched = np.flatnonzero(upto[stop] > upto[start])
            found = [shard.postings(b, m) for b in blocks[touched]]
            at = np.concatenate([f[0] for f in found]).astype(np.int64)
            value = np.concatenate([f[1] * w for f, w in zip(found, weight[touched], strict=True)])
            inside = live[np.searchsorted(edges, at, "right") - 1]
            at, value = at[inside], value[inside]
            np.add.at(score, at, value)
            at = np.unique(at)
            at = at[score[at] >= threshold]
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, score[at]])
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
            threshold = int(best[-1]) if len(best) == k else 1
        turn, rest, wide = rest[:wide], rest[wide:], 2 * wide
    return best_at, best


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, term) of every distinct term of an item; of items with one key (a null one too) the terms of all their texts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower), F.lit(FORM), F.lit(0))
    return items.select(F.col(key).alias("item_id"), F.explode(F.array_distinct(terms)).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0, equal scores by doc_id.

    Items are searched in blocks, dealt by a hash so that the terms of one take VOCABULARY_BYTES or less, and an item that has more is a block by itself;
    each block's terms, a list on the driver, are indexed and searched over all shards. Documents without an id count in N, L and df and aren't given out.
    Repeated rows are documents each. An empty table, an item without a term or without a document gives no rows.
    """
    spark = docs.sparkSession
    total = statistics(docs, text)
    asked = stored(query_terms(items).withColumn("bytes", F.octet_length("term") + 8))
    parts = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // (VOCABULARY_BYTES // 2)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    out = None
    for part in range(parts if total[0] else 0):
        found = _search_block(spark, docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), asked.where(F.col("part") == part), total, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(spark: SparkSession, docs: DataFrame, asked: DataFrame, total: tuple[int, int], k: int) -> DataFrame:
    rows = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    vocabulary = sorted({t.encode() for r in rows for t in r.terms})
    index = stored(build_index(docs, vocabulary, total))
    df = {r.term: r.df for r in index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weigh = lambda t: math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df[t] + 1)))
    weights = {t: weigh(t) for t in df}
    shared = spark.sparkContext.broadcast([[(t, weights[t]) for t in r.terms if t in weights] for r in rows])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(frame)
        m = 100 - 50 + 50 * shard.lengths * total[0] // total[1]
        out = []
        for number, query in enumerate(shared.value):
            at, score = search_shard(shard, m, query, k + int((shard.ids == -(1 << 63)).sum()))
            out.append(pd.DataFrame({"query": number, "doc_id": shard.ids[at], "score": score}))
        return pd.concat(out)[["query", "doc_id", "score"]]

    hits = index.groupBy("shard").applyInPandas(run, "query int, doc_id long, score long").where(F.col("doc_id") > -(1 << 63))
    names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], "query int, item_id long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # the block's items
