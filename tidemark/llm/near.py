"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a limit, joined into groups.

Candidates are what the vantage-point trees link by SimHash fingerprints of the same shingles, and, as most pairs of similarity 0.8 differ in more bits
than trees can search, bands of least hash values: at similarity 0.8 the 32 bands of 5 values miss a pair with probability 3 in a million, more alike pairs
less often. Each pair that counts is confirmed by the exact similarity of the two sets. Texts with one set of shingles are one point. In each
bucket of a band, every point is first held against one member, so that a group of many copies costs no more than its size; then only
points of still different groups are, unless a sketch of their hash values rules them out. A bucket of many such points is dealt in
blocks, and each two blocks meet in a task of their own, so that no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, lean, mixed, prefix_sums, ragged, span_hashes
from .components import components
from .pieces import LOWER, SPACE
from .session import cut, stored
from .simhash import fingerprint_links, majorities
from .skew import spread_join

WORDS, LIMIT = 5, 0.8
BANDS, VALUES = 32, 5
#: Pairs of whose 160 least values a smaller share agree are not looked at: six standard errors (0.032 at similarity 0.8) below LIMIT.
SKETCH_LIMIT = 0.6
#: Points of one bucket's blocks.
DEALT = 512
FACTORS = mixed(np.arange(1, BANDS * VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def block_shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles, offsets of each text's ones). White space and case don't count; a text of fewer words is one shingle, one of none has none."""
    data = LOWER[block.data]
    size = len(data)
    seen = ~SPACE[data]
    begins = np.zeros(size + 1, bool)
    begins[block.offsets] = True
    starts = np.flatnonzero(seen & (begins[:-1] | ~np.append(False, seen)[:-1]))
    stops = np.flatnonzero(seen & (begins[1:] | ~np.append(seen, False)[1:])) + 1
    count = np.diff(np.searchsorted(starts, block.offsets))
    sizes = stops - starts
    placed = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    joined[ragged(placed, sizes)] = data[seen]
    first = np.cumsum(count) - count
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    offsets = np.append(0, np.cumsum(shingles))
    at = ragged(first, shingles)
    end = at + np.repeat(np.minimum(words, count), shingles) - 1
    return span_hashes(prefix_sums(joined), placed[at], placed[end] + sizes[end]), offsets


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BANDS * VALUES least values for each text, zeros for one without shingles."""
    out = np.zeros((len(offsets) - 1, BANDS * VALUES), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for k, factor in enumerate(FACTORS):
            out[some, k] = np.minimum.reduceat(hashes * factor, offsets[some])
    return out


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def near_points(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): (doc_id, k, point, keys, sketch, fp); k is a hash of the text, point one of its set, keys are its buckets, fp is its fingerprint."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                hashes, offsets = block_shingles(block)
                least = sketches(hashes, offsets)
                keys = least[:, 0::VALUES].copy()
                for step in range(1, VALUES):
                    keys = mixed(keys + least[:, step::VALUES])
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
                points = np.array([xxhash.xxh3_64_intdigest(s) for s in shingle_sets(hashes, offsets)], np.uint64)
                short = np.ascontiguousarray((mixed(least) >> np.uint64(56)).astype(np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                part = batch.slice(block.first, len(points))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(points.view(np.int64)), lists, pa.array([r.tobytes() for r in short], pa.binary()), pa.array(majorities(hashes, np.diff(offsets)).view(np.int64))], ["doc_id", "k", "point", "keys", "sketch", "fp"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, point long, keys array<long>, sketch binary, fp long")


def is_near(common, both, limit: float):
    """Whether common / (both - common) >= limit, without rounding; limit counts in thousandths."""
    return 1000 * common >= round(1000 * limit) * (both - common)


def point_sets(asked: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """(point, shingles) of the points asked for."""
    who = points.groupBy("point").agg(F.min(F.struct("doc_id", "k")).alias("at")).join(asked.distinct(), "point").select("point", "at.*")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).join(who, ["doc_id", "k"]).select("point", "text")

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = shingle_sets(*block_shingles(block))
                places = np.append(0, np.cumsum([len(x) // 8 for x in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(found), np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(found)), lists], ["point", "shingles"])

    # repeated rows of one document give the same set
    return stored(texts.mapInArrow(sets, "point long, shingles array<long>").dropDuplicates(["point"]))


def confirmed(pairs: DataFrame, points: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) of points whose sets have a similarity of at least `limit`."""
    held = point_sets(pairs.select(F.col("a").alias("point")).unionByName(pairs.select(F.col("b").alias("point"))), points, docs)
    both = pairs.join(held.select(F.col("point").alias("a"), F.col("shingles").alias("s")), "a").join(held.select(F.col("point").alias("b"), F.col("shingles").alias("t")), "b")

    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("common"), (F.size("s") + F.size("t")).alias("both"))
    return common.where(is_near(F.col("common"), F.col("both"), limit)).select("a", "b")


def bucket_links(table: pa.Table, limit: float) -> pa.Table:
    """Links (a, b) that join the groups of one or two blocks of a bucket that have a confirmed pair; its leader has been held against all others before.

    Of two blocks, only pairs across them are looked at.
    """
    block = table.column("block").to_numpy()
    across = len(np.unique(block)) > 1
    mine, tried = table.column("point").to_numpy(), table.column("leads").to_numpy(zero_copy_only=False)
    root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
    marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(mine), -1)
    lists = table.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    codes, values = pd.factorize(lists.flatten().to_numpy())
    first = np.cumsum(sizes) - sizes
    own = np.zeros(len(values), bool)
    a, b = [], []
    for k in range(len(mine) - 1):
        if tried[k]:
            continue
        others = k + 1 + np.flatnonzero((root[k + 1 :] != root[k]) & ~tried[k + 1 :] & (~across | (block[k + 1 :] != block[k])))
        for low in range(0, len(others), 1024):
            some = others[low : low + 1024]
            some = some[(marks[some] == marks[k]).mean(axis=1) >= SKETCH_LIMIT]
            some = some[np.minimum(sizes[some], sizes[k]) >= (limit - 1e-9) * np.maximum(sizes[some], sizes[k])]
            if not len(some):
                continue
            own[codes[first[k] : first[k] + sizes[k]]] = True
            ends = np.cumsum(sizes[some])
            common = np.add.reduceat(own[codes[ragged(first[some], sizes[some])]], ends - sizes[some], dtype=np.int64)
            own[codes[first[k] : first[k] + sizes[k]]] = False
            for other in some[is_near(common, sizes[some] + sizes[k], limit)].tolist():
                if root[other] != root[k]:
                    a.append(min(mine[k], mine[other]))
                    b.append(max(mine[k], mine[other]))
                    root[root == root[other]] = root[k]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_groups(docs: DataFrame, limit: float = LIMIT, dealt: int = DEALT) -> DataFrame:
    """From (doc_id, text): (doc_id, k, group), k being xxhash64 of the text; two rows have one group if a chain of near copies leads from one to the other.

    Rows without words (null and empty texts too) are copies of each other. Repeated rows stay.
    """
    docs = docs.select("doc_id", "text")
    points = stored(near_points(docs))
    slots = points.select("point", F.explode("keys").alias("key")).withColumn("h", F.xxhash64("point", "key"))
    # a bucket's first member is another one in each band, so that members of a large group meet several
    shared = slots.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key", "low")
    members = stored(slots.join(shared, "key").select("key", "point", (F.col("h") == F.col("low")).alias("leads")).distinct())
    leads = members.where("leads").select("key", F.col("point").alias("lead"))
    pair = [F.least("point", "lead").alias("a"), F.greatest("point", "lead").alias("b")]
    prints = points.groupBy("fp").agg(F.min("point").alias("first"))
    ends = fingerprint_links(prints).join(prints.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("two")), "b")
    equal = points.select("fp", "point").distinct().join(prints, "fp").where("point <> first").select(F.col("first").alias("one"), F.col("point").alias("two"))
    close = ends.select("one", "two").unionByName(equal).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    pairs = cut(members.where("NOT leads").join(leads, "key").select(*pair).unionByName(close).distinct())
    links = cut(confirmed(pairs, points, docs, limit))
    groups = components(links)

    named = members.join(groups.withColumnRenamed("node", "point"), "point", "left").select("key", "point", F.coalesce("root", "point").alias("root"), "leads")
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high AND n > 2").select("key", F.expr(f"(n + {dealt} - 1) div {dealt}").alias("blocks"))
    open_ = cut(named.join(apart, "key").select("key", "point", "root", "leads", "blocks"))
    if not open_.isEmpty():
        asked = open_.select("point").distinct()
        least = points.select("point", "sketch").join(asked, "point", "left_semi").dropDuplicates(["point"])
        block = open_.withColumn("block", F.expr("pmod(xxhash64(point, 5), blocks)"))
        met = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        full = met.join(least, "point").join(point_sets(asked, points, docs), "point").select("key", "low", "high", "block", "point", "root", "leads", "sketch", "shingles")
        late = cut(full.groupBy("key", "low", "high").applyInArrow(lambda table: bucket_links(table, limit), "a long, b long").distinct())
        groups = components(links.unionByName(late)) if not late.isEmpty() else groups
    owners = groups.select(F.col("node").alias("point"), "root")
    return spread_join(points.select("doc_id", "k", "point"), owners, "point", "left").select("doc_id", "k", F.coalesce("root", "point").alias("group"))
