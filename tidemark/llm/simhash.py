"""SimHash fingerprints and exact near-duplicate groups by vantage-point trees.

A small sample gives the vantage points of an upper tree, whose leaves are the shards. A fingerprint is at home in one shard and visits every
other one that can hold a partner: by the triangle inequality, partners within r of it differ in their distance from a vantage point by r at
most. As every level of the upper tree multiplies the visits, many fingerprints are first dealt to buckets, once for each of r + 1 bands of bits: of r differing
bits, none lies in at least one band, so partners share a bucket. An upper tree then splits only buckets that are larger than a shard.
In each shard a vantage-point tree is split down to small leaves with all queries at once. A shard answers with one link for each
fingerprint to its group's root, not with pairs, so a group of many copies costs no more than its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, lean
from .components import components
from .pieces import LOWER, SPACE
from .session import cut
from .skew import spread_join

WORDS, SEED, RADIUS = 3, 42, 3
SHARD, SAMPLE, LEAF = 1 << 16, 4096, 64
#: What a level of the upper tree multiplies visits by, as measured on fingerprints of texts.
GROWTH = 1.62
#: Bits of a band that name its buckets, at most: four bands then have 262,144 buckets.
BAND_BITS = 16


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, whose hashes stand one after another, the bits that over half of them have; zero without any."""
    total = len(hashes)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        places = np.append((np.cumsum(counts) - counts)[some], total)
        step = 1 << 15
        for low in range(0, len(some), 256):
            high = min(len(some), low + 256)
            a, b = int(places[low]), int(places[high])
            ones = np.zeros((high - low, 64), np.int64)
            for c in range(a, b, step):
                d = min(b, c + step)
                bits = np.unpackbits(hashes[c:d].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                cut_at = np.searchsorted(places[low : high + 1], [c, d - 1], "right") - 1
                edges = np.maximum(places[low + cut_at[0] : low + cut_at[1] + 1], c) - c
                ones[cut_at[0] : cut_at[1] + 1] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
            most = 2 * ones > counts[some[low:high], None]
            out[some[low:high]] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A fingerprint for each of the texts that begin at these offsets."""
    data = LOWER[data]
    space = SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    seen = ~space
    starts = np.flatnonzero(seen & np.append(True, space[:-1] | begins[1:-1])[: len(data)]) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(seen & np.append(space[1:] | begins[1:-1], True)) + 1 if len(data) else np.zeros(0, np.int64)
    count = np.diff(np.searchsorted(starts, offsets))
    sizes = stops - starts
    # the same words with one space after each, so that a shingle is one slice
    placed = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[seen]
    raw = joined.tobytes()
    first = np.cumsum(count) - count
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    total = int(shingles.sum())
    owner = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
    end = at + np.minimum(words, count[owner]) - 1
    left, right = placed[at].tolist(), (placed[end] + sizes[end]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(left, right, strict=True)), np.uint64, total)
    return majorities(hashes, shingles)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long. Null and empty texts have 0."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = block_fingerprints(block.data, block.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(found)), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def upper_tree(sample: np.ndarray, depth: int) -> list:
    """Nested [vantage point, median distance, inner, outer] down to shard numbers."""
    shards = iter(range(1 << 30))

    def grow(points: np.ndarray, left: int):
        if not left or len(points) < 8:
            return next(shards)
        away = np.bitwise_count(points ^ points[0])
        middle = int(np.median(away))
        inner = away <= middle
        if inner.all():
            return next(shards)
        return [int(points[0]), middle, grow(points[inner][::-1], left - 1), grow(points[~inner], left - 1)]

    return [grow(sample, depth), next(shards)]


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places of the points that go there, whether each is at home there)."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, who, home = stack.pop()
        if isinstance(node, int):
            yield node, who, home
            continue
        away = np.bitwise_count(points[who] ^ np.uint64(node[0])).astype(np.int64)
        inner = away <= node[1] + radius
        outer = away > node[1] - radius
        stack.append((node[2], who[inner], home[inner] & (away[inner] <= node[1])))
        stack.append((node[3], who[outer], home[outer] & (away[outer] > node[1])))


class Groups:
    """Union-find over whole arrays of links; the root is the least member."""

    def __init__(self, count: int):
        self.parent = np.arange(count)

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            above = self.parent[up]
            if (above == up).all():
                return up
            up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = self.root(np.arange(len(self.parent)))


def link_within(points: np.ndarray, homes: np.ndarray, radius: int) -> np.ndarray:
    """For each of the points (distinct), the place of its group's root; links are those of at least one home."""
    groups = Groups(len(points))
    stack = [(homes, np.arange(len(points)))]
    while stack:
        tree, asks = stack.pop()
        if not len(tree) or not len(asks):
            continue
        away = np.bitwise_count(points[tree] ^ points[tree[0]]) if len(tree) > LEAF else None
        middle = int(np.median(away)) if away is not None else 0
        if away is None or (away <= middle).all():
            for a in range(0, len(tree), LEAF):
                for b in range(0, len(asks), 1 << 14):
                    some = asks[b : b + (1 << 14)]
                    h, q = np.nonzero(np.bitwise_count(points[tree[a : a + LEAF], None] ^ points[None, some]) <= radius)
                    groups.link(tree[a : a + LEAF][h], some[q]) if len(h) > LEAF or (tree[a : a + LEAF][h] != some[q]).any() else None
            continue
        far = np.bitwise_count(points[asks] ^ points[tree[0]]).astype(np.int64)
        stack.append((tree[away <= middle], asks[far <= middle + radius]))
        stack.append((tree[away > middle], asks[far > middle - radius]))
    return groups.parent


class Dealing:
    """How fingerprints are dealt to shards: bands of bits give buckets (one bucket of all if `bits` is 0), and upper trees split the buckets that `depths` names."""

    def __init__(self, count: int, radius: int = RADIUS, shard: int = SHARD):
        self.radius, self.shard = radius, shard
        depth = self.depth(count)
        width = 64 // (radius + 1)
        # one bit more than buckets of a shard's size need, as they aren't of equal size
        self.bits = 0 if GROWTH**depth <= radius + 1 else min(width, BAND_BITS, depth + 1)
        self.shifts = [np.uint64(band * width + width - self.bits) for band in range(radius + 1)] if self.bits else [np.uint64(0)]
        self.low = np.uint64((1 << self.bits) - 1)
        self.depths = np.zeros(len(self.shifts) << self.bits, np.int64)
        self.sample = np.zeros(0, np.uint64)
        if not self.bits:
            self.depths[0] = depth

    def depth(self, count: int) -> int:
        return max(0, int(np.ceil(np.log2(max(1, count) / self.shard))))

    def buckets(self, points: np.ndarray, band: int) -> np.ndarray:
        return (band << self.bits) + ((points >> self.shifts[band]) & self.low).astype(np.int64)

    def tree(self, bucket: int):
        """The upper tree of a bucket, over the bits that its members don't share; of its own part of the sample, if that isn't too small."""
        band = bucket >> self.bits
        own = self.sample[self.buckets(self.sample, band) == bucket]
        return upper_tree(self.masked(own if len(own) >= LEAF else self.sample, band), int(self.depths[bucket]))[0]

    def masked(self, points: np.ndarray, band: int) -> np.ndarray:
        return points & ~(self.low << self.shifts[band])

    def visits(self, points: np.ndarray, trees: dict) -> Iterator[tuple[int | np.ndarray, int, np.ndarray, np.ndarray]]:
        """(bucket or buckets, shard within it, places of the points that go there, whether each is at home there); trees keeps the trees made."""
        for band in range(len(self.shifts)):
            bucket = self.buckets(points, band)
            whole = np.flatnonzero(self.depths[bucket] == 0)
            if len(whole):
                yield bucket[whole], 0, whole, np.ones(len(whole), bool)
            for large in np.unique(bucket[self.depths[bucket] > 0]).tolist():
                if large not in trees:
                    trees[large] = self.tree(large)
                mine = np.flatnonzero(bucket == large)
                deals = max(1, int(GROWTH ** int(self.depths[large])) // 4)
                for number, who, home in route(trees[large], self.masked(points[mine], band), self.radius):
                    who = mine[who]
                    for deal in range(deals):
                        go = home | (points[who] % np.uint64(deals) == np.uint64(deal))
                        if go.any():
                            yield large, number * deals + deal, who[go], home[go]


def fingerprint_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """From (fp), distinct: links (a, b) by which all fingerprints that a chain of at most `radius` differing bits joins hang together, at most one for each in a shard.

    Shards hold about `shard` fingerprints at home, and visitors of a shard are dealt over several tasks, so that memory stays bounded. The sample
    that gives upper trees holds 4096 fingerprints at most. Of the buckets, of which there are 65,536 for each band at most, the driver
    learns which ones are larger than a shard, and their sizes.
    """
    dealing = Dealing(points.count(), radius, shard)
    if dealing.bits:
        named = [F.expr(f"{band << dealing.bits} + (shiftrightunsigned(fp, {int(shift)}) & {int(dealing.low)})") for band, shift in enumerate(dealing.shifts)]
        sizes = points.select(F.explode(F.array(*named)).alias("bucket")).groupBy("bucket").count().where(F.col("count") > shard)
        for bucket, size in sizes.collect():
            dealing.depths[bucket] = dealing.depth(size)
    if dealing.depths.any():
        sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp")
        dealing.sample = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)

    @lean
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {}
        for batch in batches:
            mine = batch.column(0).to_numpy().view(np.uint64)
            for bucket, number, who, home in dealing.visits(mine, trees):
                cells = [np.broadcast_to(bucket, len(who)), np.full(len(who), number), mine[who].view(np.int64), home]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["bucket", "shard", "fp", "home"])

    def linked(table: pa.Table) -> pa.Table:
        mine, home = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(mine)
        mine, home = mine[order], home[order]
        roots = link_within(mine.view(np.uint64), np.flatnonzero(home), radius)
        on = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": mine[on], "b": mine[roots[on]]})

    return points.select("fp").mapInArrow(visits, "bucket long, shard long, fp long, home boolean").groupBy("bucket", "shard").applyInArrow(linked, "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """From (doc_id, fp): (doc_id, fp, component_id), the least doc_id reachable over links of at most `radius` differing bits.

    Equal fingerprints are one point, however many rows have them. Null ids never name a group with other ids; a group of nothing else has a null.
    Repeated rows stay.
    """
    prints = cut(prints)
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(fingerprint_links(points, radius, shard))
    least = groups.join(points, groups.node == points.fp).groupBy("root").agg(F.min("first").alias("least"))
    named = spread_join(groups, least, "root").select(F.col("node").alias("fp"), "least")
    owners = points.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return spread_join(prints, owners, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
