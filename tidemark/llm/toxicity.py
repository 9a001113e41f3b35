"""Toxicity scores by a small convolutional network over hashed word embeddings.

A word's embedding is the sum of those of its hash and of the hashes of its first few bytes, so forms of one stem share what is learnt. Filters
of several widths run over the words of the whole text; each filter's largest value goes into a linear output. It is trained in numpy by
Adam, with exact gradients through the maxima. Scores are calibrated on rows that training hasn't seen, and a threshold is then chosen for each language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import Block, blocks, lean, prefix_sums, span_hashes
from .pieces import LETTER, LOWER
from .sampling import PER_CLASS, labelled, learnable, platt, sigmoid
from .session import neutral

BITS, DIM, WIDTHS, FILTERS, STEMS = 17, 8, (1, 2, 3), 8, (4, 5, 6)
THRESHOLD = 0.7
#: Thresholds that are tried for each language.
CUTS = np.linspace(0.05, 0.95, 91)
#: A feature seen in fewer sampled texts than this keeps a zero embedding.
LEAST_TEXTS = 3
INSIDE = LETTER.copy()
INSIDE[0x80:] = True


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(features of each word, one column for the word and each stem length; offsets of each text's words). Words shorter than a stem repeat the word."""
    data = LOWER[block.data]
    inside = INSIDE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[block.offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1] & ~begins[1:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & ~begins[1:-1]
    ends = np.flatnonzero(inside & ~after) + 1
    sums, drop = prefix_sums(data), np.uint64(64 - BITS)
    columns = [span_hashes(sums, starts, ends)]
    columns += [span_hashes(sums, starts, np.minimum(ends, starts + size)) + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)) for size in STEMS]
    return np.stack([(c >> drop).astype(np.int32) for c in columns], axis=1), np.searchsorted(starts, block.offsets)


@dataclass
class Network:
    table: np.ndarray
    kernels: list[np.ndarray]  # one for each width: (width * DIM, FILTERS)
    biases: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, features: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest value of each filter for each text, 0 at least; the word at which it begins, -1 if none). Past a text's end words are zero."""
        texts, words = len(offsets) - 1, len(features)
        best = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64)
        if not words:
            return best, where
        vectors = np.zeros((words + max(WIDTHS), DIM), np.float32)
        for column in features.T:
            vectors[:words] += self.table[column]
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(words)  # words to the end of the text, this one too
        full = np.flatnonzero(np.diff(offsets))
        for k, width in enumerate(WIDTHS):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            values = np.broadcast_to(self.biases[mine], (words, FILTERS)).copy()
            for step in range(width):
                part = vectors[step : step + words] @ self.kernels[k][step * DIM : (step + 1) * DIM]
                if step:
                    part[left <= step] = 0
                values += part
            top = np.maximum.reduceat(values, offsets[:-1][full], axis=0)
            best[full, mine] = np.maximum(top, 0)
            if self.learning:
                for row, (a, b) in zip(full.tolist(), zip(offsets[full].tolist(), offsets[full + 1].tolist(), strict=True), strict=True):
                    at = values[a:b].argmax(axis=0)
                    where[row, mine] = np.where(values[a + at, np.arange(FILTERS)] > 0, a + at, -1)
        return best, where

    learning = False

    def margins(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.pooled(features, offsets)[0] @ self.out + self.bias

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(features, offsets).astype(np.float64) + self.shift)


class Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad**2
        self.value[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[np.ndarray], y: np.ndarray, rounds: int = 6, batch: int = 64, seed: int = 3) -> Network:
    """texts: the features of each one's words. Embeddings start from smoothed class log ratios of their features; classes weigh evenly."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((2, 1 << BITS))
    for words, label in zip(texts, y.tolist(), strict=True):
        counts[label, np.unique(words)] += 1
    share = (counts + 1) / (np.bincount(y, minlength=2)[:, None] + 2)
    known = counts.sum(axis=0) >= min(LEAST_TEXTS, max(1, len(y) // 50))
    table = np.zeros((1 << BITS, DIM), np.float32)
    table[known, 0] = (np.log(share[1] / share[0]) / 4)[known]
    table[known, 1:] = rng.normal(0, 0.05, (int(known.sum()), DIM - 1))
    kernels = [rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[0::DIM] += 0.5
    net = Network(table, kernels, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    net.learning = True
    weight = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))[y]
    bias = np.array([net.bias], np.float32)
    learn = {"table": Adam(net.table, 0.01), "biases": Adam(net.biases, 0.02), "out": Adam(net.out, 0.02), "bias": Adam(bias, 0.02)}
    learn |= {k: Adam(kernel, 0.02) for k, kernel in enumerate(kernels)}
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            rows = order[low : low + batch]
            features = np.concatenate([texts[i] for i in rows])
            offsets = np.append(0, np.cumsum([len(texts[i]) for i in rows]))
            best, where = net.pooled(features, offsets)
            grad = (sigmoid(best @ net.out + net.bias) - y[rows]) * weight[rows] / len(rows)
            down = grad[:, None] * net.out[None, :]
            learn["out"].step(best.T @ grad + 1e-4 * net.out)
            learn["bias"].step(np.array([grad.sum()]))
            live = where >= 0
            learn["biases"].step((down * live).sum(axis=0))
            ends = np.broadcast_to(offsets[1:, None], where.shape)
            places, slopes = [], []
            for k in range(len(WIDTHS)):
                change = np.zeros_like(kernels[k])
                for step in range(WIDTHS[k]):
                    mine = slice(k * FILTERS, (k + 1) * FILTERS)
                    r, f = np.nonzero(live[:, mine] & (where[:, mine] + step < ends[:, mine]))
                    at, d = where[r, f + k * FILTERS] + step, down[r, f + k * FILTERS]
                    vectors = net.table[features[at]].sum(axis=1)
                    np.add.at(change[step * DIM : (step + 1) * DIM].T, f, d[:, None] * vectors)
                    places.append(features[at].ravel())
                    slopes.append(np.repeat(d[:, None] * kernels[k][step * DIM : (step + 1) * DIM].T[f], features.shape[1], axis=0))
                learn[k].step(change + 1e-4 * kernels[k])
            where_to, grads = np.concatenate(places), np.concatenate(slopes)
            seen = known[where_to]
            which, inverse = np.unique(where_to[seen], return_inverse=True)
            total = np.zeros((len(which), DIM), np.float32)
            np.add.at(total, inverse, grads[seen])
            learn["table"].step(total, which)
            net.bias = float(bias[0])
    net.learning = False
    return net


def best_threshold(counts: np.ndarray, weights: np.ndarray | tuple = (1.0, 1.0)) -> float:
    """The middle of the widest range of thresholds with the best F1, or THRESHOLD if it is in such a range or there are few rows.

    counts: for each label the rows by how many of CUTS their score reaches; weights: what a row of each label stands for.
    """
    if counts.sum() < 40 or (counts.sum(axis=1) == 0).any():
        return THRESHOLD
    mass = counts * np.asarray(weights, float)[:, None]
    hit = mass.sum(axis=1, keepdims=True) - np.cumsum(mass, axis=1)[:, :-1]
    f1 = 2 * hit[1] / np.maximum(1e-9, hit.sum(axis=0) + mass[1].sum())
    good = f1 >= f1.max() - 1e-12
    if good[np.abs(CUTS - THRESHOLD).argmin()]:
        return THRESHOLD
    edges = np.flatnonzero(np.diff(np.concatenate(([0], good, [0]))))
    a, b = max(zip(edges[::2], edges[1::2], strict=True), key=lambda r: r[1] - r[0])
    return float((CUTS[a] + CUTS[b - 1]) / 2)


def score_counts(docs: DataFrame, labels: DataFrame, label: str, net: Network, trained: DataFrame) -> DataFrame:
    """(lang, y, seen, reached, n): the rows of all learnable labels, sampled or not, by how many of CUTS their score reaches; seen are those trained on."""
    spoken = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", spoken.alias("lang"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for block in blocks(batch.column(2)):
                part = batch.slice(block.first, block.last - block.first)
                reached = np.searchsorted(CUTS, fitted.scores(*block_words(block)), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(reached)], ["doc_id", "lang", "reached"])

    # scores are joined to labels, not texts, so that no text is shuffled
    scored = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, reached int").join(learnable(labels, label), "doc_id")
    seen = F.broadcast(trained.select("doc_id", F.lit(True).alias("seen")))
    return scored.join(seen, "doc_id", "left").groupBy("lang", "y", F.coalesce("seen", F.lit(False)).alias("seen"), "reached").agg(F.count("*").alias("n"))


def language_thresholds(counts: list) -> dict[str, float]:
    """From rows of score_counts, the threshold of each language: by rows not trained on, each label with the weight that all its rows in the language have."""
    totals: dict[str, np.ndarray] = {}
    for r in counts:
        totals.setdefault(r.lang, np.zeros((2, 2, len(CUTS) + 1)))[int(r.seen), r.y, r.reached] += r.n
    return {lang: best_threshold(c[0], c.sum(axis=(0, 2)) / np.maximum(1, c[0].sum(axis=1))) for lang, c in sorted(totals.items())}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """The network learnt in one task from a bounded sample (see sampling.labelled). Without labelled rows of both classes every score is 0.5.

    The thresholds are then chosen from counts of the scores of all learnable rows that it wasn't trained on.
    """

    @lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                features, offsets = block_words(block)
                part = batch.slice(block.first, block.last - block.first)
                raw = [features[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "y", "words"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = table.column("y").to_numpy().astype(np.int64)
        texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(STEMS)) for x in table.column("words")]
        part = np.arange(len(y)) % 4
        if len(y) == 0 or y.min() == y.max():
            net = Network(np.zeros((1 << BITS, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32))
            return pa.table({"network": [pickle.dumps(net)], "trained": pa.array([[]], pa.list_(table.column("doc_id").type))})
        seen = np.flatnonzero(part > 0) if len(np.unique(y[part > 0])) == 2 else np.arange(len(y))
        rest = np.flatnonzero(part == 0) if len(np.unique(y[part == 0])) == 2 else np.arange(len(y))
        net = train([texts[i] for i in seen], y[seen])
        margins = np.concatenate([net.margins(texts[i], np.array([0, len(texts[i])])) for i in rest]).astype(np.float64)
        net.slope, net.shift = platt(margins, y[rest], (len(rest) / (2 * np.bincount(y[rest], minlength=2)))[y[rest]])
        # if no row is left over, the threshold too is chosen by rows that were trained on
        trained = table.column("doc_id").take(pa.array(np.setdiff1d(seen, rest))).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(trained)], pa.int32()), trained)
        return pa.table({"network": [pickle.dumps(net)], "trained": lists})

    sample = labelled(docs, labels, label, per_class=per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    sample = sample.mapInArrow(words, f"doc_id {kind}, y int, words binary")
    row = sample.groupBy().applyInArrow(learn, f"network binary, trained array<{kind}>").first()
    if row is None:
        return Network(np.zeros((1 << BITS, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32))
    net = pickle.loads(row.network)
    # at most two classes' samples of ids
    trained = docs.sparkSession.createDataFrame([(x,) for x in row.trained], f"doc_id {kind}")
    net.thresholds = language_thresholds(score_counts(docs, labels, label, net, trained).collect())
    return net


def score_documents(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of docs with score (0 to 1, higher the likelier label 1) and is_toxic: whether it reaches the threshold of the row's language.

    The score is of the text alone. Null and empty texts get the score of no words; a null or unknown language has THRESHOLD. Columns named like
    added ones are replaced, repeated rows stay.
    """
    named = [c for c in docs.columns if c not in ("score", "is_toxic")]
    docs = neutral(docs.select(*(F.col(f"`{c}`") for c in named)), text, lang)
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for block in blocks(batch.column(kept.index(text))):
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fitted.scores(*block_words(block)))], [*kept, "score"])

    schema = StructType([*docs.schema.fields]).add("score", "double")
    limits = F.create_map(*(F.lit(x) for pair in net.thresholds.items() for x in pair)) if net.thresholds and lang in kept else None
    limit = F.coalesce(limits[F.col(lang)], F.lit(THRESHOLD)) if limits is not None else F.lit(THRESHOLD)
    return docs.mapInArrow(run, schema).withColumn("is_toxic", F.col("score") >= limit).toDF(*named, "score", "is_toxic")
