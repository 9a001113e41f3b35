"""Quality scores by naive-Bayes support vectors.

A text is the set of its hashed n-grams of words and runs of marks. Each indicator is scaled by the logarithm of the ratio of its smoothed
frequencies in the two classes; on these a linear hinge-loss model is fitted by dual coordinate descent. Margins become scores by a
sigmoid fitted to rows that the weights haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, lean, mixed, prefix_sums, span_hashes
from .pieces import visible_pieces
from .sampling import PER_CLASS, class_sizes, labelled, natural_weights, platt, sigmoid

BITS = 18


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def block_features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams, n being 1 and 2, and of their repetitions, of every text of the block."""
    starts, ends = visible_pieces(block)
    hashes = span_hashes(prefix_sums(block.data), starts, ends)
    row = np.searchsorted(block.offsets, starts, "right") - 1
    pair = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    same = row[:-1] == row[1:]
    drop = np.uint64(64 - bits)
    keys = [row << bits | (hashes >> drop).astype(np.int64), (row[:-1] << bits | (pair >> drop).astype(np.int64))[same]]
    for apart in (1, 2):  # an n-gram's form: that it comes again at once, or after one other
        again = (hashes[:-apart] == hashes[apart:]) & (row[:-apart] == row[apart:])
        keys.append(row[:-apart][again] << bits | apart)
    keys = np.concatenate(keys)
    keys = pd.unique(keys)
    return keys >> bits, keys & ((1 << bits) - 1)


def ratios(features: list[np.ndarray], y: np.ndarray, bits: int = BITS, smooth: float = 1.0) -> np.ndarray:
    """For each feature the logarithm of its share of class 1 over its share of class 0."""
    counts = np.full((2, 1 << bits), smooth)
    for f, label in zip(features, y, strict=True):
        counts[label, f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def hinge_fit(features: list[np.ndarray], scale: np.ndarray, y: np.ndarray, worth: np.ndarray, cost: float = 0.3, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (of plain indicators) and bias that minimise half the squared norm plus cost times the hinge losses, each by its worth.

    Dual coordinate descent: one multiplier at a time is moved to its best value between 0 and its bound, the weights kept in step.
    """
    w, bias, sign = np.zeros(len(scale)), 0.0, np.where(y == 1, 1.0, -1.0)
    bounds = cost * np.maximum(worth, 1e-6)
    values = [scale[f] / max(1e-9, np.sqrt((scale[f] ** 2).sum())) if len(f) else scale[f] for f in features]
    square = np.array([(v**2).sum() + 1 for v in values])
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            f, v = features[i], values[i]
            slope = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bounds[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[f] += step * sign[i] * v
                bias += step * sign[i]
                moved = max(moved, abs(step) / bounds[i])
        if moved < 1e-3:
            break
    return w * scale, bias


def margins(weights: np.ndarray, bias: float, sums: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return sums / np.maximum(norms, 1e-9) + bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, bits: int = BITS) -> tuple[Model, np.ndarray]:
    """The model, and the scale of each feature, learnt from a bounded sample (see sampling.labelled) in one task.

    Without labelled rows of both classes every score is 0.5.
    """

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                row, found = block_features(block, bits)
                order = np.argsort(row, kind="stable")
                count = block.last - block.first
                places = np.searchsorted(row[order], np.arange(count + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(found[order].astype(np.int32)))
                part = batch.slice(block.first, count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), lists], ["doc_id", "y", "features"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = table.column("y").to_numpy().astype(np.int64)
        lists = [x.values.to_numpy() for x in table.column("features")]
        weights, scale, bias, slope, shift = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0, 0.0
        if len(y) and y.min() != y.max():
            part = np.arange(len(y)) % 5
            seen = np.flatnonzero(part > 0) if len(np.unique(y[part > 0])) == 2 else np.arange(len(y))
            trial = ratios([lists[i] for i in seen], y[seen], bits)
            worth = natural_weights(y, sizes)
            w, b = hinge_fit([lists[i] for i in seen], trial, y[seen], worth[seen])
            rest = np.flatnonzero(part == 0)
            rest = rest if len(np.unique(y[rest])) == 2 else np.arange(len(y))
            out = np.array([w[lists[i]].sum() / max(1e-9, np.sqrt((trial[lists[i]] ** 2).sum())) + b for i in rest])
            slope, shift = platt(out, y[rest], worth[rest])
            scale = ratios(lists, y, bits)
            weights, bias = hinge_fit(lists, scale, y, worth)
        return pa.table({"weights": [weights.astype("<f4").tobytes()], "scale": [scale.astype("<f4").tobytes()], "bias": [bias], "slope": [slope], "shift": [shift]})

    sizes = class_sizes(labels, label)
    sample = labelled(docs, labels, label, per_class=per_class)
    sample = sample.mapInArrow(features, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, features array<int>")
    row = sample.groupBy().applyInArrow(learn, "weights binary, scale binary, bias double, slope double, shift double").first()
    if row is None:
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, 0.0), np.zeros(1 << bits, np.float32)
    return Model(np.frombuffer(row.weights, "<f4"), row.bias, row.slope, row.shift), np.frombuffer(row.scale, "<f4")


def score_documents(docs: DataFrame, model: Model, scale: np.ndarray, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score): between 0 and 1, higher the likelier label 1. Null and empty texts get the score of no features. Repeated rows stay."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model, scale))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, scales = shared.value
        squares = scales.astype(np.float64) ** 2
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, found = block_features(block, bits)
                count = block.last - block.first
                sums = np.bincount(row, fitted.weights[found], count)
                norms = np.sqrt(np.bincount(row, squares[found], count))
                out = sigmoid(fitted.slope * margins(fitted.weights, fitted.bias, sums, norms) + fitted.shift)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, count), pa.array(out)], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
