"""A bounded sample of labelled documents, and what both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most so many labelled rows of each class are learnt from, and so many bytes of their texts together; no text of more bytes than the last is.
PER_CLASS, CLASS_BYTES, LONGEST = 6000, 16 << 20, 1 << 17


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: those whose crc32 of the id, as text, leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learnable(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")


def class_sizes(labels: DataFrame, label: str, key: str = "doc_id") -> np.ndarray:
    """How many rows of each class there are to learn from, sampled or not."""
    found = {r.y: r.n for r in learnable(labels, label, key).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return np.array([found.get(0, 0), found.get(1, 0)], float)


def natural_weights(y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weights, one on average, by which the sample has the classes' true shares."""
    each = sizes / np.maximum(1, np.bincount(y, minlength=2))
    return (each / max(1e-9, each[y].mean()))[y] if len(y) else np.zeros(0)


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, y, lang, text) of a sample: of each class the per_class rows whose ids hash lowest, so the same rows every time, as far as CLASS_BYTES go.

    Rows with a null label, a label other than 0 and 1, or a null id are left out, and so are those held out. An id labelled twice with
    different labels is left out; repeated rows of one label count once.
    """
    known = learnable(labels, label, key)
    rank = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = [known.where(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    spoken = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(key).alias("doc_id"), spoken.alias("lang"), F.col(text).alias("text"))
    # 2 * per_class rows of two numbers at most
    held = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "lang", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).where(F.col("bytes") <= LONGEST)
    upto = F.sum("bytes").over(Window.partitionBy("y").orderBy(rank, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("upto", upto).where(F.col("upto") <= CLASS_BYTES).select("doc_id", "y", "lang", "text")


def platt(margins: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), fitted to smoothed targets by damped Newton steps; a is positive."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = (weights * (y == 1)).sum(), (weights * (y == 0)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, margins.std())
    x = np.stack([margins / scale, np.ones(len(y))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = x @ (weights * (p - target)) + np.array([1e-3, 0]) * w
        h = (x * (weights * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3) / scale, float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
