"""Hard negatives: for anchors and their positives the best rows of other labels whose scores lie in a range below the positive's.

Scores are integer inner products. Anchors meet rows in blocks. Within a block vectors are turned by an orthogonal matrix from their principal components,
products of the leading components are summed, and the rest is bounded by the norms of what is left, so that most pairs are discarded before they are
complete; the others are verified with integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import stored

#: Rows and anchors of a block; rows taken at a time within one; pairs verified at a time; parts of the leading components that are summed in turn.
ROW_BLOCK, ANCHOR_BLOCK, STRIPE, PAIRS = 1 << 16, 1 << 11, 1 << 11, 1 << 16
LEADING = (8, 4, 2)
#: At least so many blocks of rows, that a small table keeps a cluster busy too.
LEAST_BLOCKS = 24
#: A vector of a greater norm could have scores beyond a long.
LARGEST_NORM = 2.0**31


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v the components times 256, rounded down, as longs.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; nor do rows whose scores couldn't be longs, or whose vector
    hasn't the table's most frequent length (of two equally frequent ones the greater) or is empty.
    """
    # doubles before they are multiplied; NaN and infinities have no finite difference with themselves
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("long"))
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < 1e18, F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite & (F.size(F.col(vector)) > 0))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(norm < LARGEST_NORM**2)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.where(F.size("v") == size) if size is not None else rows.where(F.lit(False))


def rotation(rows: DataFrame) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions, strongest first, from sums of products over all rows: one matrix for each task, added up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for begin in range(0, len(frame), STRIPE):
                v = np.stack(frame.v.to_numpy()[begin : begin + STRIPE]).astype(float)
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pd.DataFrame({"row": range(len(total)), "sums": list(total)})

    parts = rows.select("v").mapInPandas(run, "row int, sums array<double>")
    # elementwise sums, so that what comes here is one matrix whatever the number of tasks
    cells = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    if not cells:
        return np.zeros((0, 0))
    size = 1 + max(c.row for c in cells)
    matrix = np.zeros((size, size))
    for c in cells:
        matrix[c.row, c.col] = c.x
    values, directions = np.linalg.eigh((matrix + matrix.T) / 2)
    return directions[:, np.argsort(-values, kind="stable")]


def surviving(anchors: np.ndarray, rows: np.ndarray, turn: np.ndarray, allowed: np.ndarray, low: Callable[[], np.ndarray], high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all allowed pairs whose score isn't below low() of the anchor nor above high, and of some others never: scores are exact.

    A pair is discarded once the sum of its leading products, with what the rest can add at most, is below low, or with what it can take away, above high.
    """
    a, r = anchors @ turn, rows @ turn
    size = turn.shape[0]
    norm_a, norm_r = np.linalg.norm(a, axis=1), np.linalg.norm(r, axis=1)
    # rounding of the rotation, of the sums and of a matrix that is orthogonal but for its own rounding
    slip = (4 * size + 64) * np.finfo(float).eps + np.abs(turn.T @ turn - np.eye(size)).sum()
    floor, lead = low(), max(1, size // LEADING[0])
    part = a[:, :lead] @ r[:, :lead].T
    slack = slip * np.outer(norm_a, norm_r) + 1e-9
    rest = np.outer(np.linalg.norm(a[:, lead:], axis=1), np.linalg.norm(r[:, lead:], axis=1)) + slack
    held = allowed & (part + rest >= floor[:, None])
    if high is not None:
        held &= part - rest <= high[:, None]
    i, j = np.nonzero(held)
    sums, done = part[i, j], lead
    for share in LEADING[1:]:
        upto = max(done, size // share)
        for begin in range(0, len(i), PAIRS):
            s = slice(begin, begin + PAIRS)
            sums[s] += np.einsum("ij,ij->i", a[i[s], done:upto], r[j[s], done:upto])
        rest = np.linalg.norm(a[:, upto:], axis=1)[i] * np.linalg.norm(r[:, upto:], axis=1)[j] + slack[i, j]
        held = sums + rest >= floor[i]
        if high is not None:
            held &= sums - rest <= high[i]
        i, j, sums, done = i[held], j[held], sums[held], upto
    exact = np.empty(len(i), np.int64)
    for begin in range(0, len(i), PAIRS):
        s = slice(begin, begin + PAIRS)
        exact[s] = np.einsum("ij,ij->i", anchors[i[s]], rows[j[s]])
    return i, j, exact


def _merged(keep: list[pd.DataFrame], by: list[str], k: int) -> pd.DataFrame:
    """The k best of each group, an id once, at its best score; ties by id."""
    rows = pd.concat(keep, ignore_index=True).sort_values([*by, "score", "id"], ascending=[*[True] * len(by), False, True], kind="stable")
    rows = rows.drop_duplicates([*by, "id"])
    return rows[rows.groupby(by, sort=False).cumcount() < k]


def best_same(anchors: pd.DataFrame, rows: pd.DataFrame, turn: np.ndarray, k: int) -> pd.DataFrame:
    """Of one block of anchors and one of rows: each anchor's k best other rows of its label."""
    a, r = np.stack(anchors.v.to_numpy()), np.stack(rows.v.to_numpy())
    label, own = anchors.label.to_numpy(), anchors.vec_id.to_numpy()
    other, ids = rows.label.to_numpy(), rows.vec_id.to_numpy()
    held = pd.DataFrame({"a": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    least = np.full(len(a), -np.inf)
    for begin in range(0, len(r), STRIPE):
        s = slice(begin, begin + STRIPE)
        allowed = (label[:, None] == other[None, s]) & (own[:, None] != ids[None, s])
        i, j, score = surviving(a, r[s], turn, allowed, lambda: least, None)
        held = _merged([held, pd.DataFrame({"a": i, "id": ids[s][j], "score": score})], ["a"], k)
        full = held.groupby("a").score.agg(["size", "min"])
        full = full[full["size"] == k]
        least[full.index] = full["min"]
    return pd.DataFrame({"anchor_id": own[held.a.to_numpy()], "id": held.id, "score": held.score})


def best_other(anchors: pd.DataFrame, rows: pd.DataFrame, turn: np.ndarray, k: int, low: int, high: int) -> pd.DataFrame:
    """Of one block of anchors, each with its positives (pid, pscore), and one of rows: for each positive the k best rows of other labels in its range."""
    a, r = np.stack(anchors.v.to_numpy()), np.stack(rows.v.to_numpy())
    label, own = anchors.label.to_numpy(), anchors.vec_id.to_numpy()
    other, ids = rows.label.to_numpy(), rows.vec_id.to_numpy()
    sizes = np.array([len(x) for x in anchors.pid])
    of = np.repeat(np.arange(len(a)), sizes)  # positives of all anchors in one row
    pid, pscore = (np.concatenate([np.asarray(x, np.int64) for x in anchors[c]]) for c in ("pid", "pscore"))
    # low * p <= 100 * score <= high * p, rounded to the integers within
    begin_p, end_p = -(-low * pscore // 100), high * pscore // 100
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    top = np.maximum.reduceat(end_p, first).astype(float)
    held = pd.DataFrame({"p": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    least = begin_p.astype(float)
    for begin in range(0, len(r), STRIPE):
        s = slice(begin, begin + STRIPE)
        i, j, score = surviving(a, r[s], turn, label[:, None] != other[None, s], lambda: np.minimum.reduceat(least, first), top)
        for part in range(0, len(i), PAIRS):
            x, y, z = i[part : part + PAIRS], j[part : part + PAIRS], score[part : part + PAIRS]
            each = sizes[x]
            p = np.repeat(first[x], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            y, z = np.repeat(y, each), np.repeat(z, each)
            inside = (z >= least[p]) & (z <= end_p[p])
            held = _merged([held, pd.DataFrame({"p": p[inside], "id": ids[s][y[inside]], "score": z[inside]})], ["p"], k)
            full = held.groupby("p").score.agg(["size", "min"])
            full = full[full["size"] == k]
            least[full.index] = full["min"]
    at = held.p.to_numpy()
    return pd.DataFrame({"anchor_id": own[of[at]], "positive_id": pid[at], "positive_score": pscore[at], "id": held.id, "score": held.score})


def _in_blocks(anchors: DataFrame, rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work over every block of anchors with every block of rows, each pair one task's group of bounded size; ids are hashed to blocks, so none is hot but by repeats."""
    n, m = anchors.count(), rows.count()
    wide, deep = max(1, -(-n // ANCHOR_BLOCK)), max(LEAST_BLOCKS, -(-m // ROW_BLOCK))
    # rows with one id and vector are alike, so they are dealt by more than their id
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(deep))
    left = anchors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(wide))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(deep - 1))))
    right = rows.withColumn("c", spread).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    cast = lambda f: f.withColumns({x: F.col(x).cast("long") for x in ("b", "c")})
    empty = pd.DataFrame({x.split()[0]: pd.Series(dtype="int64") for x in schema.split(", ")})
    done = lambda a, r: work(a, r) if len(a) and len(r) else empty
    return cast(left).groupBy("b", "c").cogroup(cast(right).groupBy("b", "c")).applyInPandas(done, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of whole_vectors' rows.

    Anchors are the rows that meet the condition; of rows with one id that meet it the least (label, vector) is the anchor. Its positives are the best
    other rows of its label; a positive's negatives the best rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Equal scores go by id. An id is in a list once, at its best score, so repeated rows count once. An empty table gives no rows.
    """
    rows = stored(vectors)
    chosen = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*")
    turn = rotation(rows)
    best = lambda by, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")) <= k
    same = _in_blocks(chosen, rows, lambda a, r: best_same(a, r, turn, positives), "anchor_id long, id long, score long")
    same = same.groupBy("anchor_id", "id").agg(F.max("score").alias("score")).withColumn("k", best(["anchor_id"], positives)).where("k")
    known = same.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("p"))
    paired = stored(chosen.join(known.select(F.col("anchor_id").alias("vec_id"), F.col("p.id").alias("pid"), F.col("p.score").alias("pscore")), "vec_id"))
    schema = "anchor_id long, positive_id long, positive_score long, id long, score long"
    other = _in_blocks(paired, rows, lambda a, r: best_other(a, r, turn, negatives, low, high), schema)
    keys = ["anchor_id", "positive_id"]
    other = other.groupBy(*keys, "positive_score", "id").agg(F.max("score").alias("score"))
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    return ranked.select(*keys, "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
