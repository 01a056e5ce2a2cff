"""Held-out errors of many boosted fits on a table small enough for one task: a task is a fit.

The fits are those of ``GBTRegressor`` with squared error: features in at most 32 bins, each tree
grown level by level on the sums of its bins, the first tree with weight one, all later ones fitted
to twice the residual and weighted by the step size. A tree of such a table takes less than the
jobs that its levels would be, so the fits are dealt to the tasks and not their rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 32
#: Rows from which the limits of the bins are taken, as in ``GBTRegressor``.
SPLIT_ROWS = 10_000
#: Impurity below which a node is a leaf.
PURE = float(np.finfo(float).eps)


def split_points(values: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Upper limits of all bins but the last: between all values, or nearest to equal counts."""
    value, count = np.unique(values, return_counts=True)
    middle = (value[:-1] + value[1:]) / 2
    bins = min(max_bins, len(values))
    if len(middle) < bins:
        return middle
    stride = len(values) / bins
    chosen, target, reached = [], stride, np.cumsum(count).tolist()
    for i in range(1, len(reached)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            chosen.append(i - 1)
            target += stride
    return middle[chosen]


def _features(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def limits(fit: DataFrame, n_rows: int, seed: int) -> list[np.ndarray]:
    """Limits of the bins of every feature of the vectors."""
    chosen = fit.sample(SPLIT_ROWS / n_rows, seed) if n_rows > SPLIT_ROWS else fit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_features(piece.column("x")) for piece in batches if piece.num_rows]
        if held:
            found = [split_points(column) for column in np.concatenate(held).T]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["cuts"])

    rows = chosen.select(vector_to_array("features").alias("x")).coalesce(1).mapInArrow(run, "cuts array<double>")
    return [np.array(r["cuts"], float) for r in rows.collect()]


def _blocks(vectors: DataFrame, cuts: list[np.ndarray], label: str) -> DataFrame:
    """The rows as bytes, one row a batch: bins by feature, then the labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, piece in enumerate(p for p in batches if p.num_rows):
            x = _features(piece.column("x"))
            codes = np.stack([np.searchsorted(c, column).astype(np.uint8) for c, column in zip(cuts, x.T)])
            y, out = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("y", "out"))
            if not np.isfinite(y).all():
                raise ValueError("labels must be finite")
            for flag in (False, True):
                at = np.flatnonzero(out == flag)
                row = [[TaskContext.get().partitionId()], [i], [flag], [codes[:, at].tobytes()], [y[at].astype(float).tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                    ["part", "place", "out", "codes", "y"],
                )

    rows = vectors.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), "out")
    return rows.mapInArrow(run, "part int, place int, out boolean, codes binary, y binary")


def _best_splits(codes: np.ndarray, slot: np.ndarray, y: np.ndarray, m: int, least: int) -> tuple[np.ndarray, ...]:
    """Of every open node its gain, feature, bin, and the means of the two sides; ties go to the first."""
    shape = (len(codes), m + 1, MAX_BINS)
    base = slot * MAX_BINS
    sums, counts = np.empty(shape), np.empty(shape)
    for f, column in enumerate(codes):
        at = base + column
        sums[f] = np.bincount(at, y, (m + 1) * MAX_BINS).reshape(shape[1:])
        counts[f] = np.bincount(at, minlength=(m + 1) * MAX_BINS).reshape(shape[1:])
    sums, counts = sums[:, :m].cumsum(axis=2), counts[:, :m].cumsum(axis=2)
    whole, n = sums[:, :, -1:], counts[:, :, -1:]
    right, n_right = whole - sums, n - counts
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sums**2 / counts + right**2 / n_right - whole**2 / n
    gain[(counts < least) | (n_right < least)] = -np.inf
    ranked = gain.transpose(1, 0, 2).reshape(m, -1)
    best = ranked.argmax(axis=1)
    feature, cut, node = best // MAX_BINS, best % MAX_BINS, np.arange(m)
    at = (feature, node, cut)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ranked[node, best], feature, cut, sums[at] / counts[at], right[at] / n_right[at]


def _grow(codes: np.ndarray, y: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, ...]:
    """One tree: feature (-1 in a leaf), bin, left child and value of each node, and the node of each row."""
    feature, cut, child, value = [-1], [0], [0], [y.mean()]
    at, rows = np.zeros(len(y), np.intp), np.arange(len(y))
    opened = [0]
    for _ in range(depth):
        m = len(opened)
        slots = np.full(len(value), m)
        slots[opened] = np.arange(m)
        slot = slots[at]
        count = np.bincount(slot, minlength=m + 1)[:m]
        mean = np.bincount(slot, y, m + 1)[:m] / count
        impurity = np.bincount(slot, y * y, m + 1)[:m] / count - mean**2
        gain, f, c, left, right = _best_splits(codes, slot, y, m, least)
        splits = np.flatnonzero((gain > 0) & (impurity > PURE))
        if not len(splits):
            break
        following = []
        for j in splits:
            node = opened[j]
            feature[node], cut[node], child[node] = int(f[j]), int(c[j]), len(value)
            following += [len(value), len(value) + 1]
            value += [left[j], right[j]]
            for column, empty in ((feature, -1), (cut, 0), (child, 0)):
                column += [empty, empty]
        at = _step_down(codes, rows, at, np.array(feature), np.array(cut), np.array(child))
        opened = following
    return np.array(feature), np.array(cut), np.array(child), np.array(value), at


def _step_down(codes, rows, at, feature, cut, child) -> np.ndarray:
    """The next node of every row; a row in a leaf stays."""
    chosen = feature[at]
    return np.where(chosen < 0, at, child[at] + (codes[chosen, rows] > cut[at]))


def boosted_errors(
    fit: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], params: dict, stages: Iterable[int]
) -> list[tuple[int, float, float]]:
    """Number of trees, mean absolute and root mean squared held-out error at each of the stages."""
    (codes, y), (codes_held, y_held) = fit, held
    stages, found = set(stages), []
    guess, guess_held = np.zeros(len(y)), np.zeros(len(y_held))
    rows_held = np.arange(len(y_held))
    for t in range(max(stages)):
        target, weight = (2 * (y - guess), params["stepSize"]) if t else (y, 1.0)
        feature, cut, child, value, at = _grow(codes, target, params["maxDepth"], params["minInstancesPerNode"])
        guess += weight * value[at]
        at = np.zeros(len(y_held), np.intp)
        for _ in range(params["maxDepth"]):
            at = _step_down(codes_held, rows_held, at, feature, cut, child)
        guess_held += weight * value[at]
        if t + 1 in stages:
            gap = y_held - guess_held
            found.append((t + 1, float(np.abs(gap).mean()), float(np.sqrt((gap**2).mean()))))
    return found


def dealt_errors(
    fit: DataFrame, held: DataFrame, n_fit: int, families: list[tuple[dict, list[int]]], label: str, seed: int
) -> list[list[tuple[int, float, float]]]:
    """Errors of every family, given as its parameters and numbers of trees; each family is a task."""
    cuts = limits(fit, n_fit, seed)
    marked = fit.withColumn("out", F.lit(False)).unionByName(held.withColumn("out", F.lit(True)))
    blocks = _blocks(marked, cuts, label).rdd.map(tuple)

    def run(k: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        ordered = sorted((r for _, r in rows), key=lambda r: r[:2])

        def side(flag: bool) -> tuple[np.ndarray, np.ndarray]:
            chosen = [(np.frombuffer(c, np.uint8).reshape(len(cuts), -1), np.frombuffer(y)) for _, _, out, c, y in ordered if out == flag]
            return np.concatenate([c for c, _ in chosen], axis=1), np.concatenate([y for _, y in chosen])

        yield k, boosted_errors(side(False), side(True), *families[k])

    n = len(families)
    dealt = blocks.flatMap(lambda r: [(k, r) for k in range(n)]).partitionBy(n, lambda k: k)
    return [found for _, found in sorted(dealt.mapPartitionsWithIndex(run).collect())]
