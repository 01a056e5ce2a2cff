"""Least squares on scaled history windows from additive sums of squares and products.

A row's inputs are the ``width`` values before it, other columns of the row (``exog``) and a
constant. Sums of products of inputs and target over a set of rows are all a fit needs, and they
add: per series the rows are cut into segments, a setting takes a run of neighbouring segments, and
one pass gives the sums of every setting, of every replicate and of every subset of the columns.
Scaling to the range of a series is an affine map of the inputs, so the raw sums of the segments
serve settings whose ranges differ. Series lie whole and sorted in the partitions; a series has one
row per day, so what a task holds at a time is bounded by the calendar. No window is ever stored,
and a task sends one row per setting and replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.panel import KEYS

Series = dict[str, np.ndarray]
#: Probabilities of 0, 1, 2, ... draws of a row in a replicate, summed up.
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], float))
#: Singular values below this share of the largest count as zero.
RANK_TOLERANCE = 1e-11


@dataclass(frozen=True)
class Cut:
    """How the rows of one series enter the fits.

    ``segment`` numbers each row's segment, -1 for rows in no fit; ``settings`` are, in one order for
    all series, the first segment and the one after the last, or None if the series has none.
    """

    segment: np.ndarray
    settings: list[tuple[int, int] | None]


Cutter = Callable[[Series], Cut]


def in_order(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """Whole series in one partition each, by date; ``dealt`` rows lie so already and do not move."""
    return (rows if dealt else rows.repartition("series_id")).sortWithinPartitions(*KEYS)


def each_series(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole series of sorted batches, one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("series_id").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for start, end in zip(edges, edges[1:]):
            if held and held[0].column("series_id")[0].as_py() != ids[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table) -> Series:
    return {name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in table.column_names}


def draws(series: Series, seed: int) -> np.ndarray:
    """How often each row is drawn in a replicate: Poisson with mean 1, from a hash of the row."""
    days = series["date"].astype("datetime64[D]").astype(np.int64).astype(np.uint64)
    x = series["series_id"].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + days
    x = x + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, uniform, side="right").astype(float)


def _inputs(series: Series, width: int, exog: Sequence[str], origin: float) -> np.ndarray:
    """Constant, window, exog and target of every row that has a whole window, less ``origin``."""
    total = series["total"].astype(float) - origin
    n = len(total) - width
    window = np.lib.stride_tricks.sliding_window_view(total[:-1], width)[:n]
    others = [series[c].astype(float)[width:] for c in exog]
    return np.column_stack([np.ones(n), window, *others, total[width:]])


def _range(series: Series, cut: Cut, setting: tuple[int, int]) -> tuple[float, float]:
    """Least value and width of the target over the rows of a setting."""
    values = series["total"][(cut.segment >= setting[0]) & (cut.segment < setting[1])]
    low, span = float(values.min()), float(values.max() - values.min())
    return low, span or 1.0


def _map(width: int, n_exog: int, low: float, span: float) -> np.ndarray:
    """Matrix that brings inputs and target to the range of a series."""
    scaled = np.r_[0, np.ones(width), np.zeros(n_exog), 1].astype(bool)
    matrix = np.diag(np.where(scaled, 1.0 / span, 1.0))
    matrix[scaled, 0] = -low / span
    return matrix


def _ready(series: Series, width: int, cutter: Cutter) -> Cut | None:
    """The cut of a series, rows without a whole window in no segment; None if nothing is left."""
    if len(series["total"]) <= width:
        return None
    cut = cutter(series)
    cut.segment[:width] = -1
    return cut


def sums(rows: DataFrame, cutter: Cutter, width: int, exog: Sequence[str] = (), seeds: Sequence[int] = ()) -> dict:
    """Matrix of sums of products for every (setting, seed), from one pass over the rows.

    ``rows`` have series_id, date, total and the exog. Without ``seeds`` every row counts once (seed
    0); with seeds each gives a replicate in which rows count as often as they are drawn.
    """
    names, size = list(exog), width + len(exog) + 2

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for table in each_series(batches):
            series = _arrays(table)
            cut = _ready(series, width, cutter)
            if cut is None:
                continue
            origin = float(series["total"][0])
            inputs, segment = _inputs(series, width, names, origin), cut.segment[width:]
            count = max((s[1] for s in cut.settings if s), default=0)
            for seed in seeds or (0,):
                weight = draws(series, seed)[width:] if seeds else np.ones(len(inputs))
                before = np.zeros((count + 1, size, size))
                for s in range(count):
                    mine = inputs[segment == s]
                    before[s + 1] = before[s] + (mine * weight[segment == s, None]).T @ mine
                for number, setting in enumerate(cut.settings):
                    if setting is None or not np.any((segment >= setting[0]) & (segment < setting[1])):
                        continue
                    low, span = _range(series, cut, setting)
                    change = _map(width, len(names), low - origin, span)
                    scaled = change @ (before[setting[1]] - before[setting[0]]) @ change.T
                    key = (number, seed)
                    found[key] = found[key] + scaled if key in found else scaled
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        values = pa.array([found[k].ravel() for k in keys], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*columns, values], ["setting", "seed", "products"])

    sent = rows.mapInArrow(add, "setting long, seed long, products array<double>")
    vectors = sent.withColumn("products", array_to_vector("products")).groupBy("setting", "seed")
    added = vectors.agg(vector_to_array(Summarizer.sum(F.col("products"))).alias("products"))
    return {(r.setting, r.seed): np.array(r.products).reshape(size, size) for r in added.collect()}


def solve(products: np.ndarray, width: int, chosen: Sequence[int] | None = None) -> np.ndarray:
    """Coefficients of constant, window and exog; those of exog not ``chosen`` (by place) are zero."""
    n = len(products) - 1
    others = range(n - 1 - width) if chosen is None else chosen
    used = [*range(width + 1), *[width + 1 + i for i in others]]
    left, right = products[np.ix_(used, used)], products[used, n]
    scale = np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1.0))
    values = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=RANK_TOLERANCE)[0] / scale
    beta = np.zeros(n)
    beta[used] = values
    return beta


def forecast(
    rows: DataFrame,
    cutter: Cutter,
    width: int,
    fits: list[tuple[int, np.ndarray]],
    exog: Sequence[str] = (),
    own: Callable[[Series], np.ndarray] | None = None,
) -> DataFrame:
    """Rows with ``forecasts``, one per fit (its setting and coefficients), in units of the series.

    Null where a row has no whole window or its series no rows in the setting. With ``own``, which
    gives each row's setting, a row is only forecast by the fits of that setting.
    """
    names, kinds = list(exog), [*rows.dtypes, ("forecasts", "array<double>")]

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_series(batches):
            series = _arrays(table)
            cut = _ready(series, width, cutter)
            out = np.full((table.num_rows, len(fits)), np.nan)
            if cut is not None:
                inputs = _inputs(series, width, names, 0.0)[:, :-1]
                mine = own(series)[width:] if own else None
                for i, (setting, beta) in enumerate(fits):
                    chosen = cut.settings[setting]
                    if chosen is None or not np.any((cut.segment >= chosen[0]) & (cut.segment < chosen[1])):
                        continue
                    low, span = _range(series, cut, chosen)
                    scaled = inputs @ (_map(width, len(names), low, span)[:-1, :-1].T @ beta)
                    value = scaled * span + low
                    out[width:, i] = value if mine is None else np.where(mine == setting, value, np.nan)
            flat = pa.array(out.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(len(fits), 1), np.int32), flat)
            whole = table.append_column("forecasts", lists).combine_chunks()
            yield from whole.to_batches()

    return rows.mapInArrow(predict, ", ".join(f"{name} {kind}" for name, kind in kinds))
