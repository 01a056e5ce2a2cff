"""Moving-average orders for the seasonal autoregression, by regression on innovations.

A long autoregression, one least-squares fit per series and differencing, gives the innovations; their
lags join the lags of the target and the calendar as regressors of a second least squares. Both fits
are aggregates of products over the training rows, so every order of every series is a sub-matrix of
one Gram matrix and no likelihood is maximised. ``seasonal_arma`` takes all steps of a series in one
group; the steps are also there one by one as frames, whose rows can be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import AR_ORDERS, ARX_REGRESSORS, SEASON
from daybook.models.arx import DIFFERENCINGS, LAG_TERMS, behind, design_rows, products_of, regressor_days
from daybook.operators.panel import Span, attach_calendar, by_series
from daybook.operators.splits import SplitBounds, label_split

UNIT = ["series_id", "d", "sd"]
#: Lags of the long autoregression: a week and a day, then two and three seasons.
LONG_LAGS = [*range(1, SEASON + 2), 2 * SEASON, 2 * SEASON + 1, 3 * SEASON]
#: Leading rows of a series that lack some lag at the deepest differencing.
HEAD = SEASON + 1 + max(LONG_LAGS) + max(LAG_TERMS)
#: Regressors of the second fit: constant, lags of the target, calendar, lags of the innovations.
WIDTH = 1 + len(LAG_TERMS) + len(ARX_REGRESSORS) + len(LAG_TERMS)
_FIRST_MA = WIDTH - len(LAG_TERMS)
ORDERS = "p int, q int, sp int, sq int, n bigint, rss double, aic double, beta array<double>"
_UNIT_SCHEMA = "series_id bigint, d int, sd int"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per series, day and differencing: ``z``, its regressors ``x`` and its long lags ``far``."""
    w = by_series()
    names = [f"{d}{sd}" for d, sd in DIFFERENCINGS]
    far = {f"far{k}": F.array(F.lit(1.0), *[F.lag(f"z{k}", lag).over(w) for lag in LONG_LAGS]) for k in names}
    placed = rows.withColumns({**far, "place": F.row_number().over(w)})
    options = [
        F.struct(F.lit(d).alias("d"), F.lit(sd).alias("sd"), F.col(f"z{d}{sd}").alias("z"), F.col(f"x{d}{sd}").alias("x"), F.col(f"far{d}{sd}").alias("far"))
        for d, sd in DIFFERENCINGS
    ]
    return placed.select("series_id", "date", "place", *keep, F.inline(F.array(*options)))


def gram_sums(rows: DataFrame, vector: Column, size: int) -> DataFrame:
    """Upper triangle of the Gram matrix of a vector of ``size`` entries per unit, in one aggregate."""
    entries = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.select(*UNIT, vector.alias("v")).groupBy(*UNIT).agg(
        F.count("*").alias("n"), *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g_{i}_{j}") for i, j in entries]
    )
    return sums.select(*UNIT, "n", F.array(*[F.col(f"g_{i}_{j}") for i, j in entries]).alias("g"))


def _matrices(batch: pd.DataFrame, size: int) -> np.ndarray:
    gram = np.zeros((len(batch), size, size))
    upper = np.triu_indices(size)
    gram[:, upper[0], upper[1]] = np.stack(batch["g"].to_list())
    return gram + np.triu(gram, 1).transpose(0, 2, 1)


def _least_squares(gram: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual sum of every matrix at once; the last entry is the target."""
    left = gram[:, used][:, :, used]
    right = gram[:, used, -1]
    scale = np.sqrt(np.maximum(np.diagonal(left, axis1=1, axis2=2), 1e-12))
    inverse = np.linalg.pinv(left / (scale[:, :, None] * scale[:, None, :]), rcond=1e-10, hermitian=True)
    solved = (inverse @ (right / scale)[:, :, None])[:, :, 0] / scale
    rss = gram[:, -1, -1] - (solved * right).sum(axis=1)
    return solved, np.maximum(rss, 1e-9)


def innovations(units: DataFrame, training: Column) -> DataFrame:
    """``units`` with ``shocks``: lags of the one-step errors of the long autoregression.

    The coefficients come from training rows alone; the errors of later rows are one-step errors too.
    """
    size = 2 + len(LONG_LAGS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                solved, _ = _least_squares(_matrices(batch, size), list(range(size - 1)))
                yield batch[UNIT].assign(long_beta=list(solved))

    whole = training & (F.col("place") > HEAD - max(LAG_TERMS))
    sums = gram_sums(units.where(whole), F.concat("far", F.array("z")), size)
    fitted = sums.mapInPandas(fit, f"{_UNIT_SCHEMA}, long_beta array<double>")
    shocked = units.join(fitted, UNIT).withColumn("shock", F.col("z") - _dot(F.col("far"), F.col("long_beta")))
    by_unit = Window.partitionBy(*UNIT).orderBy("date")
    shocks = F.array(*[F.lag("shock", lag).over(by_unit) for lag in LAG_TERMS])
    return shocked.withColumn("shocks", shocks).drop("far", "long_beta")


def order_columns(p: int, q: int, sp: int, sq: int) -> list[int]:
    """Positions of an order's regressors in the vector of the second fit."""
    fixed = [0, *range(1 + len(LAG_TERMS), _FIRST_MA)]
    ma = [*range(_FIRST_MA, _FIRST_MA + q), *range(_FIRST_MA + 2, _FIRST_MA + 2 + sq)]
    return sorted([*fixed, *range(1, 1 + p), *range(3, 3 + sp), *ma])


def candidate_orders(shocked: DataFrame, training: Column) -> DataFrame:
    """Residual sum, AIC and coefficients of every order (p, q)(P, Q) of every unit.

    All orders are fitted on the same rows. The empty order is left out.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            gram, n = _matrices(batch, WIDTH + 1), batch["n"].to_numpy()
            for order in product(AR_ORDERS, repeat=4):
                if not any(order):
                    continue
                used = order_columns(*order)
                solved, rss = _least_squares(gram, used)
                beta = np.zeros((len(batch), WIDTH))
                beta[:, used] = solved
                aic = n * np.log(rss / n) + 2 * len(used)
                p, q, sp, sq = order
                yield batch[UNIT].assign(p=p, q=q, sp=sp, sq=sq, n=n, rss=rss, aic=aic, beta=list(beta))

    whole = training & (F.col("place") > HEAD)
    sums = gram_sums(shocked.where(whole), F.concat("x", "shocks", F.array("z")), WIDTH + 1)
    return sums.mapInPandas(solve, f"{_UNIT_SCHEMA}, {ORDERS}")


def select_order(candidates: DataFrame) -> DataFrame:
    """Lowest AIC within each differencing; between differencings the lowest one-step error."""
    fields = ["p", "q", "sp", "sq", "n", "rss", "aic", "beta"]
    within = candidates.groupBy(*UNIT).agg(
        F.min_by(F.struct(*fields), F.struct("aic", "p", "q", "sp", "sq")).alias("best")
    )
    across = within.groupBy("series_id").agg(
        F.min_by(F.struct("d", "sd", "best"), F.struct("best.rss", "d", "sd")).alias("r")
    )
    return across.select("series_id", "r.d", "r.sd", "r.best.*")


def labelled_units(panel: DataFrame, days: DataFrame, span: Span, bounds: SplitBounds, y: str = "total") -> DataFrame:
    """Units of every day with its split; the first rows of a series feed lags only."""
    return unit_rows(label_split(design_rows(panel, days, span, y), bounds), [y, "split"])


def forecast(shocked: DataFrame, orders: DataFrame, y: str = "total") -> DataFrame:
    """One-step forecasts with frozen coefficients from observed history, as ``seasonal_arma``."""
    joined = shocked.join(orders.select(*UNIT, "beta"), UNIT)
    step = _dot(F.concat("x", "shocks"), F.col("beta"))
    return joined.withColumn("seasonal_arma", step + F.col(y) - F.col("z"))


def _columns(table: pa.Table, y: str) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A series by date; per differencing its target, its regressors and its long lags, NaN where absent."""
    table = table.sort_by([("date", "ascending")]) if table.num_rows > 1 else table
    total = table.column(y).to_numpy(zero_copy_only=False).astype(float)
    width = len(DIFFERENCINGS) * len(ARX_REGRESSORS)
    flags = np.full((table.num_rows, width), np.nan)
    known = table.column("regressors").combine_chunks()
    flags[known.is_valid().to_numpy(zero_copy_only=False)] = known.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    ones = np.ones(len(total))
    targets, inputs, far = [], [], []
    for number, (d, sd) in enumerate(DIFFERENCINGS):
        z = total - (behind(total, 1) if d else 0.0) - (behind(total, SEASON) if sd else 0.0)
        z = z + behind(total, SEASON + 1) if d and sd else z
        own = flags[:, number * len(ARX_REGRESSORS) : (number + 1) * len(ARX_REGRESSORS)]
        targets.append(z)
        inputs.append(np.column_stack([ones, *[behind(z, lag) for lag in LAG_TERMS], own]))
        far.append(np.column_stack([ones, *[behind(z, lag) for lag in LONG_LAGS]]))
    return table, targets, inputs, far


def _orders_by_size() -> dict[int, list[tuple[int, int, int, int]]]:
    """All orders but the empty one, by their number of regressors."""
    found: dict[int, list] = {}
    for order in product(AR_ORDERS, repeat=4):
        if any(order):
            found.setdefault(len(order_columns(*order)), []).append(order)
    return found


def _fit_series(table: pa.Table, y: str) -> tuple[pa.Table, dict, np.ndarray] | None:
    """A series by date, its chosen order and the forecasts of its rows; None if it is too short.

    The steps and rows are those of ``innovations``, ``candidate_orders``, ``select_order`` and ``forecast``.
    """
    table, targets, inputs, far = _columns(table, y)
    place = np.arange(1, table.num_rows + 1)
    training = np.array([s == "train" for s in table.column("split").to_pylist()])
    long, whole = training & (place > HEAD - max(LAG_TERMS)), training & (place > HEAD)
    n = int(whole.sum())
    if not n:
        return None
    grams = np.stack([products_of(np.column_stack([f[long], z[long]])) for f, z in zip(far, targets)])
    betas, _ = _least_squares(grams, list(range(len(LONG_LAGS) + 1)))
    vectors = []
    for z, x, f, beta in zip(targets, inputs, far, betas):
        shock = z - sum(f[:, i] * beta[i] for i in range(len(beta)))
        vectors.append(np.column_stack([x, *[behind(shock, lag) for lag in LAG_TERMS]]))
    grams = np.stack([products_of(np.column_stack([v[whole], z[whole]])) for v, z in zip(vectors, targets)])
    best: dict[int, tuple] = {}
    for size, orders in _orders_by_size().items():
        places = np.array([[*order_columns(*order), WIDTH] for order in orders])
        stacked = grams[:, places[:, :, None], places[:, None, :]]
        solved, rss = _least_squares(stacked.reshape(-1, size + 1, size + 1), list(range(size)))
        aic = n * np.log(rss / n) + 2 * size
        for i, (unit, order) in enumerate(product(range(len(DIFFERENCINGS)), orders)):
            if unit not in best or (aic[i], order) < best[unit][:2]:
                best[unit] = (aic[i], order, rss[i], places[i % len(orders), :-1], solved[i])
    unit = min(best, key=lambda u: (best[u][2], *DIFFERENCINGS[u]))
    aic, (p, q, sp, sq), rss, used, solved = best[unit]
    beta = np.zeros(WIDTH)
    beta[used] = solved
    d, sd = DIFFERENCINGS[unit]
    chosen = {"d": d, "sd": sd, "p": p, "q": q, "sp": sp, "sq": sq, "n": n, "rss": float(rss), "aic": float(aic), "beta": beta.tolist()}
    step = sum(vectors[unit][:, i] * beta[i] for i in range(WIDTH))
    total = table.column(y).to_numpy(zero_copy_only=False).astype(float)
    return table, chosen, step + total - targets[unit]


def seasonal_arma(
    panel: DataFrame, days: DataFrame, span: Span, bounds: SplitBounds, y: str = "total"
) -> tuple[DataFrame, DataFrame]:
    """Orders chosen on the training rows, and the forecasts of every row after the first ones.

    A series too short for its lags, or without training rows, has neither. A fit reads the rows of its
    series alone, at most one a day, so each series is one group: neither the four differencings of a
    row nor its lags are stored or shuffled, and the forecasts fit again in their own pass.
    """
    rows = attach_calendar(label_split(panel, bounds), regressor_days(days), span)
    series = rows.where("series_id IS NOT NULL").groupBy("series_id")
    kind = dict(panel.dtypes)[y]
    order_schema = f"{_UNIT_SCHEMA}, {ORDERS}"
    columns = [field.split()[0] for field in order_schema.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 6, pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    wanted = pa.schema(list(zip(columns, types)))

    def choose(table: pa.Table) -> pa.Table:
        found = _fit_series(table, y)
        chosen = [] if found is None else [{"series_id": table.column("series_id")[0].as_py(), **found[1]}]
        return pa.Table.from_pylist(chosen, wanted)

    def predict(table: pa.Table) -> pa.Table:
        found = _fit_series(table, y)
        kept = ["series_id", "date", "split", y]
        if found is None:
            return table.select(kept).slice(0, 0).append_column("seasonal_arma", pa.array([], pa.float64()))
        ordered, _, values = found
        return ordered.select(kept).append_column("seasonal_arma", pa.array(values, from_pandas=True)).slice(HEAD)

    orders = series.applyInArrow(choose, order_schema)
    forecasts = series.applyInArrow(predict, f"series_id bigint, date date, split string, {y} {kind}, seasonal_arma double")
    return orders, forecasts
