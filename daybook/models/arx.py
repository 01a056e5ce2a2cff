"""Seasonal autoregression with calendar regressors, one set of coefficients per series.

Every candidate order is a sub-matrix of one Gram matrix per differencing, so the whole order
grid of every series costs a single aggregation over the training rows. The small systems are
then solved where their rows are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import AR_ORDERS, ARX_REGRESSORS, DIFFERENCES, SEASON, WARMUP_DAYS
from daybook.operators.panel import Span, attach_calendar, by_series
from daybook.operators.splits import SplitBounds, label_split

DIFFERENCINGS = list(product(DIFFERENCES, DIFFERENCES))
LAG_TERMS = [1, 2, SEASON, 2 * SEASON]
SYSTEM = "series_id bigint, d int, sd int, p int, sp int, n bigint, rss double, aic double, beta array<double>"


def differenced(column: str, d: int, sd: int, w: Window) -> Column:
    """(1 - L)^d (1 - L^7)^sd applied to a column."""

    def past(k: int) -> Column:
        return F.lag(column, k).over(w).cast("double") if k else F.col(column).cast("double")

    value = past(0)
    if d:
        value = value - past(1)
    if sd:
        value = value - past(SEASON)
    if d and sd:
        value = value + past(SEASON + 1)
    return value


def design_rows(panel: DataFrame, days: DataFrame, span: Span, y: str = "total") -> DataFrame:
    """For every differencing: the differenced target ``z`` and its regressor array ``x``.

    Calendar regressors are differenced on the date dimension before the join.
    """
    w = by_series()
    by_day = Window.partitionBy("calendar_id").orderBy("date")
    regressors = days.select(
        "date",
        *[
            F.array(*[F.coalesce(differenced(c, d, sd, by_day), F.lit(0.0)) for c in ARX_REGRESSORS]).alias(
                f"u{d}{sd}"
            )
            for d, sd in DIFFERENCINGS
        ],
    )
    z = {(d, sd): f"z{d}{sd}" for d, sd in DIFFERENCINGS}
    with_z = panel.withColumns({name: differenced(y, *order, w) for order, name in z.items()})
    lagged = with_z.withColumns(
        {
            f"a{d}{sd}": F.array(F.lit(1.0), *[F.lag(z[d, sd], k).over(w) for k in LAG_TERMS])
            for d, sd in DIFFERENCINGS
        }
    )
    joined = attach_calendar(lagged, regressors, span)
    x = {f"x{d}{sd}": F.concat(f"a{d}{sd}", f"u{d}{sd}") for d, sd in DIFFERENCINGS}
    return joined.withColumns(x).drop(*[f"{k}{d}{sd}" for k in "au" for d, sd in DIFFERENCINGS])


def gram_table(training: DataFrame) -> DataFrame:
    """Upper triangle of the Gram matrix of (x, z) per series and differencing, in one aggregate."""
    size = 1 + len(LAG_TERMS) + len(ARX_REGRESSORS)
    options = [
        F.struct(
            F.lit(d).alias("d"),
            F.lit(sd).alias("sd"),
            F.concat(F.col(f"x{d}{sd}"), F.array(F.col(f"z{d}{sd}"))).alias("v"),
        )
        for d, sd in DIFFERENCINGS
    ]
    long = training.select("series_id", F.explode(F.array(*options)).alias("o")).select("series_id", "o.*")
    entries = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    sums = long.groupBy("series_id", "d", "sd").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g_{i}_{j}") for i, j in entries],
    )
    return sums.select("series_id", "d", "sd", "n", F.array(*[F.col(f"g_{i}_{j}") for i, j in entries]).alias("g"))


def order_columns(p: int, sp: int) -> list[int]:
    """Positions of an order's regressors: constant, its lags, calendar."""
    size = 1 + len(LAG_TERMS) + len(ARX_REGRESSORS)
    return sorted([0, *range(1 + len(LAG_TERMS), size), *range(1, 1 + p), *range(3, 3 + sp)])


#: All orders but the empty one, those of one number of regressors together.
ORDERS_BY_SIZE = [
    [o for o in product(AR_ORDERS, AR_ORDERS) if sum(o) == size] for size in range(1, 2 * max(AR_ORDERS) + 1)
]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least squares of every order from the stored Gram matrices."""
    size = 1 + len(LAG_TERMS) + len(ARX_REGRESSORS)
    upper = np.triu_indices(size + 1)
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            gram = np.zeros((size + 1, size + 1))
            gram[upper] = row.g
            gram = gram + np.triu(gram, 1).T
            for p, sp in product(AR_ORDERS, AR_ORDERS):
                if p == sp == 0:
                    continue
                used = order_columns(p, sp)
                left, right = gram[np.ix_(used, used)], gram[used, size]
                scale = np.sqrt(np.maximum(np.diag(left), 1e-12))
                inverse = np.linalg.pinv(left / np.outer(scale, scale), rcond=1e-10, hermitian=True)
                solved = inverse @ (right / scale) / scale
                rss = max(float(gram[size, size] - solved @ right), 1e-9)
                beta = np.zeros(size)
                beta[used] = solved
                aic = row.n * np.log(rss / row.n) + 2 * len(used)
                out.append((row.series_id, row.d, row.sd, p, sp, row.n, rss, aic, beta.tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SYSTEM.split(", ")])


def candidate_orders(training: DataFrame) -> DataFrame:
    """Residual sum, AIC and coefficients of every order of every series."""
    return gram_table(training).mapInPandas(_solve, SYSTEM)


def select_order(candidates: DataFrame) -> DataFrame:
    """Lowest AIC within each differencing; between differencings the lowest one-step error.

    One-step errors are in the units of the series whatever the differencing, and all orders
    are fitted on the same rows.
    """
    fields = ["p", "sp", "n", "rss", "aic", "beta"]
    within = candidates.groupBy("series_id", "d", "sd").agg(
        F.min_by(F.struct(*fields), F.struct("aic", "p", "sp")).alias("best")
    )
    across = within.groupBy("series_id").agg(
        F.min_by(F.struct("d", "sd", "best"), F.struct("best.rss", "d", "sd")).alias("r")
    )
    return across.select("series_id", "r.d", "r.sd", "r.best.*")


def order_table(orders: DataFrame) -> DataFrame:
    """The selected orders in the shape they are stored in."""
    zero = F.lit(0)
    return orders.select(
        "series_id",
        F.array("p", "d", zero).alias("order_pdq"),
        F.array("sp", "sd", zero, F.lit(SEASON)).alias("seasonal_order"),
        "aic",
        F.array(*[F.lit(c) for c in ARX_REGRESSORS]).alias("exog"),
    )


def forecast(rows: DataFrame, orders: DataFrame, y: str = "total") -> DataFrame:
    """One-step forecasts with frozen coefficients from observed history."""
    joined = rows.join(orders.select("series_id", "d", "sd", "beta"), "series_id")

    def chosen(stem: str) -> Column:
        pick = F
        for d, sd in DIFFERENCINGS:
            pick = pick.when((F.col("d") == d) & (F.col("sd") == sd), F.col(f"{stem}{d}{sd}"))
        return pick

    products = F.zip_with(F.col("beta"), chosen("x"), lambda b, x: b * x)
    step = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
    past = F.col(y) - chosen("z")
    return joined.withColumn("seasonal_arx", step + past)


def regressor_days(days: DataFrame) -> DataFrame:
    """``date, regressors``: the calendar regressors of every differencing, one after another; flags, so floats hold them."""
    by_day = Window.partitionBy("calendar_id").orderBy("date")
    values = [F.coalesce(differenced(c, d, sd, by_day), F.lit(0.0)).cast("float") for d, sd in DIFFERENCINGS for c in ARX_REGRESSORS]
    return days.select("date", F.array(*values).alias("regressors"))


def behind(values: np.ndarray, lag: int) -> np.ndarray:
    """Each row's value ``lag`` rows before, NaN in the first rows."""
    out = np.full(len(values), np.nan)
    out[lag:] = values[: max(len(values) - lag, 0)]
    return out


def _design(table: pa.Table, y: str) -> Iterator[np.ndarray]:
    """Regressors and, last, target of a series by date, per differencing, NaN where absent: ``x`` and ``z`` of ``design_rows``."""
    total = table.column(y).to_numpy(zero_copy_only=False).astype(float)
    known = table.column("regressors").combine_chunks()
    flags = known.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DIFFERENCINGS) * len(ARX_REGRESSORS))
    if known.null_count:
        there, found = known.is_valid().to_numpy(zero_copy_only=False), flags
        flags = np.full((len(total), found.shape[1]), np.nan)
        flags[there] = found
    size = 1 + len(LAG_TERMS) + len(ARX_REGRESSORS)
    for number, (d, sd) in enumerate(DIFFERENCINGS):
        z = total - (behind(total, 1) if d else 0.0) - (behind(total, SEASON) if sd else 0.0)
        z = z + behind(total, SEASON + 1) if d and sd else z
        design = np.empty((len(z), size + 1))
        design[:, 0], design[:, size] = 1.0, z
        for i, lag in enumerate(LAG_TERMS, 1):
            design[:, i] = behind(z, lag)
        design[:, 1 + len(LAG_TERMS) : size] = flags[:, number * len(ARX_REGRESSORS) : (number + 1) * len(ARX_REGRESSORS)]
        yield design


def products_of(rows: np.ndarray) -> np.ndarray:
    """Sums of products of the columns; as in an aggregate, a product with an absent value is left out."""
    if np.isnan(rows).any():
        return np.nansum(rows[:, :, None] * rows[:, None, :], axis=0)
    return rows.T @ rows


def _fit_series(table: pa.Table, y: str, val_start: dt.date) -> tuple[pa.Table, dict, np.ndarray] | None:
    """Rows of a series after the warm-up, its chosen order and their forecasts; None without training rows.

    The steps are those of ``apply_warmup``, ``candidate_orders``, ``select_order`` and ``forecast``.
    """
    table = table.sort_by([("date", "ascending")])
    last = table.column("date")[min(WARMUP_DAYS, table.num_rows) - 1].as_py() if table.num_rows else None
    if last is not None and last >= val_start:
        raise ValueError("warm-up reaches the validation split")
    designs = [design[WARMUP_DAYS:] for design in _design(table, y)]
    table = table.slice(WARMUP_DAYS)
    # by date, so the training rows are one run
    places = np.flatnonzero(pc.equal(table.column("split"), "train").to_numpy())
    n = len(places)
    if not n:
        return None
    grams = np.stack([products_of(design[places[0] : places[-1] + 1]) for design in designs])
    best: dict[int, tuple] = {}
    for orders in ORDERS_BY_SIZE:
        places = np.array([order_columns(*order) for order in orders])
        left = grams[:, places[:, :, None], places[:, None, :]].reshape(-1, places.shape[1], places.shape[1])
        right = grams[:, places, -1].reshape(len(left), -1)
        scale = np.sqrt(np.maximum(np.diagonal(left, axis1=1, axis2=2), 1e-12))
        inverse = np.linalg.pinv(left / (scale[:, :, None] * scale[:, None, :]), rcond=1e-10, hermitian=True)
        solved = (inverse @ (right / scale)[:, :, None])[:, :, 0] / scale
        rss = np.maximum(np.repeat(grams[:, -1, -1], len(orders)) - (solved * right).sum(axis=1), 1e-9)
        aic = n * np.log(rss / n) + 2 * places.shape[1]
        for i, (unit, order) in enumerate(product(range(len(DIFFERENCINGS)), orders)):
            if unit not in best or (aic[i], order) < best[unit][:2]:
                best[unit] = (aic[i], order, rss[i], places[i % len(orders)], solved[i])
    unit = min(best, key=lambda u: (best[u][2], *DIFFERENCINGS[u]))
    aic, (p, sp), rss, used, solved = best[unit]
    beta = np.zeros(grams.shape[1] - 1)
    beta[used] = solved
    d, sd = DIFFERENCINGS[unit]
    chosen = {"d": d, "sd": sd, "p": p, "sp": sp, "n": n, "rss": float(rss), "aic": float(aic), "beta": beta.tolist()}
    x, z = designs[unit][:, :-1], designs[unit][:, -1]
    past = table.column(y).to_numpy(zero_copy_only=False).astype(float) - z
    return table, chosen, x @ beta + past


def seasonal_arx(
    panel: DataFrame, days: DataFrame, span: Span, bounds: SplitBounds, y: str = "total"
) -> tuple[DataFrame, DataFrame]:
    """Orders chosen on the training rows, and the forecasts of every row after the warm-up.

    A fit reads the rows of its series alone, at most one a day, so each series is one group: neither
    the differencings of a row nor its regressors are stored or shuffled.
    """
    rows = attach_calendar(label_split(panel, bounds), regressor_days(days), span)
    kinds, val_start = dict(panel.dtypes), bounds.val[0]
    fields = "d int, sd int, p int, sp int, n bigint, rss double, aic double, beta array<double>"
    types = [pa.int32()] * 4 + [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    wanted = pa.schema(list(zip([f.split()[0] for f in fields.split(", ")], types)))

    def choose(table: pa.Table) -> pa.Table:
        found = _fit_series(table, y, val_start)
        chosen = [] if found is None else [{c: found[1][c] for c in wanted.names}]
        own = table.select(["series_id"]).slice(0, len(chosen))
        return pa.Table.from_arrays([*own.columns, *pa.Table.from_pylist(chosen, wanted).columns], ["series_id", *wanted.names])

    def predict(table: pa.Table) -> pa.Table:
        found = _fit_series(table, y, val_start)
        kept = ["series_id", "date", "split", y]
        if found is None:
            return table.select(kept).slice(0, 0).append_column("seasonal_arx", pa.array([], pa.float64()))
        return found[0].select(kept).append_column("seasonal_arx", pa.array(found[2], from_pandas=True))

    orders = rows.groupBy("series_id").applyInArrow(choose, f"series_id {kinds['series_id']}, {fields}")
    known = rows.where("series_id IS NOT NULL").groupBy("series_id")
    schema = f"series_id {kinds['series_id']}, date date, split string, {y} {kinds[y]}, seasonal_arx double"
    return orders, known.applyInArrow(predict, schema)
