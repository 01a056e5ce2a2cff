"""Forecast-error aggregates. A pair with a missing side does not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error(y: Column, p: Column) -> Column:
    """Truth minus prediction as a double; null if either side is."""
    return y.cast("double") - p.cast("double")


def n_pairs(y: Column, p: Column) -> Column:
    return F.count(error(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(error(y, p)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(error(y, p) * error(y, p)))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error over the rows whose truth is not zero."""
    return F.avg(F.abs(F.try_divide(error(y, p), y.cast("double")))) * 100.0


def r2(y: Column, p: Column) -> Column:
    """Share of the variance explained; null where the truth is constant."""
    seen = F.when(error(y, p).isNotNull(), y.cast("double"))
    total = F.var_pop(seen) * F.count(seen)
    return F.lit(1.0) - F.sum(error(y, p) * error(y, p)) / F.nullif(total, F.lit(0.0))


def metric_columns(y: str = "y_true", p: str = "y_pred", tag: str = "") -> list[Column]:
    """n, MAE, RMSE, MAPE and R2 of one prediction column, to be put in a single ``agg``."""
    truth, pred = F.col(y), F.col(p)
    return [
        n_pairs(truth, pred).alias(f"n{tag}"),
        mae(truth, pred).alias(f"MAE{tag}"),
        rmse(truth, pred).alias(f"RMSE{tag}"),
        mape(truth, pred).alias(f"MAPE{tag}"),
        r2(truth, pred).alias(f"R2{tag}"),
    ]
