"""Scalers fitted on training rows only and kept as a small parameter table per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax_fit(training: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column per series."""
    return training.groupBy("series_id").agg(
        *[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
        *[F.max(c).cast("double").alias(f"{c}_max") for c in columns],
    )


def standard_fit(training: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column per series."""
    return training.groupBy("series_id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )


def _safe(width: Column) -> Column:
    """A divisor: 1 for a constant column."""
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def _width(c: str) -> Column:
    return _safe(F.col(f"{c}_max") - F.col(f"{c}_min"))


def minmax_transform(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to the training range; values outside it are not clipped."""
    joined = df.join(scaler, "series_id")
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"{c}_min")) / _width(c) for c in columns}
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def minmax_inverse(df: DataFrame, scaler: DataFrame, column: str, scaled: str, out: str) -> DataFrame:
    """Bring a scaled column back to the units of ``column``."""
    joined = df.join(scaler, "series_id")
    value = F.col(scaled) * _width(column) + F.col(f"{column}_min")
    return joined.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


def standard_transform(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the training mean and deviation."""
    joined = df.join(scaler, "series_id")
    scaled = {
        f"{c}_scaled": (F.col(c) - F.col(f"{c}_mean")) / _safe(F.col(f"{c}_std")) for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns, *scaled)
