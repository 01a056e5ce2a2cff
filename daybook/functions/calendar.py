"""Calendar and seasonal column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.constants import (
    DAY_TYPES,
    FOURIER_EPOCH,
    FOURIER_TERMS,
    HOLIDAY_TYPES,
    PREFIX,
    WEEKDAYS_ES,
    WEEKEND_DAY_TYPES,
    WORKING_DAY,
)
from daybook.functions.text import slug


def one_hot(column: str, levels: list[str]) -> list[Column]:
    """A 0/1 column for every declared level, seen or not."""
    return [
        F.coalesce((F.col(column) == level).cast("int"), F.lit(0)).alias(
            f"{PREFIX}{column}_{slug(level)}"
        )
        for level in levels
    ]


def is_weekend() -> Column:
    """1 on the day types that count as weekend."""
    return F.col("day_type").isin(WEEKEND_DAY_TYPES).cast("int").alias(f"{PREFIX}is_weekend")


def is_working() -> Column:
    return F.col("day_type") == WORKING_DAY


def weekday_es(column: str = "date") -> Column:
    """Unaccented Spanish weekday name."""
    names = F.array(*[F.lit(n) for n in WEEKDAYS_ES])
    return F.element_at(names, F.weekday(column) + 1)


def day_index(column: str = "date") -> Column:
    """Whole days since the fixed epoch; negative before it."""
    return F.datediff(F.col(column), F.to_date(F.lit(FOURIER_EPOCH)))


def fourier(column: str = "date") -> list[Column]:
    """Sine and cosine of each seasonal term, a function of the date alone."""
    terms = []
    for label, period, k in FOURIER_TERMS:
        angle = day_index(column) * F.lit(2.0 * math.pi * k / period)
        stem = f"{PREFIX}fourier_{label}_k{k}"
        terms += [F.sin(angle).alias(f"{stem}_sin"), F.cos(angle).alias(f"{stem}_cos")]
    return terms


def calendar_names() -> list[str]:
    """Names of the eleven calendar features, in order."""
    days = [f"{PREFIX}day_type_{slug(v)}" for v in DAY_TYPES]
    holidays = [f"{PREFIX}holiday_type_{slug(v)}" for v in HOLIDAY_TYPES]
    return [*days, *holidays, f"{PREFIX}is_weekend", f"{PREFIX}is_bridge_day"]


def fourier_names() -> list[str]:
    """Names of the Fourier features, in order."""
    return [
        f"{PREFIX}fourier_{label}_k{k}_{part}"
        for label, _, k in FOURIER_TERMS
        for part in ("sin", "cos")
    ]
