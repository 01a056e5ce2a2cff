"""Panels, calendar and exogenous table derived from the order tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import HOLIDAY_TYPES, NO_HOLIDAY
from daybook.functions.calendar import weekday_es
from daybook.operators import panel as P
from daybook.operators.panel import Span
from daybook.operators.splits import SplitBounds, split_span
from daybook.session import small_side

PARTS = ["part_a", "part_n", "part_r"]
VALUES = [*PARTS, "total"]
EXOG = ["discount_mean", "tax_mean", "price_mean", "quantity_max"]
BASELINES = ["persistence", "seasonal_naive", "moving_average_7", "moving_average_28"]
ENSEMBLES = ["ensemble_equal", "ensemble_inverse_mae"]
MODELS = [*BASELINES, *ENSEMBLES]
ENSEMBLE_MEMBERS = ["seasonal_naive", "moving_average_28"]

# Public holidays with a fixed day, as (month, day, type, name).
FIXED_HOLIDAYS = [
    (1, 1, HOLIDAY_TYPES[1], "Año Nuevo"),
    (1, 6, HOLIDAY_TYPES[1], "Epifanía del Señor"),
    (5, 1, HOLIDAY_TYPES[1], "Fiesta del Trabajo"),
    (5, 2, HOLIDAY_TYPES[2], "Fiesta de la Comunidad de Madrid"),
    (5, 15, HOLIDAY_TYPES[3], "San Isidro"),
    (8, 15, HOLIDAY_TYPES[1], "Asunción de la Virgen"),
    (10, 12, HOLIDAY_TYPES[1], "Fiesta Nacional de España"),
    (11, 1, HOLIDAY_TYPES[1], "Todos los Santos"),
    (11, 9, HOLIDAY_TYPES[3], "Almudena"),
    (12, 6, HOLIDAY_TYPES[1], "Día de la Constitución"),
    (12, 8, HOLIDAY_TYPES[1], "Inmaculada Concepción"),
    (12, 25, HOLIDAY_TYPES[1], "Natividad del Señor"),
]
# Days before Easter Sunday of the movable holidays.
MOVABLE_HOLIDAYS = [
    (3, HOLIDAY_TYPES[2], "Jueves Santo"),
    (2, HOLIDAY_TYPES[1], "Viernes Santo"),
]


def easter(year: int) -> dt.date:
    """Easter Sunday by the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    shift = h + week - 7 * ((a + 11 * h + 22 * week) // 451) + 114
    return dt.date(year, shift // 31, shift % 31 + 1)


def holidays(first_year: int, last_year: int) -> list[tuple[dt.date, str, str]]:
    """Holidays of a range of years as (date, type, name)."""
    out = []
    for year in range(first_year, last_year + 1):
        out += [(dt.date(year, m, d), kind, name) for m, d, kind, name in FIXED_HOLIDAYS]
        out += [
            (easter(year) - dt.timedelta(days=back), kind, name)
            for back, kind, name in MOVABLE_HOLIDAYS
        ]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw demand events: series, date, category and quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("series_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        "l_returnflag",
        "l_quantity",
    )


def line_span(spark: SparkSession, sf_dir: str) -> Span:
    """Days covered by the line items, read from their date column alone."""
    return P.date_span(line_events(spark, sf_dir))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active days of every supplier, parts by return flag."""
    levels = {"part_a": "A", "part_n": "N", "part_r": "R"}
    return P.daily_panel(line_events(spark, sf_dir), "l_returnflag", levels, "l_quantity")


def panel(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """Every supplier on every day."""
    span = span or line_span(spark, sf_dir)
    return P.densify(sparse_panel(spark, sf_dir), span, VALUES)


def city(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """All suppliers together, one row per day."""
    span = span or line_span(spark, sf_dir)
    return P.densify(P.citywide(sparse_panel(spark, sf_dir), VALUES), span, VALUES)


def exog(spark: SparkSession, sf_dir: str, span: Span) -> DataFrame:
    """Daily averages of line-item attributes, in the role of the weather.

    Money and rates are summed as whole hundredths, so the result does not depend on order.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.bround(F.col("l_discount") * 100).cast("long").alias("discount"),
        F.bround(F.col("l_tax") * 100).cast("long").alias("tax"),
        F.bround(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        "l_quantity",
    )
    daily = lines.groupBy("date").agg(
        *[
            (F.sum(c).cast("double") / F.count("*") / 100.0).alias(f"{c}_mean")
            for c in ("discount", "tax", "price")
        ],
        F.max("l_quantity").cast("double").alias("quantity_max"),
    )
    station = daily.select(F.lit(0).cast("long").alias("series_id"), "date", *EXOG)
    return P.densify(station, span, EXOG)


def calendar(spark: SparkSession, span: Span) -> DataFrame:
    """The date dimension: weekday, day type and holiday of every day of the span."""
    rows = holidays(span.start.year, span.end.year)
    named = spark.createDataFrame(rows, "date date, holiday_type string, holiday_name string")
    days = spark.range(span.n_days).select(
        F.date_add(F.lit(span.start), F.col("id").cast("int")).alias("date")
    )
    joined = days.join(small_side(named, len(rows)), "date", "left")
    holiday = F.col("holiday_name").isNotNull()
    weekday = F.weekday("date")
    day_type = (
        F.when(holiday & (weekday == 6), "domingo festivo")
        .when(holiday, "festivo")
        .when(weekday == 6, "domingo")
        .when(weekday == 5, "sabado")
        .otherwise("laborable")
    )
    return joined.select(
        F.lit("default").alias("calendar_id"),
        "date",
        weekday_es().alias("weekday_es"),
        day_type.alias("day_type"),
        F.coalesce("holiday_type", F.lit(NO_HOLIDAY)).alias("holiday_type"),
        F.coalesce("holiday_name", F.lit(NO_HOLIDAY)).alias("holiday_name"),
    )


def raw_calendar(spark: SparkSession, span: Span) -> DataFrame:
    """The calendar before the sentinel: holiday columns null on ordinary days."""
    cal = calendar(spark, span)
    return cal.withColumns(
        {c: F.nullif(F.col(c), F.lit(NO_HOLIDAY)) for c in ("holiday_type", "holiday_name")}
    )


def order_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Orders per nation and day, parts by priority; the second panel."""
    levels = {
        "part_urgent": "1-URGENT",
        "part_high": "2-HIGH",
        "part_medium": "3-MEDIUM",
        "part_not_specified": "4-NOT SPECIFIED",
        "part_low": "5-LOW",
    }
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority"
    )
    events = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_nationkey").cast("long").alias("series_id"), "date", "o_orderpriority"
    )
    return P.daily_panel(events, "o_orderpriority", levels), list(levels)


def bounds(span: Span) -> SplitBounds:
    return split_span(span)
