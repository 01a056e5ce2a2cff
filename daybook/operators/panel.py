"""Building the daily panel: aggregation, densification, calendar joins and part sums.

A series holds at most one row per day, so every window over ``series_id`` is bounded by the
length of the calendar, however many raw rows one series owns: those are pre-aggregated
map-side by ``(series_id, date)`` before any shuffle on the series.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import NO_HOLIDAY
from daybook.functions.calendar import is_working
from daybook.session import small_side, stored_if_sound

KEYS = ["series_id", "date"]


def by_series() -> Window:
    """The window all history-dependent operators share, so they plan as one sort."""
    return Window.partitionBy("series_id").orderBy("date")


@dataclass(frozen=True)
class Span:
    """First and last day of a panel; the only facts about it the driver ever holds."""

    start: dt.date
    end: dt.date

    @property
    def n_days(self) -> int:
        return (self.end - self.start).days + 1


def date_span(df: DataFrame) -> Span:
    """First and last date of a frame, from one column and one row of result."""
    low, high = df.agg(F.min("date"), F.max("date")).first()
    if low is None:
        raise ValueError("date_span: no dated rows")
    return Span(low, high)


def part_total(parts: list[str]) -> Column:
    """The sum of the part columns of a row."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in parts])


def daily_panel(
    events: DataFrame, part_column: str, levels: dict[str, object], value: str | None = None
) -> DataFrame:
    """Aggregate raw rows into ``series_id, date, <parts>, total``, one row per active day.

    ``levels`` maps each part name to the value of ``part_column`` it counts. Partial sums run
    before the shuffle, so a hot series costs one row per day and map task.
    """
    measure = F.col(value) if value else F.lit(1)
    parts = [
        F.sum(F.when(F.col(part_column) == level, measure)).alias(name)
        for name, level in levels.items()
    ]
    sums = events.groupBy(*KEYS).agg(*parts, F.sum(measure).alias("total"))
    whole = [
        F.coalesce(F.bround(F.col(c)).cast("long"), F.lit(0).cast("long")).alias(c)
        for c in [*levels, "total"]
    ]
    return sums.select(*KEYS, *whole)


def citywide(panel: DataFrame, values: list[str]) -> DataFrame:
    """The panel summed over series; one row per day under ``series_id`` -1."""
    total = panel.groupBy("date").agg(*[F.sum(c).alias(c) for c in values])
    return total.select(F.lit(-1).cast("long").alias("series_id"), "date", *values)


def densify(panel: DataFrame, span: Span, values: list[str], fill: int | float = 0) -> DataFrame:
    """One row per series and day of ``span``; days without a row get ``fill``.

    Each row is expanded over the empty days up to the next one of its series, so the fill
    needs no scaffold join, and the result stays partitioned by series for later windows.
    """
    w = by_series()
    first_day = F.when(F.lag("date").over(w).isNull(), F.lit(span.start)).otherwise(F.col("date"))
    last_day = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.lit(span.end))
    runs = panel.select(
        "series_id",
        F.col("date").alias("seen"),
        *values,
        F.sequence(first_day, last_day, F.expr("interval 1 day")).alias("days"),
    )
    # The outer form keeps Catalyst from adding a filter that evaluates the sequence again.
    days = runs.select("series_id", "seen", *values, F.explode_outer("days").alias("date"))
    on_day = F.col("date") == F.col("seen")
    kept = [
        F.when(on_day, F.col(c)).otherwise(F.lit(fill).cast(panel.schema[c].dataType)).alias(c)
        for c in values
    ]
    return days.select("series_id", "date", *kept)


def fill_sentinel(df: DataFrame, columns: list[str]) -> DataFrame:
    """Write the no-holiday level where a holiday column is null."""
    return df.na.fill({c: NO_HOLIDAY for c in columns})


def unify_sources(panel: DataFrame, exog: DataFrame, calendar: DataFrame, span: Span) -> DataFrame:
    """Inner-join the panel with the exogenous and calendar tables, both keyed by date.

    The two date tables have at most ``span.n_days`` rows, which decides on the broadcast.
    """
    joined = panel.join(small_side(exog, span.n_days), "date", "inner").join(
        small_side(calendar, span.n_days), "date", "inner"
    )
    lead = [*KEYS, *[c for c in panel.columns if c not in KEYS]]
    rest = [c for c in joined.columns if c not in lead]
    holidays = [c for c in ("holiday_type", "holiday_name") if c in joined.columns]
    return fill_sentinel(joined.select(*lead, *rest), holidays)


def unify_checked(
    panel: DataFrame, exog: DataFrame, calendar: DataFrame, span: Span, name: str = "unified"
) -> DataFrame:
    """The unified panel as a stored stage, or an error that names what an inner join would hide.

    Days of the panel that a date table lacks, repeated or missing days of a series and nulls are
    counted while the stage is written. Days of a date table outside the panel are counted on that
    table, which has at most ``span.n_days`` rows.
    """
    sources = {"exogenous": exog, "calendar": calendar}
    outside = {
        f"{label} days outside the panel": frame.where(~F.col("date").between(F.lit(span.start), F.lit(span.end))).count()
        for label, frame in sources.items()
    }
    if any(outside.values()):
        raise ValueError(f"{name}: {outside}")
    joined = panel
    for label, frame in sources.items():
        joined = joined.join(small_side(frame.withColumn(f"_{label}", F.lit(True)), span.n_days), "date", "left")
    before = F.lag("date").over(by_series())
    steps = joined.withColumn("_step", F.datediff("date", before))
    first = F.when(before.isNull(), F.datediff("date", F.lit(span.start)))
    steps = steps.withColumn("_late", F.coalesce(first, F.lit(0)))
    last = F.lead("date").over(by_series()).isNull() & (F.col("date") < F.lit(span.end))
    steps = steps.withColumn("_short", last)
    kept = [*KEYS, *[c for c in panel.columns if c not in KEYS]]
    kept += [c for frame in sources.values() for c in frame.columns if c not in kept]
    holidays = [c for c in ("holiday_type", "holiday_name") if c in kept]
    filled = fill_sentinel(steps, holidays)
    checks = {f"rows without {label} data": F.count_if(F.col(f"_{label}").isNull()) for label in sources}
    checks["repeated days"] = F.count_if(F.col("_step") == 0)
    checks["gaps"] = F.count_if((F.col("_step") > 1) | (F.col("_late") > 0) | F.col("_short"))
    for c in kept:
        source = next((label for label, frame in sources.items() if c in frame.columns and c != "date"), None)
        present = F.col(f"_{source}").isNotNull() if source else F.lit(True)
        checks[f"nulls in {c}"] = F.count_if(F.col(c).isNull() & present)
    return stored_if_sound(filled, checks, name).select(*kept)


def attach_features(predictions: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Left-join feature columns onto predictions by series and date."""
    return predictions.join(features.select(*KEYS, *columns), KEYS, "left")


def attach_calendar(df: DataFrame, calendar: DataFrame, span: Span) -> DataFrame:
    """Left-join date-level columns, broadcast when the calendar is short enough."""
    return df.join(small_side(calendar, span.n_days), "date", "left")


def near_dates(df: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` of an anchor date.

    The anchors are spread over their neighbourhood, which turns the range condition into an
    equality and leaves a semi-join on the date.
    """
    spread = anchors.select(
        F.explode(
            F.sequence(F.date_sub("date", days), F.date_add("date", days), F.expr("interval 1 day"))
        ).alias("date")
    )
    return df.join(spread, "date", "left_semi")


def bridge_days(calendar: DataFrame) -> DataFrame:
    """Flag working days next to a holiday on the date dimension; edges see no holiday."""
    w = Window.partitionBy("calendar_id").orderBy("date")
    flagged = calendar.withColumn("_holiday", F.col("day_type").isin("festivo", "domingo festivo"))
    beside = F.lag("_holiday", 1, False).over(w) | F.lead("_holiday", 1, False).over(w)
    return flagged.withColumn("feat_is_bridge_day", (is_working() & beside).cast("int")).drop(
        "_holiday"
    )
