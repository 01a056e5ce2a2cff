"""Leakage-free features: lags, shifted rolling statistics, calendar and Fourier columns.

Rows t-w..t-1 feed every history feature, never row t. All expressions over one series use the
same window specification, so Catalyst plans one sort and one window pass per panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import (
    DAY_TYPES,
    EXOG_LAGS,
    EXOG_WINDOW,
    FOURIER_TERMS,
    HOLIDAY_TYPES,
    PREFIX,
    ROLLING_WINDOWS,
    SEQUENCE_WINDOW,
    TARGET_LAGS,
)
from daybook.functions.calendar import calendar_names, fourier, fourier_names, is_weekend, one_hot
from daybook.operators.guards import melt_row
from daybook.operators.panel import KEYS, Span, attach_calendar, bridge_days, by_series


def lag_columns(columns: list[str], lags: list[int] = TARGET_LAGS) -> list[Column]:
    """Value of each column n rows back, for every n."""
    w = by_series()
    return [
        F.lag(c, n).over(w).alias(f"{PREFIX}{c}_lag_{n}") for c in columns for n in lags
    ]


def trailing(column: str, width: int, stat: str) -> Column:
    """A statistic of the ``width`` rows before the current one; null until they exist."""
    frame = by_series().rowsBetween(-width, -1)
    value = {"mean": F.avg, "std": F.stddev_samp}[stat](column).over(frame)
    return F.when(F.count(column).over(frame) == width, value)


def rolling_columns(column: str = "total", widths: list[int] = ROLLING_WINDOWS) -> list[Column]:
    """Shifted mean and sample deviation for every window width."""
    return [
        trailing(column, width, stat).alias(f"{PREFIX}{column}_roll_{stat}_{width}")
        for width in widths
        for stat in ("mean", "std")
    ]


def exog_columns(variables: list[str]) -> list[Column]:
    """Lags and shifted weekly mean of each exogenous variable; never its same-day value."""
    means = [
        trailing(v, EXOG_WINDOW, "mean").alias(f"{PREFIX}{v}_roll_mean_{EXOG_WINDOW}")
        for v in variables
    ]
    return [*lag_columns(variables, EXOG_LAGS), *means]


def lag_features(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Keys and the lags of the target and its parts."""
    return panel.select(*KEYS, *lag_columns(columns))


def rolling_features(panel: DataFrame) -> DataFrame:
    """Keys and the shifted rolling statistics of the target."""
    return panel.select(*KEYS, *rolling_columns())


def exog_features(exog: DataFrame, variables: list[str]) -> DataFrame:
    """Dates and lagged exogenous features, over a table with one row per day.

    The exogenous table names its station in ``series_id`` and is as long as the calendar.
    """
    return exog.select("date", *exog_columns(variables))


def rolling_by_date(panel: DataFrame, width: int, column: str = "total") -> DataFrame:
    """Mean and row count over the ``width`` calendar days before each row, gaps or not."""
    frame = (
        Window.partitionBy("series_id")
        .orderBy(F.unix_date("date"))
        .rangeBetween(-width, -1)
    )
    return panel.select(
        *KEYS,
        F.avg(column).over(frame).alias(f"{column}_mean_{width}d"),
        F.count(column).over(frame).alias(f"n_{width}d"),
    )


def calendar_features(calendar: DataFrame) -> DataFrame:
    """One-hots, weekend and bridge flags on the date dimension."""
    return bridge_days(calendar).select(
        "date",
        *one_hot("day_type", DAY_TYPES),
        *one_hot("holiday_type", HOLIDAY_TYPES),
        is_weekend(),
        "feat_is_bridge_day",
    )


def fourier_features(calendar: DataFrame) -> DataFrame:
    """Seasonal terms on the date dimension."""
    return calendar.select("date", *fourier())


def date_features(calendar: DataFrame) -> DataFrame:
    """Calendar levels, one-hots, flags and seasonal terms, one row per date."""
    return bridge_days(calendar).select(
        "date",
        "weekday_es",
        "day_type",
        "holiday_type",
        "holiday_name",
        *one_hot("day_type", DAY_TYPES),
        *one_hot("holiday_type", HOLIDAY_TYPES),
        is_weekend(),
        "feat_is_bridge_day",
        *fourier(),
    )


def build_features(
    panel: DataFrame,
    calendar: DataFrame,
    exog: DataFrame,
    parts: list[str],
    variables: list[str],
    span: Span,
) -> DataFrame:
    """The full feature table, one row per panel row, warm-up nulls left in place.

    Date-level blocks are computed once per day and joined; the panel itself is sorted once.
    """
    history = panel.select(
        *KEYS, "total", *parts, *lag_columns(["total", *parts]), *rolling_columns()
    )
    with_days = attach_calendar(history, date_features(calendar), span)
    return attach_calendar(with_days, exog_features(exog, variables), span)


def feature_names(df: DataFrame) -> list[str]:
    """The model matrix: every column with the feature prefix."""
    return [c for c in df.columns if c.startswith(PREFIX)]


def declared_groups(parts: list[str], variables: list[str]) -> dict[str, str]:
    """Group of every feature that the builders of this module make, by name."""

    def lags(columns: list[str], steps: list[int]) -> list[str]:
        return [f"{PREFIX}{c}_lag_{n}" for c in columns for n in steps]

    labels = [label for label, *_ in FOURIER_TERMS for _ in ("sin", "cos")]
    seasonal = list(zip(fourier_names(), labels))
    made = {
        "fourier_weekly": [n for n, label in seasonal if label == "weekly"],
        "fourier_annual": [n for n, label in seasonal if label == "annual"],
        "calendar": calendar_names(),
        "lag_total": lags(["total"], TARGET_LAGS),
        "rolling": [f"{PREFIX}total_roll_{stat}_{w}" for w in ROLLING_WINDOWS for stat in ("mean", "std")],
        "lag_operator": lags(parts, TARGET_LAGS),
        "weather": [*lags(variables, EXOG_LAGS), *[f"{PREFIX}{v}_roll_mean_{EXOG_WINDOW}" for v in variables]],
    }
    return {name: group for group, names in made.items() for name in names}


def feature_group(name: str | Column, parts: list[str], variables: list[str]) -> Column:
    """Group of a feature name; null if no builder makes it, which callers treat as an error."""
    col = F.col(name) if isinstance(name, str) else name
    pairs = [F.lit(x) for pair in declared_groups(parts, variables).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def feature_report(features: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: nulls and first valid date; plus the first date with every feature valid."""
    days = F.unix_date("date")
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    row = features.agg(
        F.min(F.when(complete, F.col("date"))).alias("first_complete_date"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
        *[F.min(F.when(F.col(c).isNotNull(), days)).cast("long").alias(f"_d_{c}") for c in names],
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).alias("n_nulls"),
            F.date_from_unix_date(F.col(f"_d_{c}").cast("int")).alias("first_valid_date"),
        )
        for c in names
    ]
    return row.select("first_complete_date", F.explode(F.array(*entries)).alias("r")).select(
        "r.*", "first_complete_date"
    )


def sequence_windows(
    df: DataFrame, width: int = SEQUENCE_WINDOW, column: str = "total", keep_short: bool = False
) -> DataFrame:
    """The ``width`` values before each row as an array, and the row's position in its series.

    Rows without full history are left out unless ``keep_short`` is set.
    """
    w = by_series()
    rows = df.select(
        *df.columns,
        F.collect_list(column).over(w.rowsBetween(-width, -1)).alias("history"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
    )
    return rows if keep_short else rows.where(F.size("history") == width)


def usable_positions(panel: DataFrame, width: int = SEQUENCE_WINDOW) -> DataFrame:
    """Positions whose whole window exists."""
    rows = panel.select(*KEYS, (F.row_number().over(by_series()) - 1).cast("long").alias("pos"))
    return rows.where(F.col("pos") >= width)


def model_matrix(df: DataFrame, names: list[str], label: str = "total") -> DataFrame:
    """Keys, label and the chosen features as one vector column; a null feature is an error."""
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    cast = [F.col(c).cast("double").alias(c) for c in names]
    rest = [c for c in df.columns if c not in names and c != label]
    return assembler.transform(
        df.select(*rest, F.col(label).cast("double").alias(label), *cast)
    ).drop(*names)


def one_hot_label(columns: dict[str, str], default: str) -> Column:
    """Label of the one-hot column that is 1; ``default`` if none is."""
    picks = [F.when(F.col(c) == 1, F.lit(label)) for c, label in columns.items()]
    return F.coalesce(*picks, F.lit(default))


def melt(df: DataFrame, ids: list[str], columns: list[str], key: str, value: str) -> DataFrame:
    """Unpivot double columns."""
    return melt_row(df.select(*ids, *columns), columns, key, value, "double")
