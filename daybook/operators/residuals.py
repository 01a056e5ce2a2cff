"""Residuals by calendar group, weekday and month.

Exact medians and quartiles are taken within one series only, where the number of rows is
bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import HOLIDAY_TYPES, NO_HOLIDAY, PREFIX
from daybook.functions import scoring
from daybook.functions.text import slug
from daybook.operators.features import one_hot_label
from daybook.operators.panel import KEYS
from daybook.operators.scores import day_type_breakdown

NOT_A_HOLIDAY = "none (not a holiday)"


def with_residual(predictions: DataFrame) -> DataFrame:
    """Truth minus prediction, beside its absolute value and percentage."""
    gap = scoring.error(F.col("y_true"), F.col("y_pred"))
    return predictions.withColumns(
        {
            "residual": gap,
            "abs_residual": F.abs(gap),
            "abs_pct_error": F.abs(F.try_divide(gap, F.col("y_true"))) * 100.0,
        }
    )


def stage1_residuals(predictions: DataFrame, splits: list[str] = ["val", "test"]) -> DataFrame:
    """Residuals of one model over contiguous evaluation splits."""
    chosen = predictions.where(F.col("split").isin(list(splits)))
    return with_residual(chosen).select(*KEYS, "split", "y_true", "y_pred", "residual")


def oof_residuals(oof: DataFrame, excluded_fold: int) -> DataFrame:
    """Residuals of the held-out training rows outside one fold."""
    chosen = oof.where(F.col("has_oof") & (F.col("fold") != excluded_fold))
    gap = scoring.error(F.col("y_true"), F.col("y_pred"))
    return chosen.select(*KEYS, "fold", "y_true", "y_pred", gap.alias("residual"))


def holiday_label() -> Column:
    """Readable holiday type from its one-hot columns."""
    labels = {
        f"{PREFIX}holiday_type_{slug(v)}": slug(v).replace("_", " ")
        for v in HOLIDAY_TYPES
        if v != NO_HOLIDAY
    }
    return one_hot_label(labels, NOT_A_HOLIDAY)


def residual_summary(rows: DataFrame) -> DataFrame:
    """Error statistics per series for four groupings at once.

    Each row carries its label in every grouping, so the groupings share one shuffle.
    """
    bridge = F.col("feat_is_bridge_day") == 1
    kind = F.when(bridge, "laborable, bridge day").otherwise("laborable, ordinary")
    groupings = {
        "day_type": F.col("day_type"),
        "bridge_day": F.when(bridge, "bridge day (puente)").otherwise("not bridge day"),
        "holiday_type": holiday_label(),
        "laborable_subset": F.when(F.col("day_type") == "laborable", kind),
    }
    labels = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), label.alias("group"))
            for name, label in groupings.items()
        ]
    )
    spread = with_residual(rows).withColumn("g", F.explode(labels)).where("g.group is not null")
    return spread.groupBy("series_id", "g.dimension", "g.group").agg(
        F.count("abs_residual").alias("n"),
        F.avg("abs_residual").alias("mean_abs_error"),
        F.median("abs_residual").alias("median_abs_error"),
        F.avg("abs_pct_error").alias("mean_abs_pct"),
        F.avg("residual").alias("mean_signed_bias"),
    )


def bridge_ratio(rows: DataFrame, by: list[str]) -> DataFrame:
    """Error of bridge days and of holidays against ordinary working days."""
    working, bridge = F.col("day_type") == "laborable", F.col("feat_is_bridge_day") == 1
    gap = F.abs(scoring.error(F.col("y_true"), F.col("y_pred")))
    means = rows.groupBy(*by).agg(
        F.avg(F.when(working & bridge, gap)).alias("mae_bridge"),
        F.avg(F.when(working & ~bridge, gap)).alias("mae_ordinary"),
        F.avg(F.when(F.col("day_type") == "festivo", gap)).alias("mae_holiday"),
    )
    return means.withColumns(
        {
            "bridge_ratio": F.try_divide(F.col("mae_bridge"), F.col("mae_ordinary")),
            "holiday_ratio": F.try_divide(F.col("mae_holiday"), F.col("mae_ordinary")),
        }
    )


def calendar_group_residuals(rows: DataFrame) -> DataFrame:
    """Mean absolute residual by day group and by holiday type, per series."""
    day = day_type_breakdown(rows, ["series_id"]).select(
        "series_id",
        F.lit("day_type").alias("dimension"),
        "group",
        "n",
        F.col("MAE").alias("mean_abs_residual"),
        F.col("MAPE").alias("mean_abs_pct"),
    )
    kinds = with_residual(rows).groupBy("series_id", holiday_label().alias("group"))
    holiday = kinds.agg(
        F.count("abs_residual").alias("n"),
        F.avg("abs_residual").alias("mean_abs_residual"),
        F.avg("abs_pct_error").alias("mean_abs_pct"),
    ).withColumn("dimension", F.lit("holiday_type"))
    return day.unionByName(holiday)


def weekday_profile(rows: DataFrame) -> DataFrame:
    """Residual statistics by weekday, with the mean as a share of the series deviation.

    The deviation of the whole series is put together from the weekday moments.
    """
    days = rows.groupBy("series_id", "weekday_es").agg(
        F.count("residual").alias("n"),
        F.avg("residual").alias("mean_residual"),
        F.median("residual").alias("median_residual"),
        F.stddev_samp("residual").alias("sd"),
        F.avg(F.abs("residual")).alias("mean_abs_residual"),
        F.var_pop("residual").alias("_var"),
    )
    w = Window.partitionBy("series_id")
    total = F.sum("n").over(w)
    centre = F.sum(F.col("n") * F.col("mean_residual")).over(w) / total
    days = days.withColumns({"_total": total, "_centre": centre})
    shift = F.col("mean_residual") - F.col("_centre")
    squares = F.sum(F.col("n") * (F.col("_var") + shift * shift)).over(w)
    sigma = F.sqrt(F.try_divide(squares, F.col("_total") - 1))
    return days.select(
        "series_id",
        "weekday_es",
        "n",
        "mean_residual",
        "median_residual",
        "sd",
        "mean_abs_residual",
        F.coalesce(F.try_divide(F.col("mean_residual"), sigma), F.lit(0.0)).alias("mean_over_sigma"),
        (F.col("sd") / F.sqrt("n")).alias("standard_error"),
    )


def monthly_seasonality(panel: DataFrame, column: str = "total") -> DataFrame:
    """Mean and deviation of the target by month of the year; absent months stay, with nulls."""
    months = range(1, 13)
    value = {m: F.when(F.month("date") == m, F.col(column)) for m in months}
    wide = panel.groupBy("series_id").agg(
        *[F.avg(value[m]).alias(f"mean_{m}") for m in months],
        *[F.stddev_samp(value[m]).alias(f"sd_{m}") for m in months],
        *[F.count(value[m]).alias(f"n_{m}") for m in months],
    )
    rows = [
        F.struct(
            F.lit(m).cast("long").alias("month"),
            F.col(f"n_{m}").alias("n"),
            F.col(f"mean_{m}").alias("mean"),
            F.col(f"sd_{m}").alias("sd"),
        )
        for m in months
    ]
    return wide.select("series_id", F.explode(F.array(*rows)).alias("r")).select("series_id", "r.*")


def weekday_distribution(panel: DataFrame, column: str = "total") -> DataFrame:
    """Box statistics of the target by weekday, per series."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = panel.groupBy("series_id", "weekday_es").agg(
        F.count(column).alias("n"),
        F.min(column).cast("double").alias("low"),
        quartiles.alias("q"),
        F.max(column).cast("double").alias("high"),
        F.avg(column).alias("mean"),
    )
    named = {name: F.col("q")[i] for i, name in enumerate(["q1", "median", "q3"])}
    return boxes.withColumns(named).drop("q")


def residual_histogram(
    predictions: DataFrame, by: list[str], bins: int = 40, salts: int = 32
) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest residual of a group.

    The groups are few and large, so the join with their ranges is salted: the small side is
    repeated per salt, and no task gets a whole group.
    """
    salt = F.pmod(F.xxhash64(*predictions.columns), F.lit(salts)).alias("_salt")
    rows = with_residual(predictions).where("residual is not null").select(*by, "residual", salt)
    ranges = rows.groupBy(*by).agg(F.min("residual").alias("low"), F.max("residual").alias("high"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt")
    joined = rows.join(ranges.select("*", every), [*by, "_salt"])
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(
        F.floor(F.try_divide(F.col("residual") - F.col("low"), width)), F.lit(0)
    )
    binned = joined.withColumn("bin", F.least(F.lit(bins), place + 1).cast("long"))
    return binned.groupBy(*by, "bin", "low", "high").agg(F.count("*").alias("n"))


def train_error_ratio(predictions: DataFrame, by: list[str]) -> DataFrame:
    """MAE of validation and test as multiples of the training MAE."""
    gap = F.abs(scoring.error(F.col("y_true"), F.col("y_pred")))
    means = predictions.groupBy(*by).agg(
        *[F.avg(F.when(F.col("split") == s, gap)).alias(f"mae_{s}") for s in ("train", "val", "test")]
    )
    return means.withColumns(
        {f"{s}_over_train": F.try_divide(F.col(f"mae_{s}"), F.col("mae_train")) for s in ("val", "test")}
    )


def error_correlation(wide: DataFrame, model_a: str, model_b: str, by: list[str], y: str = "total") -> DataFrame:
    """Pearson correlation of the errors of two models."""
    errors = [scoring.error(F.col(y), F.col(m)) for m in (model_a, model_b)]
    return wide.groupBy(*by).agg(F.count(errors[0] + errors[1]).alias("n"), F.corr(*errors).alias("corr"))
