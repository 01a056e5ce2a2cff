"""Metric tables over tidy or wide predictions, and tables derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import FDR_Q, SMALL_SAMPLE
from daybook.functions import scoring
from daybook.operators.panel import KEYS, by_series

METRICS = ["MAE", "RMSE", "MAPE", "R2"]


def pair_filter(predictions: DataFrame) -> DataFrame:
    """Rows with both a truth and a prediction."""
    return predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def require_pairs(predictions: DataFrame) -> DataFrame:
    """The scored pairs; raises if there are none."""
    pairs = pair_filter(predictions)
    if pairs.isEmpty():
        raise ValueError("no observation pairs to score")
    return pairs


def all_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """n, MAE, RMSE, MAPE and R2 per group of tidy predictions, in one aggregate."""
    return predictions.groupBy(*by).agg(*scoring.metric_columns())


def wide_metrics(
    wide: DataFrame, models: list[str], by: list[str], y: str = "total", days: bool = False
) -> DataFrame:
    """The same table from a wide frame: one pass without multiplying the rows by the models.

    ``days`` adds ``n_days``, the dates with a truth. It is the one distinct count of the aggregate,
    so the sums are merged by group and date, whatever the number of series, before it is taken.
    """
    columns = [m for i, name in enumerate(models) for m in scoring.metric_columns(y, name, f"_{i}")]
    if days:
        columns.append(F.count_distinct(F.when(F.col(y).isNotNull(), F.col("date"))).alias("n_days"))
        by = [*by, "n_days"]
    return by_model(wide.groupBy(*[c for c in by if c != "n_days"]).agg(*columns), models, by)


def by_model(scored: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """One row per model from the numbered metric columns of a wide aggregate."""
    rows = [
        F.struct(
            F.lit(name).alias("model"),
            *[F.col(f"{m}_{i}").alias(m) for m in ["n", *METRICS]],
        )
        for i, name in enumerate(models)
    ]
    return scored.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def day_sums(wide: DataFrame, models: list[str], by: list[str], y: str = "total") -> DataFrame:
    """Sums of the errors of every model per group and date, from which the metrics of any union of groups follow.

    One aggregate over the rows; the result has at most days x groups rows, however many series there are.
    """
    truth = F.col(y).cast("double")
    columns = [F.count(y).alias("rows")]
    for i, model in enumerate(models):
        gap = scoring.error(F.col(y), F.col(model))
        seen = F.when(gap.isNotNull(), truth)
        share = F.abs(F.try_divide(gap, truth))
        columns += [
            F.count(gap).alias(f"n_{i}"),
            F.sum(F.abs(gap)).alias(f"abs_{i}"),
            F.sum(gap * gap).alias(f"sq_{i}"),
            F.count(share).alias(f"shares_{i}"),
            F.sum(share).alias(f"pct_{i}"),
            F.avg(seen).alias(f"mean_{i}"),
            (F.var_pop(seen) * F.count(seen)).alias(f"ss_{i}"),
            F.min(seen).alias(f"low_{i}"),
            F.max(seen).alias(f"high_{i}"),
        ]
    return wide.groupBy(*by, "date").agg(*columns)


def metrics_of_sums(sums: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """The table of ``wide_metrics`` with ``days``, from day sums: sums of squares are merged about the mean of the group."""
    group = Window.partitionBy(*by)
    centred = sums
    for i in range(len(models)):
        centre = F.sum(F.col(f"mean_{i}") * F.col(f"n_{i}")).over(group) / F.nullif(F.sum(f"n_{i}").over(group), F.lit(0))
        # means of one constant value may differ in the last digit
        constant = F.min(f"low_{i}").over(group) == F.max(f"high_{i}").over(group)
        away = F.when(constant, F.lit(0.0)).otherwise(F.col(f"mean_{i}") - centre)
        centred = centred.withColumn(f"total_{i}", F.col(f"ss_{i}") + F.col(f"n_{i}") * away * away)
    columns = [F.count_distinct(F.when(F.col("rows") > 0, F.col("date"))).alias("n_days")]
    for i in range(len(models)):
        n, sq = F.sum(f"n_{i}"), F.sum(f"sq_{i}")
        filled = F.nullif(n, F.lit(0))
        columns += [
            n.alias(f"n_{i}"),
            (F.sum(f"abs_{i}") / filled).alias(f"MAE_{i}"),
            F.sqrt(sq / filled).alias(f"RMSE_{i}"),
            (F.sum(f"pct_{i}") / F.nullif(F.sum(f"shares_{i}"), F.lit(0)) * 100.0).alias(f"MAPE_{i}"),
            (F.lit(1.0) - sq / F.nullif(F.sum(f"total_{i}"), F.lit(0.0))).alias(f"R2_{i}"),
        ]
    return by_model(centred.groupBy(*by).agg(*columns), models, [*by, "n_days"])


def single_metric(predictions: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """One metric (mae, rmse, mape or r2) per group."""
    value = getattr(scoring, metric)(F.col("y_true"), F.col("y_pred"))
    return predictions.groupBy(*by).agg(value.alias(metric))


def safe_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of groups of any size; what a small group leaves undefined is null."""
    return all_metrics(pair_filter(predictions), by)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A fixed map as a column; null for an unknown key."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def comparison_table(metrics: DataFrame, descriptions: dict[str, str], by: list[str]) -> DataFrame:
    """Metrics with a description and the position by descending R2 within each group."""
    order = Window.partitionBy(*by).orderBy(F.col("R2").desc_nulls_last(), "model")
    described = metrics.withColumns(
        {
            "description": F.coalesce(lookup(descriptions, F.col("model")), F.lit("")),
            "position": F.row_number().over(order).cast("long"),
        }
    )
    return described.select(*by, "position", "model", "description", "n", *METRICS)


def comparison_by_split(metrics: DataFrame, families: dict[str, str]) -> DataFrame:
    """Metrics per split and model with the model family."""
    family = F.coalesce(lookup(families, F.col("model")), F.lit("other"))
    return metrics.withColumn("family", family)


def day_groups() -> Column:
    """Day type of a row, and for working days also whether a holiday is next to it."""
    bridge = F.when(F.col("feat_is_bridge_day") == 1, "laborable, bridge day").otherwise(
        "laborable, ordinary"
    )
    return F.array_compact(
        F.array(F.col("day_type"), F.when(F.col("day_type") == "laborable", bridge))
    )


def day_type_breakdown(predictions: DataFrame, by: list[str]) -> DataFrame:
    """n, MAE and MAPE per day type and for the two kinds of working day, which overlap it.

    Rows take part in at most two groups, so they are spread before one aggregate. Groups of few
    days are flagged; a series has one row a day, so by series the rows are the days.
    """
    spread = pair_filter(predictions).withColumn("group", F.explode(day_groups()))
    y, p = F.col("y_true"), F.col("y_pred")
    days = F.count("*") if "series_id" in by else F.count_distinct("date")
    return (
        spread.groupBy(*by, "group")
        .agg(
            F.count("*").alias("n"),
            days.alias("n_days"),
            scoring.mae(y, p).alias("MAE"),
            scoring.mape(y, p).alias("MAPE"),
        )
        .withColumn("small_sample", F.col("n_days") < SMALL_SAMPLE)
    )


def wide_day_type_breakdown(
    wide: DataFrame, models: list[str], by: list[str], y: str = "total"
) -> DataFrame:
    """The same breakdown of several models at once, without a row per model; groups are unions of days."""
    sums = day_sums(wide, models, [*by, "day_type", "feat_is_bridge_day"], y)
    scored = metrics_of_sums(sums.withColumn("group", F.explode(day_groups())), models, [*by, "group"])
    kept = scored.select(*by, "model", "group", "n", "n_days", "MAE", "MAPE").where("n > 0")
    return kept.withColumn("small_sample", F.col("n_days") < SMALL_SAMPLE)


def breakdown_wide(breakdown: DataFrame, models: list[str]) -> DataFrame:
    """Group by model matrix with one n; the explicit model list avoids a pass to find it."""
    matrix = (
        breakdown.groupBy("group")
        .pivot("model", models)
        .agg(F.first("MAE").alias("MAE"), F.first("MAPE").alias("MAPE"))
    )
    sizes = breakdown.groupBy("group").agg(F.max("n").alias("n"))
    return sizes.join(matrix, "group")


def month_breakdown(predictions: DataFrame) -> DataFrame:
    """n and MAE per month of the year and model."""
    y, p = F.col("y_true"), F.col("y_pred")
    return (
        pair_filter(predictions)
        .groupBy(F.month("date").alias("month"), "model")
        .agg(F.count("*").alias("n"), scoring.mae(y, p).alias("MAE"))
    )


def rolling_mae(predictions: DataFrame, width: int) -> DataFrame:
    """Trailing mean absolute error of each series and model, the row itself included."""
    w = Window.partitionBy("series_id", "model").orderBy("date").rowsBetween(1 - width, 0)
    gap = F.abs(scoring.error(F.col("y_true"), F.col("y_pred")))
    rows = predictions.select(*KEYS, "model", gap.alias("_gap"))
    scored = rows.select(
        *KEYS, "model", F.avg("_gap").over(w).alias("MAE"), F.count("_gap").over(w).alias("n_window")
    )
    return scored.where(F.col("n_window") == width)


def family_min(value: str, model: str, members: list[str]) -> Column:
    """Smallest value among the models of a family."""
    return F.min(F.when(F.col(model).isin(members), F.col(value)))


def family_argmin(value: str, model: str, members: list[str]) -> Column:
    """Model with the smallest value of a family; the name breaks a tie."""
    key = F.when(F.col(model).isin(members), F.struct(F.col(value), F.col(model)))
    return F.min(key)[model]


def rolling_delta(rolling: DataFrame, family_a: list[str], family_b: list[str]) -> DataFrame:
    """Per series and day: best rolling error of one family minus that of the other."""
    best = rolling.groupBy(*KEYS).agg(
        family_min("MAE", "model", family_a).alias("best_a"),
        family_min("MAE", "model", family_b).alias("best_b"),
    )
    return best.withColumn("delta", F.col("best_a") - F.col("best_b"))


def rank_min(metrics: DataFrame, by: list[str], floor: int = SMALL_SAMPLE, size: str = "n") -> DataFrame:
    """Rank of MAE within a group, ties sharing the lowest; null where ``size`` is below the floor."""
    order = Window.partitionBy(*by).orderBy("MAE")
    rank = F.when(F.col(size) >= floor, F.rank().over(order))
    return metrics.withColumn("rank_MAE", rank.cast("long"))


def rank_average(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Average rank of a column within a group."""
    lowest = F.rank().over(Window.partitionBy(*by).orderBy(column))
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return df.withColumn(out, lowest + (ties - 1) / F.lit(2.0))


def error_chain(metrics: DataFrame, chain: list[str], by: list[str]) -> DataFrame:
    """Metrics along an ordered list of models, with each step and its share of the whole gap."""
    place = F.array_position(F.array(*[F.lit(m) for m in chain]), F.col("model"))
    rows = metrics.where(F.col("model").isin(chain)).withColumn("step", place)
    w = Window.partitionBy(*by).orderBy("step")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("MAE").over(w)
    gap = F.first("MAE").over(every) - F.last("MAE").over(every)
    delta = F.coalesce(F.col("MAE") - before, F.lit(0.0))
    pct = F.coalesce(F.try_divide(F.lit(100.0) * (F.col("MAE") - before), before), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.lit(-100.0) * delta, gap), F.lit(0.0))
    return rows.withColumns(
        {"delta_MAE_abs": delta, "delta_MAE_pct": pct, "gap_share_pct": share}
    ).select(*by, "step", "model", *METRICS, "delta_MAE_abs", "delta_MAE_pct", "gap_share_pct")


def bh_adjust(df: DataFrame, by: list[str], p: str, key: str, q: float = FDR_Q) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values and rejection within each family of hypotheses.

    Null p-values belong to no family and stay null.
    """
    order = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), key)
    size = F.count(p).over(Window.partitionBy(*by))
    ranked = df.withColumns({"_i": F.row_number().over(order), "_m": size})
    step = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_i"))
    larger = order.rowsBetween(0, Window.unboundedFollowing)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_step").over(larger)))
    out = ranked.withColumn("_step", step).withColumn("p_adj_bh", adjusted)
    return out.withColumn("significant", F.coalesce(F.col("p_adj_bh") <= q, F.lit(False))).drop(
        "_i", "_m", "_step"
    )


def ensemble_weights(metrics: DataFrame, members: list[str], by: list[str]) -> DataFrame:
    """Weights inversely proportional to MAE, summing to one within each group."""
    inverse = F.lit(1.0) / F.col("MAE")
    total = F.sum(inverse).over(Window.partitionBy(*by))
    chosen = metrics.where(F.col("model").isin(members))
    return chosen.select(*by, "model", "MAE", (inverse / total).alias("weight"))


def inverse_mae_weights(wide: DataFrame, members: list[str], y: str = "total") -> dict[str, float]:
    """The same weights as numbers, from one aggregate over validation rows."""
    row = wide.agg(*[scoring.mae(F.col(y), F.col(m)).alias(m) for m in members]).first()
    inverse = {m: 1.0 / row[m] for m in members}
    return {m: v / sum(inverse.values()) for m, v in inverse.items()}


def weighted_mean(weights: dict[str, float]) -> Column:
    """Weighted sum of prediction columns."""
    return reduce(lambda a, b: a + b, [F.col(m) * F.lit(w) for m, w in weights.items()])


def delta_table(metrics: DataFrame, focal: str, by: list[str]) -> DataFrame:
    """MAE of one model minus that of every other, with the verdict."""
    own = F.max(F.when(F.col("model") == focal, F.col("MAE"))).over(Window.partitionBy(*by))
    rows = metrics.withColumn("focal_MAE", own).where(F.col("model") != focal)
    delta = F.col("focal_MAE") - F.col("MAE")
    verdict = F.when(delta < 0, "mejor").when(delta > 0, "peor").otherwise("igual")
    return rows.select(
        *by, "model", "MAE", "focal_MAE", delta.alias("delta_MAE"), verdict.alias("verdict")
    )


def weighted_group_mae(
    breakdown: DataFrame, metrics: DataFrame, groups: list[str], base: str, variant: str, limit: float
) -> DataFrame:
    """Whether a variant lowers the n-weighted MAE of chosen groups within an overall budget."""

    def pooled(model: str) -> Column:
        mine = (F.col("model") == model) & F.col("group").isin(groups)
        weight = F.when(mine, F.col("n"))
        return F.sum(weight * F.col("MAE")) / F.sum(weight)

    def overall(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("MAE")))

    inside = breakdown.groupBy("split").agg(
        pooled(base).alias("group_MAE_base"), pooled(variant).alias("group_MAE_variant")
    )
    total = metrics.groupBy("split").agg(
        overall(base).alias("MAE_base"), overall(variant).alias("MAE_variant")
    )
    change = (F.col("MAE_variant") - F.col("MAE_base")) / F.col("MAE_base")
    return (
        inside.join(total, "split")
        .withColumn("overall_change_pct", change * 100.0)
        .withColumn("improved", F.col("group_MAE_variant") < F.col("group_MAE_base"))
        .withColumn("within_budget", change <= limit)
        .withColumn("criterion_met", F.col("improved") & F.col("within_budget"))
    )


def best_row(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Model with the lowest MAE per group; the name breaks a tie."""
    best = F.min(F.struct("MAE", "model"))
    return metrics.groupBy(*by).agg(best.alias("r")).select(*by, "r.model", "r.MAE")


def fold_health(oof: DataFrame, by: list[str], floor: float) -> DataFrame:
    """Deviation ratio and correlation of predictions per fold, and the degenerate flag."""
    ratio = F.try_divide(F.stddev_samp("y_pred"), F.stddev_samp("y_true"))
    out = oof.groupBy(*by).agg(
        F.count("*").alias("n"), ratio.alias("std_ratio"), F.corr("y_pred", "y_true").alias("corr")
    )
    bad = (F.col("std_ratio") < floor) & (F.col("corr") < floor)
    return out.withColumn("degenerate", F.coalesce(bad, F.lit(False)))


def fold_log(oof: DataFrame, by: list[str]) -> DataFrame:
    """Days, rows, MAE and RMSE of every held-out block."""
    y, p = F.col("y_true"), F.col("y_pred")
    return oof.groupBy(*by).agg(
        F.min("date").alias("block_start"),
        F.max("date").alias("block_end"),
        F.count("*").alias("n_rows"),
        scoring.mae(y, p).alias("MAE"),
        scoring.rmse(y, p).alias("RMSE"),
    )


def fold_skill(oof: DataFrame, by: list[str], baseline: str = "seasonal_naive") -> DataFrame:
    """Fold error against a naive baseline on the same rows, with the training rows behind it."""
    y = F.col("y_true")
    return (
        oof.groupBy(*by)
        .agg(
            F.min("pos").alias("train_rows"),
            F.count("*").alias("oof_rows"),
            F.min("date").alias("oof_start"),
            F.max("date").alias("oof_end"),
            scoring.mae(y, F.col("y_pred")).alias("MAE"),
            scoring.mae(y, F.col(baseline)).alias("MAE_baseline"),
        )
        .withColumn("skill_ratio", F.try_divide(F.col("MAE"), F.col("MAE_baseline")))
    )


def coverage_check(oof: DataFrame, flags: list[str], excluded_fold: int) -> DataFrame:
    """Counts of every category inside and outside one fold; safe if none occurs only inside.

    One conditional aggregate over all flags; the unpivoted result has one row per flag.
    """
    inside = F.col("fold") == excluded_fold
    row = oof.where("has_oof").agg(
        *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"in_{c}") for c in flags],
        *[F.sum(F.when(inside, 0).otherwise(F.col(c))).alias(f"out_{c}") for c in flags],
    )
    entries = [
        F.struct(
            F.lit(c.removeprefix("feat_")).alias("category"),
            F.coalesce(F.col(f"in_{c}"), F.lit(0)).cast("long").alias("n_excluded"),
            F.coalesce(F.col(f"out_{c}"), F.lit(0)).cast("long").alias("n_retained"),
        )
        for c in flags
    ]
    rows = row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    lost = (F.col("n_excluded") > 0) & (F.col("n_retained") == 0)
    flagged = rows.withColumn("zero_coverage_elsewhere", lost)
    overall = ~F.max("zero_coverage_elsewhere").over(Window.partitionBy())
    return flagged.withColumn("exclusion_is_safe", overall)


def learning_curve_summary(runs: DataFrame, by: str, value: str, flag: str) -> DataFrame:
    """Median, range, flagged runs and number of runs per setting."""
    return runs.groupBy(by).agg(
        F.median(value).alias(f"{value}_median"),
        F.min(value).alias(f"{value}_min"),
        F.max(value).alias(f"{value}_max"),
        F.sum(F.col(flag).cast("long")).alias(f"n_{flag}"),
        F.count("*").alias("n_runs"),
    )


def baseline_columns(panel: DataFrame, y: str = "total") -> DataFrame:
    """The four parameter-free forecasts beside the truth, all from one window pass."""
    from daybook.operators.features import trailing

    w = by_series()
    return panel.select(
        *KEYS,
        y,
        F.lag(y, 1).over(w).cast("double").alias("persistence"),
        F.lag(y, 7).over(w).cast("double").alias("seasonal_naive"),
        trailing(y, 7, "mean").alias("moving_average_7"),
        trailing(y, 28, "mean").alias("moving_average_28"),
    )
