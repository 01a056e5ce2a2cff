"""Queries over metrics, breakdowns, reshaping and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.constants import (
    DEGENERATE_MIN,
    DRIFT_CEILING,
    MAX_OVERALL_DEGRADATION,
    ROLLING_MAE_WINDOW,
)
from daybook.operators import reports, reshape, residuals, scores, splits
from daybook.operators.panel import KEYS
from daybook.plans import tables as T
from daybook.plans.registry import query
from daybook.plans.sql import ERROR, R, metrics, rows, twin
from daybook.plans.workspace import Workspace, rounded

# Report texts of the models.
DESCRIPTIONS = {
    "persistence": "value of the day before",
    "seasonal_naive": "value of the same weekday a week before",
    "moving_average_7": "mean of the last 7 days",
    "moving_average_28": "mean of the last 28 days",
    "ensemble_equal": "mean of two models",
    "ensemble_inverse_mae": "mean of two models weighted by validation error",
}
FAMILIES = {**{m: "baseline" for m in T.BASELINES}, **{m: "ensemble" for m in T.ENSEMBLES}}


def _case(mapping: dict[str, str], column: str = "model") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


ROUNDED_METRICS = rows("n", *[f"{R(m)} AS {m}" for m in ("MAE", "RMSE", "MAPE", "R2")])


@query("persistence", twin("SELECT series_id, date, split, total, persistence FROM baselines", "baselines"))
def persistence(ws: Workspace) -> DataFrame:
    return ws.baselines.select(*KEYS, "split", "total", "persistence")


@query("seasonal_naive", twin("SELECT series_id, date, split, total, seasonal_naive FROM baselines", "baselines"))
def seasonal_naive(ws: Workspace) -> DataFrame:
    """The flagship: dense panel, weekly lag, warm-up and split of every series."""
    return ws.baselines.select(*KEYS, "split", "total", "seasonal_naive")


@query(
    "moving_average_7",
    twin(f"SELECT series_id, date, split, {R('moving_average_7')} AS moving_average_7 FROM baselines", "baselines"),
)
def moving_average_7(ws: Workspace) -> DataFrame:
    return rounded(ws.baselines.select(*KEYS, "split", "moving_average_7"))


@query(
    "moving_average_28",
    twin(f"SELECT series_id, date, split, {R('moving_average_28')} AS moving_average_28 FROM baselines", "baselines"),
)
def moving_average_28(ws: Workspace) -> DataFrame:
    return rounded(ws.baselines.select(*KEYS, "split", "moving_average_28"))


def _ensemble(name: str):
    sql = twin(f"SELECT series_id, date, split, {R(name, 4)} AS {name} FROM wide", "wide")

    @query(name, sql)
    def ensemble(ws: Workspace) -> DataFrame:
        return rounded(ws.wide.select(*KEYS, "split", name), 4)

    return ensemble


ensemble_equal = _ensemble("ensemble_equal")
ensemble_inverse_mae = _ensemble("ensemble_inverse_mae")


@query(
    "pair_filter",
    twin(
        """SELECT model, count(*) AS n_rows, count(y_pred) AS n_pairs FROM (
        SELECT 'seasonal_naive' AS model, seasonal_naive AS y_pred FROM base UNION ALL
        SELECT 'moving_average_28', moving_average_28 FROM base) GROUP BY model""",
        "base",
    ),
)
def pair_filter(ws: Workspace) -> DataFrame:
    """Rows and scored pairs per model before the warm-up is dropped."""
    from daybook.operators.features import melt

    raw = scores.baseline_columns(ws.panel).withColumn("y_true", F.col("total").cast("double"))
    long = melt(raw, [*KEYS, "y_true"], ["seasonal_naive", "moving_average_28"], "model", "y_pred")
    kept = scores.pair_filter(long).groupBy("model").agg(F.count("*").alias("n_pairs"))
    return long.groupBy("model").agg(F.count("*").alias("n_rows")).join(kept, "model")


def _metric(name: str, expression: str):
    sql = twin(
        f"SELECT split, model, series_id, {R(expression)} AS {name} FROM tidy GROUP BY split, model, series_id", "tidy"
    )

    @query(name, sql)
    def metric(ws: Workspace) -> DataFrame:
        return rounded(scores.single_metric(ws.tidy, name, ["split", "model", "series_id"]))

    return metric


for _name, _expression in {
    "mae": f"avg(abs({ERROR}))",
    "rmse": f"sqrt(avg(({ERROR}) * ({ERROR})))",
    "mape": f"100 * avg(abs(({ERROR}) / nullif(y_true, 0)))",
    "r2": f"1 - sum(({ERROR}) * ({ERROR})) / nullif(var_pop(y_true) * count(*), 0)",
}.items():
    _metric(_name, _expression)


@query(
    "all_metrics",
    twin(f"SELECT split, model, series_id, {metrics()} FROM tidy GROUP BY split, model, series_id", "tidy"),
)
def all_metrics(ws: Workspace) -> DataFrame:
    return rounded(scores.all_metrics(ws.tidy, ["split", "model", "series_id"]))


@query(
    "safe_metrics",
    twin(
        f"SELECT series_id, day_type, month(date) AS month, {metrics()} FROM tidy_days "
        "WHERE model = 'seasonal_naive' AND split = 'test' GROUP BY ALL",
        "tidy_days",
    ),
)
def safe_metrics(ws: Workspace) -> DataFrame:
    """Groups of a handful of days, whose R2 may be undefined."""
    test = ws.tidy_of("seasonal_naive").where("split = 'test'")
    dated = ws.with_days(test, ["day_type"]).withColumn("month", F.month("date").cast("long"))
    return rounded(scores.safe_metrics(dated, ["series_id", "day_type", "month"]))


@query(
    "comparison_table",
    twin(
        f"""SELECT split, row_number() OVER (PARTITION BY split ORDER BY R2 DESC, model) AS position,
        model, {_case(DESCRIPTIONS)} AS description, {ROUNDED_METRICS} FROM metrics""",
        "metrics",
    ),
)
def comparison_table(ws: Workspace) -> DataFrame:
    return rounded(scores.comparison_table(ws.metrics, DESCRIPTIONS, ["split"]))


@query(
    "comparison_by_split",
    twin(f"SELECT split, model, {_case(FAMILIES)} AS family, {ROUNDED_METRICS} FROM metrics", "metrics"),
)
def comparison_by_split(ws: Workspace) -> DataFrame:
    return rounded(scores.comparison_by_split(ws.metrics, FAMILIES))


@query(
    "baseline_scores",
    twin(f"SELECT split, model, {ROUNDED_METRICS} FROM metrics WHERE model NOT LIKE 'ensemble%'", "metrics"),
)
def baseline_scores(ws: Workspace) -> DataFrame:
    return rounded(scores.wide_metrics(ws.baselines, T.BASELINES, ["split"]))


@query(
    "baseline_scores_city",
    twin(
        f"""SELECT split, {metrics('total', 'seasonal_naive')} FROM (SELECT c.date, total,
        lag(total, 7) OVER (ORDER BY c.date) AS seasonal_naive, row_number() OVER (ORDER BY c.date) AS rn,
        CASE WHEN c.date <= train_end THEN 'train' WHEN c.date <= val_end THEN 'val' ELSE 'test' END AS split
        FROM city c CROSS JOIN bounds) WHERE rn > 28 GROUP BY split""",
        "city",
        "bounds",
    ),
)
def baseline_scores_city(ws: Workspace) -> DataFrame:
    """The single-series case: all suppliers together, one row per day."""
    rows_ = splits.eval_frame(scores.baseline_columns(ws.city), ws.bounds)
    return rounded(scores.wide_metrics(rows_, ["seasonal_naive"], ["split"]).drop("model"))


_GROUPS = """, spread AS (SELECT *, unnest(list_filter([day_type, CASE WHEN day_type = 'laborable' THEN
    CASE WHEN feat_is_bridge_day = 1 THEN 'laborable, bridge day' ELSE 'laborable, ordinary' END END],
    lambda g: g IS NOT NULL)) AS "group" FROM tidy_days),
    groups AS (SELECT split, model, "group", count(*) AS n, count(DISTINCT date) AS n_days, avg(abs(y_true - y_pred)) AS MAE,
    100 * avg(abs((y_true - y_pred) / nullif(y_true, 0))) AS MAPE, count(DISTINCT date) < 10 AS small_sample
    FROM spread GROUP BY split, model, "group") """


def breakdown(ws: Workspace) -> DataFrame:
    days = ws.with_days(ws.wide, ["day_type", "feat_is_bridge_day"])
    return scores.wide_day_type_breakdown(days, T.MODELS, ["split"])


@query(
    "day_type_breakdown",
    twin(
        f'{_GROUPS} SELECT split, model, "group", n, n_days, {R("MAE")} AS MAE, {R("MAPE")} AS MAPE, small_sample FROM groups',
        "tidy_days",
    ),
)
def day_type_breakdown(ws: Workspace) -> DataFrame:
    return rounded(breakdown(ws))


@query(
    "breakdown_wide",
    twin(
        f'{_GROUPS} SELECT "group", max(n) AS n, '
        + rows(
            *[
                f"{R(f'max({m}) FILTER (model = {chr(39)}{x}{chr(39)})')} AS {x}_{m}"
                for x in T.MODELS
                for m in ("MAE", "MAPE")
            ]
        )
        + " FROM groups WHERE split = 'test' GROUP BY \"group\"",
        "tidy_days",
    ),
)
def breakdown_wide(ws: Workspace) -> DataFrame:
    return rounded(scores.breakdown_wide(breakdown(ws).where("split = 'test'"), T.MODELS))


_SUMMARY = rows(
    "count(*) AS n",
    f"{R('avg(abs(residual))')} AS mean_abs_error",
    f"{R('median(abs(residual))')} AS median_abs_error",
    f"{R('100 * avg(abs(residual / nullif(y_true, 0)))')} AS mean_abs_pct",
    f"{R('avg(residual)')} AS mean_signed_bias",
)
_HOLIDAY = """CASE holiday_type WHEN 'none' THEN 'none (not a holiday)'
    ELSE lower(holiday_type) END"""
_BRIDGE = "CASE WHEN feat_is_bridge_day = 1 THEN 'laborable, bridge day' ELSE 'laborable, ordinary' END"
CALENDAR_COLUMNS = [
    "day_type",
    "feat_is_bridge_day",
    "feat_holiday_type_festivo_nacional",
    "feat_holiday_type_festivo_de_la_comunidad_de_madrid",
    "feat_holiday_type_festivo_local_de_la_ciudad_de_madrid",
]


def stage1_days(ws: Workspace) -> DataFrame:
    return ws.with_days(ws.stage1_like, CALENDAR_COLUMNS)


@query(
    "residual_summary",
    twin(
        " UNION ALL ".join(
            f"SELECT series_id, '{name}' AS dimension, {label} AS \"group\", {_SUMMARY} "
            f"FROM resid_days {where} GROUP BY ALL"
            for name, label, where in (
                ("day_type", "day_type", ""),
                (
                    "bridge_day",
                    "CASE WHEN feat_is_bridge_day = 1 THEN 'bridge day (puente)' ELSE 'not bridge day' END",
                    "",
                ),
                ("holiday_type", _HOLIDAY, ""),
                ("laborable_subset", _BRIDGE, "WHERE day_type = 'laborable'"),
            )
        ),
        "resid_days",
    ),
)
def residual_summary(ws: Workspace) -> DataFrame:
    return rounded(residuals.residual_summary(stage1_days(ws)))


@query(
    "bridge_ratio",
    twin(
        f"""SELECT series_id, {R("b")} AS mae_bridge, {R("o")} AS mae_ordinary, {R("h")} AS mae_holiday,
        {R("b / nullif(o, 0)")} AS bridge_ratio, {R("h / nullif(o, 0)")} AS holiday_ratio FROM (
        SELECT series_id,
        avg(abs(residual)) FILTER (day_type = 'laborable' AND feat_is_bridge_day = 1) AS b,
        avg(abs(residual)) FILTER (day_type = 'laborable' AND feat_is_bridge_day = 0) AS o,
        avg(abs(residual)) FILTER (day_type = 'festivo') AS h FROM resid_days GROUP BY series_id)""",
        "resid_days",
    ),
)
def bridge_ratio(ws: Workspace) -> DataFrame:
    return rounded(residuals.bridge_ratio(stage1_days(ws), ["series_id"]))


@query(
    "holiday_label",
    twin(f"SELECT date, {_HOLIDAY} AS holiday FROM days", "days"),
)
def holiday_label(ws: Workspace) -> DataFrame:
    return ws.days.select("date", residuals.holiday_label().alias("holiday"))


_ABS_PCT = f"{R('avg(abs(residual))')} AS mean_abs_residual, {R('100 * avg(abs(residual / nullif(y_true, 0)))')} AS mean_abs_pct"


@query(
    "calendar_group_residuals",
    twin(
        f"""SELECT series_id, 'day_type' AS dimension, "group", count(*) AS n, {_ABS_PCT} FROM (
        SELECT *, day_type AS "group" FROM resid_days
        UNION ALL SELECT *, {_BRIDGE} FROM resid_days WHERE day_type = 'laborable') GROUP BY ALL
        UNION ALL SELECT series_id, 'holiday_type', {_HOLIDAY}, count(*), {_ABS_PCT} FROM resid_days GROUP BY ALL""",
        "resid_days",
    ),
)
def calendar_group_residuals(ws: Workspace) -> DataFrame:
    return rounded(residuals.calendar_group_residuals(stage1_days(ws)))


@query(
    "weekday_profile",
    twin(
        f"""SELECT series_id, weekday_es, n, {R("mean_residual")} AS mean_residual,
        {R("median_residual")} AS median_residual, {R("sd")} AS sd,
        {R("mean_abs_residual")} AS mean_abs_residual,
        {R("coalesce(mean_residual / nullif(sigma, 0), 0)")} AS mean_over_sigma,
        {R("sd / sqrt(n)")} AS standard_error FROM weekdays""",
        "weekdays",
    ),
)
def weekday_profile(ws: Workspace) -> DataFrame:
    return rounded(residuals.weekday_profile(ws.with_days(ws.stage1_like, ["weekday_es"])))


@query(
    "month_breakdown",
    twin(
        f"""SELECT month(date) AS month, model, count(*) AS n, {R('avg(abs(y_true - y_pred))')} AS MAE
        FROM tidy WHERE split <> 'train' GROUP BY ALL""",
        "tidy",
    ),
)
def month_breakdown(ws: Workspace) -> DataFrame:
    return rounded(scores.month_breakdown(ws.tidy.where("split <> 'train'")))


@query(
    "monthly_seasonality",
    twin(
        f"""SELECT s.series_id, m.month, count(total) AS n, {R("avg(total)")} AS mean, {R("stddev_samp(total)")} AS sd
        FROM (SELECT DISTINCT series_id FROM sparse) s CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
        LEFT JOIN sparse p ON p.series_id = s.series_id AND month(p.date) = m.month GROUP BY s.series_id, m.month""",
        "sparse",
    ),
)
def monthly_seasonality(ws: Workspace) -> DataFrame:
    """Active days by month; months without any keep a row."""
    return rounded(residuals.monthly_seasonality(ws.sparse))


@query(
    "weekday_distribution",
    twin(
        f"""SELECT series_id, weekday_es, count(*) AS n, min(total)::DOUBLE AS low,
        {R("quantile_cont(total::DOUBLE, 0.25)")} AS q1, {R("quantile_cont(total::DOUBLE, 0.5)")} AS median,
        {R("quantile_cont(total::DOUBLE, 0.75)")} AS q3, max(total)::DOUBLE AS high, {R("avg(total)")} AS mean
        FROM panel p JOIN calendar c ON c.date = p.date GROUP BY series_id, weekday_es""",
        "panel",
        "calendar",
    ),
)
def weekday_distribution(ws: Workspace) -> DataFrame:
    dated = ws.with_days(ws.panel.select(*KEYS, "total"), ["weekday_es"])
    return rounded(residuals.weekday_distribution(dated))


@query(
    "residual_histogram",
    twin(
        f"""SELECT split, model, bin, {R("low")} AS low, {R("high")} AS high, count(*) AS n FROM (
        SELECT t.split, t.model, low, high, least(40, 1 + coalesce(floor((y_true - y_pred - low)
        / nullif((high - low) / 40, 0)), 0))::BIGINT AS bin FROM tidy t JOIN (
        SELECT split, model, min(y_true - y_pred) AS low, max(y_true - y_pred) AS high FROM tidy
        GROUP BY split, model) r ON r.split = t.split AND r.model = t.model
        WHERE t.model NOT LIKE 'ensemble_inverse%') GROUP BY ALL""",
        "tidy",
    ),
)
def residual_histogram(ws: Workspace) -> DataFrame:
    chosen = ws.tidy_of(*T.BASELINES, "ensemble_equal")
    return rounded(residuals.residual_histogram(chosen, ["split", "model"]))


@query(
    "event_histogram",
    """SELECT event_type, bin, low, high, count(*) AS n FROM (SELECT e.event_type, low, high,
    least(40, 1 + coalesce(floor((value - low) / nullif((high - low) / 40, 0)), 0))::BIGINT AS bin
    FROM events e JOIN (SELECT event_type, min(value) AS low, max(value) AS high FROM events
    GROUP BY event_type) r ON r.event_type = e.event_type) GROUP BY ALL""",
)
def event_histogram(ws: Workspace) -> DataFrame:
    """Deviations of event values from zero, binned per event type."""
    events = T.table(ws.spark, ws.sf_dir, "events")
    rows_ = events.select("event_type", F.col("value").alias("y_true"), F.lit(0.0).alias("y_pred"))
    return residuals.residual_histogram(rows_, ["event_type"])


@query(
    "train_error_ratio",
    twin(
        f"""SELECT model, {rows(*[f"{R('a_' + s)} AS mae_{s}" for s in ("train", "val", "test")])},
        {R("a_val / a_train")} AS val_over_train, {R("a_test / a_train")} AS test_over_train FROM (
        SELECT model, {rows(*[f"avg(abs(y_true - y_pred)) FILTER (split = '{s}') AS a_{s}" for s in ("train", "val", "test")])}
        FROM tidy GROUP BY model)""",
        "tidy",
    ),
)
def train_error_ratio(ws: Workspace) -> DataFrame:
    return rounded(residuals.train_error_ratio(ws.tidy, ["model"]))


@query(
    "error_correlation",
    twin(
        f"""SELECT series_id, split, count(*) AS n,
        {R("corr(total - seasonal_naive, total - moving_average_28)")} AS corr
        FROM baselines GROUP BY series_id, split""",
        "baselines",
    ),
)
def error_correlation(ws: Workspace) -> DataFrame:
    return rounded(
        residuals.error_correlation(ws.baselines, "seasonal_naive", "moving_average_28", ["series_id", "split"])
    )


_FOLD_KEYS = ["series_id", "fold"]
_HEALTH = """stddev_samp(y_pred) / nullif(stddev_samp(y_true), 0)"""


@query(
    "fold_health",
    twin(
        f"""SELECT series_id, fold, count(*) AS n, {R(_HEALTH)} AS std_ratio, {R("corr(y_pred, y_true)")} AS corr,
        coalesce({_HEALTH} < 0.5 AND corr(y_pred, y_true) < 0.5, false) AS degenerate
        FROM folded WHERE has_oof GROUP BY series_id, fold""",
        "folded",
    ),
)
def fold_health(ws: Workspace) -> DataFrame:
    return rounded(scores.fold_health(ws.mean_oof.where("has_oof"), _FOLD_KEYS, DEGENERATE_MIN))


@query(
    "fold_log",
    twin(
        f"""SELECT series_id, fold, min(date) AS block_start, max(date) AS block_end, count(*) AS n_rows,
        {R(f"avg(abs({ERROR}))")} AS MAE, {R(f"sqrt(avg(({ERROR}) * ({ERROR})))")} AS RMSE
        FROM folded WHERE has_oof GROUP BY series_id, fold""",
        "folded",
    ),
)
def fold_log(ws: Workspace) -> DataFrame:
    return rounded(scores.fold_log(ws.mean_oof.where("has_oof"), _FOLD_KEYS))


@query(
    "fold_skill",
    twin(
        f"""SELECT *, {R("MAE / nullif(MAE_baseline, 0)")} AS skill_ratio FROM (
        SELECT series_id, fold, min(pos) AS train_rows, count(*) AS oof_rows, min(date) AS oof_start,
        max(date) AS oof_end, {R(f"avg(abs({ERROR}))")} AS MAE, {R("avg(abs(y_true - seasonal_naive))")} AS MAE_baseline
        FROM folded WHERE has_oof GROUP BY series_id, fold)""",
        "folded",
    ),
)
def fold_skill(ws: Workspace) -> DataFrame:
    held = scores.fold_skill(ws.mean_oof.where("has_oof"), _FOLD_KEYS)
    exact = rounded(held.drop("skill_ratio"))
    return rounded(exact.withColumn("skill_ratio", F.try_divide(F.col("MAE"), F.col("MAE_baseline"))))


@query(
    "learning_curve_summary",
    twin(
        f"""SELECT width, {R("median(MAE)")} AS MAE_median, {R("min(MAE)")} AS MAE_min, {R("max(MAE)")} AS MAE_max,
        sum(poor::INT)::BIGINT AS n_poor, count(*) AS n_runs FROM (
        SELECT CASE model WHEN 'moving_average_7' THEN 7 ELSE 28 END::BIGINT AS width, series_id,
        avg(abs({ERROR})) AS MAE, avg(abs({ERROR})) > 10 AS poor FROM tidy
        WHERE model LIKE 'moving%' AND split = 'val' GROUP BY model, series_id) GROUP BY width""",
        "tidy",
    ),
)
def learning_curve_summary(ws: Workspace) -> DataFrame:
    """Spread of validation error over series, for two amounts of history."""
    models = ["moving_average_7", "moving_average_28"]
    runs = scores.single_metric(ws.tidy_of(*models).where("split = 'val'"), "mae", ["model", "series_id"])
    width = F.when(F.col("model") == models[0], 7).otherwise(28).cast("long")
    tagged = runs.select(width.alias("width"), F.col("mae").alias("MAE"), (F.col("mae") > 10).alias("poor"))
    return rounded(scores.learning_curve_summary(tagged, "width", "MAE", "poor"))


@query(
    "ensemble_weights",
    twin(
        f"""SELECT split, model, {R("MAE")} AS MAE, {R("(1 / MAE) / sum(1 / MAE) OVER (PARTITION BY split)")} AS weight
        FROM metrics WHERE model IN ('seasonal_naive', 'moving_average_28')""",
        "metrics",
    ),
)
def ensemble_weights(ws: Workspace) -> DataFrame:
    base = scores.wide_metrics(ws.baselines, T.BASELINES, ["split"])
    return rounded(scores.ensemble_weights(base, T.ENSEMBLE_MEMBERS, ["split"]))


@query(
    "delta_table",
    twin(
        f"""SELECT m.split, m.model, {R("m.MAE")} AS MAE, {R("f.MAE")} AS focal_MAE, {R("f.MAE - m.MAE")} AS delta_MAE,
        CASE WHEN f.MAE < m.MAE THEN 'mejor' WHEN f.MAE > m.MAE THEN 'peor' ELSE 'igual' END AS verdict
        FROM metrics m JOIN metrics f ON f.split = m.split AND f.model = 'ensemble_equal' AND m.model <> f.model""",
        "metrics",
    ),
)
def delta_table(ws: Workspace) -> DataFrame:
    return rounded(scores.delta_table(ws.metrics, "ensemble_equal", ["split"]))


@query(
    "weighted_group_mae",
    twin(
        f"""{_GROUPS}, inside AS (SELECT split,
        sum(n * MAE) FILTER (model = 'seasonal_naive') / sum(n) FILTER (model = 'seasonal_naive') AS gb,
        sum(n * MAE) FILTER (model = 'ensemble_equal') / sum(n) FILTER (model = 'ensemble_equal') AS gv
        FROM groups WHERE "group" IN ('festivo', 'laborable, bridge day') GROUP BY split),
        overall AS (SELECT split, max(MAE) FILTER (model = 'seasonal_naive') AS b,
        max(MAE) FILTER (model = 'ensemble_equal') AS v FROM (SELECT split, model,
        avg(abs(y_true - y_pred)) AS MAE FROM tidy_days GROUP BY split, model) GROUP BY split)
        SELECT i.split, {R("gb")} AS group_MAE_base, {R("gv")} AS group_MAE_variant, {R("b")} AS MAE_base,
        {R("v")} AS MAE_variant, {R("100 * (v - b) / b")} AS overall_change_pct, gv < gb AS improved,
        (v - b) / b <= 0.05 AS within_budget, gv < gb AND (v - b) / b <= 0.05 AS criterion_met
        FROM inside i JOIN overall o ON o.split = i.split""",
        "tidy_days",
    ),
)
def weighted_group_mae(ws: Workspace) -> DataFrame:
    return rounded(
        scores.weighted_group_mae(
            breakdown(ws),
            ws.metrics,
            ["festivo", "laborable, bridge day"],
            "seasonal_naive",
            "ensemble_equal",
            MAX_OVERALL_DEGRADATION,
        )
    )


@query(
    "split_summary",
    twin(
        f"""SELECT split, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_days,
        count(*) AS n_rows, {R("100.0::DOUBLE * count(DISTINCT date) / sum(count(DISTINCT date)) OVER ()")} AS share_pct
        FROM baselines GROUP BY split""",
        "baselines",
    ),
)
def split_summary(ws: Workspace) -> DataFrame:
    return rounded(splits.split_summary(ws.baselines))


@query(
    "best_row",
    twin(
        f"""SELECT split, series_id, arg_min(model, (MAE, model)) AS model, {R("min(MAE)")} AS MAE FROM (
        SELECT split, series_id, model, avg(abs({ERROR})) AS MAE FROM tidy
        WHERE model IN ('persistence', 'seasonal_naive') GROUP BY ALL) GROUP BY split, series_id""",
        "tidy",
    ),
)
def best_row(ws: Workspace) -> DataFrame:
    """Better of two whole-number forecasts for every series; ties go by name."""
    by_series = scores.wide_metrics(ws.baselines, ["persistence", "seasonal_naive"], ["split", "series_id"])
    return rounded(scores.best_row(by_series, ["split", "series_id"]))


@query(
    "tidy_predictions",
    twin(
        f"""SELECT series_id, split, model, count(*) AS n, sum(y_true)::DOUBLE AS y_true, {R("sum(y_pred)", 3)} AS y_pred,
        min(date) AS first_date, max(date) AS last_date FROM tidy GROUP BY series_id, split, model""",
        "tidy",
    ),
)
def tidy_predictions(ws: Workspace) -> DataFrame:
    """Checked long predictions of two artifacts, summed per series, split and model."""
    baselines = reshape.tidy_predictions(ws.baselines, T.BASELINES)
    ensembles = reshape.tidy_predictions(ws.wide, T.ENSEMBLES)
    tidy = reshape.check_predictions(reshape.union_predictions([baselines, ensembles]))
    return rounded(
        tidy.groupBy("series_id", "split", "model").agg(
            F.count("*").alias("n"),
            F.sum("y_true").alias("y_true"),
            F.sum("y_pred").alias("y_pred"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        ),
        3,
    )


@query(
    "available_models",
    twin(
        f"SELECT DISTINCT split, model, list_position({T.MODELS}, model)::BIGINT AS position FROM tidy", "tidy"
    ),
)
def available_models(ws: Workspace) -> DataFrame:
    return reshape.available_models(ws.tidy, T.MODELS)


@query(
    "actual_vs_predicted",
    twin(
        """SELECT series_id, date, total::DOUBLE AS y_true, seasonal_naive AS y_pred
        FROM baselines WHERE split = 'test'""",
        "baselines",
    ),
)
def actual_vs_predicted(ws: Workspace) -> DataFrame:
    return reshape.actual_vs_predicted(ws.tidy_of("seasonal_naive"), "seasonal_naive", "test")


@query(
    "assemble_wide",
    twin(
        f"""SELECT series_id, date, split, total::DOUBLE AS y_true, persistence, seasonal_naive,
        {R("moving_average_7")} AS moving_average_7 FROM baselines WHERE split <> 'train'""",
        "baselines",
    ),
)
def assemble_wide(ws: Workspace) -> DataFrame:
    models = ["persistence", "seasonal_naive", "moving_average_7"]
    tidy = ws.tidy_of(*models).where("split <> 'train'")
    return rounded(reshape.assemble_wide(tidy, models))


@query(
    "eval_matrix",
    twin(
        """, sparse_tidy AS (SELECT t.* FROM tidy t LEFT JOIN sparse s
        ON s.series_id = t.series_id AND s.date = t.date
        WHERE t.split = 'test' AND t.model IN ('persistence', 'seasonal_naive')
        AND (t.model <> 'persistence' OR s.date IS NOT NULL))
        SELECT series_id, date, split, model, y_true, y_pred FROM sparse_tidy WHERE model IN (
        SELECT model FROM sparse_tidy GROUP BY model HAVING count(*) =
        (SELECT count(*) FROM (SELECT DISTINCT series_id, date FROM sparse_tidy)))""",
        "tidy",
        "sparse",
    ),
)
def eval_matrix(ws: Workspace) -> DataFrame:
    """One model covers every test day, the other only active ones and is left out."""
    tidy = ws.tidy_of("persistence", "seasonal_naive")
    active = tidy.where("model = 'persistence'").join(ws.sparse.select(*KEYS), KEYS, "left_semi")
    both = tidy.where("model <> 'persistence'").unionByName(active)
    return reshape.eval_matrix(both, ["test"], T.MODELS)


@query(
    "dedupe_first",
    twin(
        f"""SELECT split, model, {ROUNDED_METRICS} FROM metrics WHERE split = 'test' OR model NOT LIKE 'ensemble%'""",
        "metrics",
    ),
)
def dedupe_first(ws: Workspace) -> DataFrame:
    """Test metrics of every model stacked on the baselines', whose test rows repeat."""
    test = ws.metrics.where("split = 'test'")
    base = scores.wide_metrics(ws.baselines, T.BASELINES, ["split"])
    return rounded(reshape.dedupe_first([test, base], ["split", "model"]))


@query(
    "key_diff",
    twin(
        """SELECT split, model, 'missing' AS side FROM metrics WHERE split = 'train' AND model LIKE 'ensemble%'
        UNION ALL SELECT split, model, 'extra' FROM metrics WHERE split = 'test' AND model NOT LIKE 'ensemble%'""",
        "metrics",
    ),
)
def key_diff(ws: Workspace) -> DataFrame:
    """Metric rows that only one of two differently filtered tables has."""
    ensemble = F.col("model").startswith("ensemble")
    published = ws.metrics.where(~((F.col("split") == "test") & ~ensemble))
    new = ws.metrics.where(~((F.col("split") == "train") & ensemble))
    return reshape.key_diff(new, published, ["split", "model"])


@query(
    "verify_metrics",
    twin(
        f"""SELECT split, model, metric, {R("published", 4)} AS published, {R("recomputed", 4)} AS recomputed,
        {R("abs(recomputed - published)", 4)} AS abs_deviation,
        CASE WHEN metric = 'n' THEN 0.0::DOUBLE ELSE
        {R("abs(recomputed - published) / greatest(abs(published), 1e-12)")} END AS rel_deviation,
        CASE WHEN abs(recomputed - published) / greatest(abs(published), 1e-12) <= 1e-6 THEN 'ok'
        WHEN abs(recomputed - published) / greatest(abs(published), 1e-12) <= 1e-3 THEN 'environment drift'
        ELSE 'real change' END AS verdict FROM (
        SELECT split, model, unnest(['n', 'MAE', 'RMSE', 'MAPE', 'R2']) AS metric,
        unnest([n::DOUBLE, MAE, RMSE, MAPE, R2]) AS published,
        unnest([n::DOUBLE, CASE WHEN model = 'persistence' THEN MAE * 1.00001::DOUBLE
        WHEN model = 'seasonal_naive' THEN MAE * 1.4::DOUBLE ELSE MAE END, RMSE, MAPE, R2]) AS recomputed
        FROM metrics)""",
        "metrics",
    ),
)
def verify_metrics(ws: Workspace) -> DataFrame:
    """Two runs of the metric table, one with a slightly and one with a clearly changed cell."""
    factor = F.when(F.col("model") == "persistence", 1.00001).when(F.col("model") == "seasonal_naive", 1.4)
    changed = ws.metrics.withColumn("MAE", F.col("MAE") * F.coalesce(factor, F.lit(1.0)))
    table = reshape.verify_metrics(changed, ws.metrics, ["split", "model"], DRIFT_CEILING)
    return table.select(
        "split",
        "model",
        "metric",
        *[F.round(c, 4).alias(c) for c in ("published", "recomputed", "abs_deviation")],
        F.round("rel_deviation", 6).alias("rel_deviation"),
        "verdict",
    )


@query(
    "comparison_report",
    twin(
        f"""SELECT split, {_case(DESCRIPTIONS)} AS label, n, round_even(MAE, 0)::DOUBLE AS MAE,
        round_even(RMSE, 0)::DOUBLE AS RMSE, round_even(MAPE, 2)::DOUBLE AS MAPE,
        CASE WHEN round_even(R2, 4) = 0 THEN 0.0 ELSE round_even(R2, 4) END::DOUBLE AS R2 FROM metrics""",
        "metrics",
    ),
)
def comparison_report(ws: Workspace) -> DataFrame:
    return reshape.comparison_report(ws.metrics, DESCRIPTIONS)


@query(
    "rolling_mae",
    twin(
        f"""SELECT series_id, date, model, {R("m")} AS MAE, n_window FROM (
        SELECT series_id, date, model, avg(abs({ERROR})) OVER w AS m, count(*) OVER w AS n_window FROM tidy
        WHERE split <> 'train' AND model IN ('seasonal_naive', 'moving_average_28')
        WINDOW w AS (PARTITION BY series_id, model ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))
        WHERE n_window = 28""",
        "tidy",
    ),
)
def rolling_mae(ws: Workspace) -> DataFrame:
    tidy = ws.tidy_of("seasonal_naive", "moving_average_28").where("split <> 'train'")
    return rounded(scores.rolling_mae(tidy, ROLLING_MAE_WINDOW))


@query(
    "rolling_delta",
    twin(
        f"""SELECT series_id, date, {R("a")} AS best_a, {R("b")} AS best_b, {R("a - b")} AS delta FROM (
        SELECT series_id, date, min(m) FILTER (model LIKE 'moving%') AS a, min(m) FILTER (model NOT LIKE 'moving%') AS b
        FROM (SELECT series_id, date, model, avg(abs({ERROR})) OVER w AS m, count(*) OVER w AS k FROM tidy
        WHERE split <> 'train' AND model NOT LIKE 'ensemble%'
        WINDOW w AS (PARTITION BY series_id, model ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))
        WHERE k = 28 GROUP BY series_id, date)""",
        "tidy",
    ),
)
def rolling_delta(ws: Workspace) -> DataFrame:
    tidy = ws.tidy_of(*T.BASELINES).where("split <> 'train'")
    rolling = scores.rolling_mae(tidy, ROLLING_MAE_WINDOW)
    return rounded(scores.rolling_delta(rolling, T.BASELINES[2:], T.BASELINES[:2]))


@query(
    "rank_min",
    twin(
        f"""SELECT day_type, model, n, n_days, {R("MAE")} AS MAE,
        CASE WHEN n_days >= 10 THEN rank() OVER (PARTITION BY day_type ORDER BY MAE) END AS rank_MAE FROM (
        SELECT day_type, model, count(*) AS n, count(DISTINCT date) AS n_days, avg(abs({ERROR})) AS MAE FROM tidy_days
        WHERE split = 'test' AND model NOT LIKE 'ensemble%' GROUP BY day_type, model)""",
        "tidy_days",
    ),
)
def rank_min(ws: Workspace) -> DataFrame:
    days = ws.with_days(ws.baselines.where("split = 'test'"), ["day_type"])
    table = scores.wide_metrics(days, T.BASELINES, ["day_type"], days=True)
    ranked = scores.rank_min(table, ["day_type"], size="n_days")
    return rounded(ranked.select("day_type", "model", "n", "n_days", "MAE", "rank_MAE"))


CHAIN = ["seasonal_naive", "ensemble_equal", "moving_average_28"]


@query(
    "error_chain",
    twin(
        f"""SELECT split, step, model, {rows(*[f"{R(m)} AS {m}" for m in ("MAE", "RMSE", "MAPE", "R2")])},
        {R("coalesce(MAE - p, 0)")} AS delta_MAE_abs, {R("coalesce(100 * (MAE - p) / p, 0)")} AS delta_MAE_pct,
        {R("coalesce(-100 * coalesce(MAE - p, 0) / nullif(f - l, 0), 0)")} AS gap_share_pct FROM (
        SELECT *, lag(MAE) OVER w AS p, first(MAE) OVER e AS f, last(MAE) OVER e AS l FROM (
        SELECT *, list_position({CHAIN}, model)::BIGINT AS step FROM metrics WHERE model IN {tuple(CHAIN)})
        WINDOW w AS (PARTITION BY split ORDER BY step), e AS (PARTITION BY split ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        "metrics",
    ),
)
def error_chain(ws: Workspace) -> DataFrame:
    return rounded(scores.error_chain(ws.metrics, CHAIN, ["split"]))


@query(
    "report_split_blocks",
    twin(
        f"""SELECT split, model, {ROUNDED_METRICS}, list_position({CHAIN}, model)::BIGINT AS "row"
        FROM metrics WHERE split <> 'train' AND model IN {tuple(CHAIN)}""",
        "metrics",
    ),
)
def report_split_blocks(ws: Workspace) -> DataFrame:
    return rounded(reports.split_blocks(ws.metrics, CHAIN))


@query(
    "report_validation_beside_test",
    twin(
        f"""SELECT v.model, {R("v.MAE")} AS val_MAE, {R("v.R2")} AS val_R2, {R("t.MAE")} AS test_MAE,
        {R("t.R2")} AS test_R2, {R("t.MAE - v.MAE")} AS MAE_change
        FROM metrics v JOIN metrics t ON t.model = v.model AND t.split = 'test' WHERE v.split = 'val'""",
        "metrics",
    ),
)
def report_validation_beside_test(ws: Workspace) -> DataFrame:
    return rounded(reports.validation_beside_test(ws.metrics))


@query(
    "report_weights",
    twin(
        """SELECT split, string_agg(model || '=' || format('{:.4f}', w), ', ' ORDER BY model) AS weights FROM (
        SELECT split, model, (1 / MAE) / sum(1 / MAE) OVER (PARTITION BY split) AS w
        FROM metrics WHERE model IN ('seasonal_naive', 'moving_average_28')) GROUP BY split""",
        "metrics",
    ),
)
def report_weights(ws: Workspace) -> DataFrame:
    base = scores.wide_metrics(ws.baselines, T.BASELINES, ["split"])
    return reports.weights_report(scores.ensemble_weights(base, T.ENSEMBLE_MEMBERS, ["split"]))


@query(
    "report_folds",
    twin(
        f"""SELECT series_id, fold, min(date) AS block_start, max(date) AS block_end, count(*) AS n_rows,
        {R(f"avg(abs({ERROR}))")} AS MAE, {R(f"sqrt(avg(({ERROR}) * ({ERROR})))")} AS RMSE,
        {R(_HEALTH)} AS std_ratio, {R("corr(y_pred, y_true)")} AS corr,
        coalesce({_HEALTH} < 0.5 AND corr(y_pred, y_true) < 0.5, false) AS degenerate
        FROM folded WHERE has_oof GROUP BY series_id, fold""",
        "folded",
    ),
)
def report_folds(ws: Workspace) -> DataFrame:
    held = ws.mean_oof.where("has_oof")
    log = scores.fold_log(held, _FOLD_KEYS)
    health = scores.fold_health(held, _FOLD_KEYS, DEGENERATE_MIN)
    return rounded(reports.fold_report(log, health, _FOLD_KEYS))
