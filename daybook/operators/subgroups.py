"""Overlapping day subgroups, their metrics, family comparisons and block bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.constants import (
    ANOMALY_K,
    ANOMALY_LAG,
    BLOCK_DAYS,
    EXCLUDED_SUBGROUPS,
    FDR_Q,
    MAD_TO_SIGMA,
    MIN_N_INFERENTIAL,
    N_BOOTSTRAP,
    SEED,
    SUBGROUPS,
    USABLE_MIN,
    VERDICT_EXCLUDED,
    VERDICT_NO_WIN,
    VERDICT_NON_INFER,
    VERDICT_RANK_ONLY,
    VERDICT_WIN,
)
from daybook.functions import scoring
from daybook.operators.panel import KEYS, Span, by_series, near_dates
from daybook.operators.scores import bh_adjust, day_sums, family_argmin, family_min, metrics_of_sums, rank_min
from daybook.operators.splits import SplitBounds, in_split
from daybook.session import small_side

# Scope of validation and test together (fixed value).
POOLED_SCOPE = "val_test"


def easter_days(calendar: DataFrame, reach: int = 4) -> DataFrame:
    """Dates within ``reach`` days of a Maundy Thursday."""
    anchors = calendar.where(F.col("holiday_name").contains("Jueves Santo")).select("date")
    return near_dates(calendar.select("date"), anchors, reach)


def with_easter(calendar: DataFrame, span: Span) -> DataFrame:
    """The calendar with a flag for the days around Easter."""
    near = easter_days(calendar).withColumn("is_easter", F.lit(True))
    joined = calendar.join(small_side(near, span.n_days), "date", "left")
    return joined.withColumn("is_easter", F.coalesce("is_easter", F.lit(False)))


def weekly_change(panel: DataFrame, column: str = "total", lag: int = ANOMALY_LAG) -> DataFrame:
    """The panel with its change against the same weekday one week earlier."""
    change = F.col(column) - F.lag(column, lag).over(by_series())
    return panel.withColumn("delta7", change)


def train_mad(changes: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Robust scale of the weekly change per series, from training rows only."""
    train = changes.where(in_split(bounds, "train") & F.col("delta7").isNotNull())
    centre = train.groupBy("series_id").agg(F.median("delta7").alias("_centre"))
    away = train.join(centre, "series_id").withColumn("_away", F.abs(F.col("delta7") - F.col("_centre")))
    return away.groupBy("series_id").agg((F.median("_away") * MAD_TO_SIGMA).alias("mad_scale"))


def with_anomaly(changes: DataFrame, mad: DataFrame) -> DataFrame:
    """Flag days whose weekly change exceeds the robust limit; null where there is no change."""
    joined = changes.join(mad, "series_id", "left")
    return joined.withColumn("is_anomalous", F.abs("delta7") > F.col("mad_scale") * ANOMALY_K)


def subgroup_conditions() -> dict[str, Column]:
    """Membership rule of each subgroup over calendar columns and the anomaly flag."""
    day, bridge = F.col("day_type"), F.col("feat_is_bridge_day") == 1
    working, holiday = day == "laborable", day == "festivo"
    month, of_month = F.month("date"), F.dayofmonth("date")
    summer = month.isin(7, 8)
    irregular = holiday | (working & bridge)
    christmas = ((month == 12) & (of_month >= 22)) | ((month == 1) & (of_month <= 6))
    anomalous = F.coalesce(F.col("is_anomalous"), F.lit(False))
    return {
        "laborable_ordinario": working & ~bridge,
        "laborable_puente": working & bridge,
        "sabado": day == "sabado",
        "domingo": day == "domingo",
        "festivo": holiday,
        "fin_de_semana": day.isin("sabado", "domingo"),
        "entre_semana": working | holiday,
        "calendario_irregular": irregular,
        "calendario_ordinario": ~irregular,
        "verano_jul_ago": summer,
        "resto_del_anio": ~summer,
        "periodo_navidad": christmas,
        "periodo_semana_santa": F.col("is_easter"),
        "demanda_anomala": anomalous,
        "demanda_regular": F.col("delta7").isNotNull() & ~anomalous,
    }


def subgroup_masks(rows: DataFrame) -> DataFrame:
    """A boolean column per subgroup."""
    rules = subgroup_conditions()
    return rows.select(*KEYS, *[rules[name].alias(name) for name in SUBGROUPS])


def subgroup_members() -> Column:
    """The subgroups of a row as bits, in the order of ``SUBGROUPS``."""
    rules = subgroup_conditions()
    return reduce(lambda a, b: a + b, [F.when(rules[name], F.lit(1 << i)).otherwise(0) for i, name in enumerate(SUBGROUPS)])


def spread_members(sums: DataFrame) -> DataFrame:
    """One row per subgroup in ``members``, for sums of rows that share their subgroups."""
    names = [F.when(F.col("members").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(SUBGROUPS)]
    return sums.withColumn("subgroup", F.explode(F.array_compact(F.array(*names))))


def subgroup_metrics(rows: DataFrame, models: list[str], y: str = "total") -> DataFrame:
    """Metrics, rank and inferential flag per scope, subgroup and model, from wide rows.

    Every row counts in its own scope and in the pooled one. Ranks and the flag go by the days of
    a subgroup (``n_days``), since rows of one day are no independent observations. Rows are summed
    by day and subgroups before they are spread over scopes and subgroups.
    """
    sums = day_sums(rows.withColumn("members", subgroup_members()), models, ["scope", "members"], y)
    scopes = F.explode(F.array("scope", F.lit(POOLED_SCOPE)))
    metrics = metrics_of_sums(spread_members(sums.withColumn("scope", scopes)), models, ["scope", "subgroup"])
    ranked = rank_min(metrics, ["scope", "subgroup"], size="n_days")
    return ranked.withColumn("inferential", F.col("n_days") >= MIN_N_INFERENTIAL)


def win_table(metrics: DataFrame, focal: list[str], rivals: list[str]) -> DataFrame:
    """Best model of each family per subgroup, and whether the focal family is ahead."""
    best = metrics.groupBy("scope", "subgroup").agg(
        F.max("n").alias("n"),
        F.max("n_days").alias("n_days"),
        family_argmin("MAE", "model", rivals).alias("best_model"),
        family_min("MAE", "model", rivals).alias("best_MAE"),
        family_argmin("MAE", "model", focal).alias("best_focal"),
        family_min("MAE", "model", focal).alias("best_focal_MAE"),
    )
    whole = best.where("best_model is not null and best_focal is not null")
    delta = F.col("best_focal_MAE") - F.col("best_MAE")
    return whole.withColumns(
        {
            "inferential": F.col("n_days") >= MIN_N_INFERENTIAL,
            "delta_MAE": delta,
            "delta_pct": F.try_divide(delta * 100.0, F.col("best_MAE")),
            "focal_ranks_first": delta < 0,
        }
    )


def day_errors(rows: DataFrame, models: list[str], first: Column, y: str = "total") -> DataFrame:
    """Error sums per day and subgroup, pre-aggregated over series: the bootstrap's whole input.

    The result has at most days x subgroups rows, however many series there are.
    """
    gaps = [
        F.sum(F.abs(scoring.error(F.col(y), F.col(m)))).alias(f"e{i}") for i, m in enumerate(models)
    ]
    sums = rows.withColumn("members", subgroup_members()).groupBy("date", "members").agg(F.count("*").alias("n"), *gaps)
    return (
        spread_members(sums)
        .groupBy("date", "subgroup")
        .agg(F.sum("n").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(len(models))])
        .withColumn("pos", F.datediff("date", first).cast("long"))
    )


def block_starts(n_days: int, n_boot: int, block: int, seed: int) -> Column:
    """Start of block ``j`` of replicate ``b``, drawn from a hash so that any engine agrees."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return draw % (n_days - block + 1)


def resampled_days(spark, n_days: int, n_boot: int, block: int = BLOCK_DAYS, seed: int = SEED) -> DataFrame:
    """Day positions of every replicate: consecutive blocks, cut at the length of the span."""
    blocks = -(-n_days // block)
    ids = spark.range(n_boot * blocks).select(
        F.expr(f"id div {blocks}").alias("b"), (F.col("id") % blocks).alias("j")
    )
    drawn = ids.withColumn("start", block_starts(n_days, n_boot, block, seed))
    offsets = F.sequence(F.lit(0), F.lit(block - 1))
    days = drawn.select("b", "j", "start", F.explode(offsets).alias("o"))
    return days.where(F.col("j") * block + F.col("o") < n_days).select(
        "b", (F.col("start") + F.col("o")).alias("pos")
    )


def block_bootstrap(
    errors: DataFrame,
    models: list[str],
    focal: list[str],
    rivals: list[str],
    n_days: int,
    n_boot: int = N_BOOTSTRAP,
    block: int = BLOCK_DAYS,
    seed: int = SEED,
    q: float = FDR_Q,
) -> DataFrame:
    """Moving-block bootstrap of the gap between two families' best MAE per subgroup.

    Whole days are resampled, a day brings its subgroups along, and each replicate chooses the
    best of both families anew. The joined side is bounded by days x subgroups.
    """
    inferential = [s for s in SUBGROUPS if s not in EXCLUDED_SUBGROUPS]
    sums = errors.where(F.col("subgroup").isin(inferential))
    at = {m: f"e{i}" for i, m in enumerate(models)}

    def best(members: list[str]) -> Column:
        means = [F.col(at[m]) / F.col("n") for m in members]
        return F.least(*means) if len(means) > 1 else means[0]

    gap = best(focal) - best(rivals)
    observed = (
        sums.groupBy("subgroup")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_days"), *[F.sum(c).alias(c) for c in at.values()])
        .where(F.col("n_days") >= MIN_N_INFERENTIAL)
        .select("subgroup", "n", "n_days", gap.alias("delta_MAE"))
    )
    draws = resampled_days(errors.sparkSession, n_days, n_boot, block, seed)
    joined = draws.join(small_side(sums, n_days * len(SUBGROUPS)), "pos")
    replicates = (
        joined.groupBy("b", "subgroup")
        .agg(F.count("*").alias("drawn"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in at.values()])
        .where(F.col("drawn") >= MIN_N_INFERENTIAL)
        .select("b", "subgroup", gap.alias("delta"))
    )
    ends = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    below = F.avg((F.col("delta") <= 0).cast("double"))
    above = F.avg((F.col("delta") >= 0).cast("double"))
    spread = replicates.groupBy("subgroup").agg(
        (F.count("*") / F.lit(float(n_boot))).alias("frac_usable"),
        ends.alias("_ends"),
        F.least(F.lit(1.0), F.lit(2.0) * F.least(below, above)).alias("p_raw"),
    )
    shown = F.col("frac_usable") >= USABLE_MIN
    table = observed.join(spread, "subgroup", "left").select(
        "subgroup",
        "n",
        "n_days",
        "delta_MAE",
        F.when(shown, F.col("_ends")[0]).alias("ci_low"),
        F.when(shown, F.col("_ends")[1]).alias("ci_high"),
        "p_raw",
        F.coalesce("frac_usable", F.lit(0.0)).alias("frac_usable"),
    )
    return bh_adjust(table, [], "p_raw", "subgroup", q)


def subgroup_verdicts(wins: DataFrame, boot: DataFrame) -> DataFrame:
    """The reading of every subgroup: first on test, again on validation, and significant.

    ``n_test`` and ``n_val`` are days, as in the bootstrap.
    """

    def on(scope: str, column: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    sides = wins.groupBy("subgroup").agg(
        *[on(s, "n_days").alias(f"n_{s}") for s in ("test", "val")],
        *[on(s, "focal_ranks_first").alias(f"first_{s}") for s in ("test", "val")],
    )
    joined = sides.join(boot.select("subgroup", "significant"), "subgroup", "left")
    n_test, n_val = (F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in ("test", "val"))
    first = F.coalesce("first_test", F.lit(False))
    replicated = F.coalesce("first_val", F.lit(False)) & (n_val >= MIN_N_INFERENTIAL)
    verdict = (
        F.when(F.col("subgroup").isin(EXCLUDED_SUBGROUPS), VERDICT_EXCLUDED)
        .when(n_test < MIN_N_INFERENTIAL, VERDICT_NON_INFER)
        .when(first & replicated & F.coalesce("significant", F.lit(False)), VERDICT_WIN)
        .when(first, VERDICT_RANK_ONLY)
        .otherwise(VERDICT_NO_WIN)
    )
    return joined.select(
        "subgroup", n_test.alias("n_test"), n_val.alias("n_val"), verdict.alias("verdict")
    )
