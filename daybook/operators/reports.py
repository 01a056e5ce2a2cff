"""Stored results put together for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import TARGET_LAGS
from daybook.operators.reshape import in_row_order, side_by_side


def acf_report(acf: DataFrame, ljung_box: DataFrame) -> DataFrame:
    """The lags used as features, with the portmanteau statistic where there is one."""
    chosen = acf.where(F.col("lag").isin(TARGET_LAGS)).select("series_id", "lag", "acf", "band", "outside_band")
    return chosen.join(ljung_box, ["series_id", "lag"], "left")


def top_correlations(correlations: DataFrame, n: int = 10) -> DataFrame:
    """The strongest partial correlations of every series."""
    order = Window.partitionBy("series_id").orderBy(
        F.abs("spearman_partial").desc_nulls_last(), "feature"
    )
    ranked = correlations.withColumn("position", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("position") <= n)


def split_blocks(metrics: DataFrame, order: list[str]) -> DataFrame:
    """Comparison rows of validation and test in a fixed model order."""
    return in_row_order(metrics.where("split <> 'train'"), "model", order)


def validation_beside_test(metrics: DataFrame) -> DataFrame:
    """MAE and R2 of both splits in one row per model, with the change between them."""
    wide = side_by_side(metrics, ["MAE", "R2"])
    return wide.withColumn("MAE_change", F.col("test_MAE") - F.col("val_MAE"))


def weights_report(weights: DataFrame) -> DataFrame:
    """Ensemble members, their validation error and weight, in one row per split."""
    return weights.groupBy("split").agg(
        F.sort_array(F.collect_list(F.concat_ws("=", "model", F.format_number("weight", 4)))).alias("w")
    ).select("split", F.concat_ws(", ", "w").alias("weights"))


def fold_report(log: DataFrame, health: DataFrame, keys: list[str]) -> DataFrame:
    """Fold log with the health of each fold's predictions."""
    return log.join(health.drop("n"), keys, "left")


def subgroup_report(metrics: DataFrame, wins: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Win table of both scopes in one row per subgroup, with its verdict."""
    cells = [
        F.max(F.when(F.col("scope") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("val", "test")
        for c in ("best_model", "best_MAE", "best_focal", "best_focal_MAE")
    ]
    wide = wins.groupBy("subgroup").agg(*cells)
    sizes = metrics.groupBy("subgroup").agg(F.max("n").alias("largest_n"))
    return wide.join(sizes, "subgroup").join(verdicts.select("subgroup", "verdict"), "subgroup", "left")
