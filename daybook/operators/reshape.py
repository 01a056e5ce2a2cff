"""Reshaping of predictions and small report tables, and comparisons of table keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import REL_FLOOR, VERIFY_RTOL
from daybook.operators.features import melt
from daybook.operators.guards import duplicate_keys, require_empty
from daybook.operators.panel import KEYS
from daybook.operators.scores import METRICS, lookup
from daybook.session import small_side

TIDY = [*KEYS, "split", "model", "y_true", "y_pred"]


def tidy_predictions(wide: DataFrame, models: list[str], y: str = "total") -> DataFrame:
    """Long predictions of one labelled wide frame; absent predictions are left out."""
    base = wide.withColumn("y_true", F.col(y).cast("double"))
    long = melt(base, [*KEYS, "split", "y_true"], models, "model", "y_pred")
    return long.where(F.col("y_pred").isNotNull()).select(*TIDY)


def union_predictions(frames: list[DataFrame]) -> DataFrame:
    """Stack tidy predictions of several artifacts."""
    return reduce(DataFrame.unionByName, frames)


def check_predictions(tidy: DataFrame) -> DataFrame:
    """The frame itself, once no row is unassigned and no key is repeated.

    The rows of a series and day are added up into one: their number, and the places of their models
    by three hashes. Only where all show fewer places than rows a model may be repeated, and only
    then are all keys counted.
    """
    require_empty(tidy.where("split = 'unassigned'"), "predictions outside every split")
    slots = [F.pmod(F.xxhash64("model", F.lit(i)), F.lit(63)).cast("int") for i in range(3)]
    places = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot)) for slot in slots]
    days = tidy.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.greatest(*map(F.bit_count, places)).alias("places"))
    if not days.where("places < n_rows").isEmpty():
        require_empty(duplicate_keys(tidy, [*KEYS, "model"]), "repeated predictions")
    return tidy


def available_models(tidy: DataFrame, order: list[str]) -> DataFrame:
    """Models present per split, numbered in the given order."""
    present = tidy.select("split", "model").distinct()
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return present.select("split", "model", place.cast("long").alias("position"))


def actual_vs_predicted(tidy: DataFrame, model: str, split: str) -> DataFrame:
    """Series of one model on one split."""
    chosen = tidy.where((F.col("model") == model) & (F.col("split") == split))
    return chosen.select(*KEYS, "y_true", "y_pred")


def assemble_wide(tidy: DataFrame, models: list[str]) -> DataFrame:
    """One column per model; conditional maxima instead of a join per model."""
    columns = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    return tidy.groupBy(*KEYS, "split").agg(F.max("y_true").alias("y_true"), *columns)


def eval_matrix(tidy: DataFrame, splits: list[str], models: list[str]) -> DataFrame:
    """Predictions of a scope by those of the listed models that cover every one of its keys.

    The semi-join's other side has at most one row per listed model.
    """
    scope = tidy.where(F.col("split").isin(splits))
    per_key = scope.groupBy(*KEYS).agg(F.count("*").alias("n"))
    keys = per_key.agg(F.count("*").alias("n_keys"))
    listed = scope.where(F.col("model").isin(models))
    covered = listed.groupBy("model").agg(F.count("y_pred").alias("n_pred"))
    complete = covered.where(F.col("n_pred") == keys.scalar()).select("model")
    return listed.join(small_side(complete, len(models)), "model", "left_semi").select(*TIDY)


def dedupe_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames in order; of rows with equal keys the earliest frame's is kept."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    order = Window.partitionBy(*keys).orderBy("_source")
    stacked = union_predictions(tagged).withColumn("_rank", F.row_number().over(order))
    return stacked.where("_rank = 1").drop("_rank", "_source")


def key_diff(new: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only one of two tables has."""
    lost = published.select(*keys).subtract(new.select(*keys)).withColumn("side", F.lit("missing"))
    extra = new.select(*keys).subtract(published.select(*keys)).withColumn("side", F.lit("extra"))
    return lost.unionByName(extra)


def verify_metrics(
    new: DataFrame, published: DataFrame, keys: list[str], drift: float, rtol: float = VERIFY_RTOL
) -> DataFrame:
    """Every metric cell of two runs: deviations and a verdict. Counts must match exactly."""
    both = []
    for frame, value in ((published, "published"), (new, "recomputed")):
        cells = frame.withColumn("n", F.col("n").cast("double"))
        both.append(melt(cells, keys, ["n", *METRICS], "metric", value))
    joined = both[0].join(both[1], [*keys, "metric"])
    gap = F.abs(F.col("recomputed") - F.col("published"))
    relative = gap / F.greatest(F.abs(F.col("published")), F.lit(REL_FLOOR))
    exact = F.when(gap == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    scored = joined.withColumns(
        {
            "abs_deviation": gap,
            "rel_deviation": F.when(F.col("metric") == "n", exact).otherwise(relative),
        }
    )
    verdict = (
        F.when(F.col("rel_deviation") <= rtol, "ok")
        .when(F.col("rel_deviation") <= drift, "environment drift")
        .otherwise("real change")
    )
    return scored.withColumn("verdict", verdict)


def require_same_metrics(
    new: DataFrame, published: DataFrame, keys: list[str], drift: float, rtol: float = VERIFY_RTOL
) -> None:
    """Raise on a missing or extra row, or on a cell beyond the tolerance."""
    require_empty(key_diff(new, published, keys), "metric tables cover different rows")
    cells = verify_metrics(new, published, keys, drift, rtol)
    require_empty(cells.where("verdict <> 'ok'"), "metrics outside tolerance", 10)


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    """The features with the largest importance."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def importance_by_group(importances: DataFrame, group: Column) -> DataFrame:
    """Importance, features and share per feature group; an unknown feature is an error."""
    fault = F.raise_error(F.concat(F.lit("feature without a group: "), F.col("feature")))
    sums = (
        importances.withColumn("group", F.coalesce(group, fault))
        .groupBy("group")
        .agg(F.sum("importance").alias("importance"), F.count("*").alias("n_features"))
    )
    share = F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy()))
    return sums.withColumn("share", F.coalesce(share, F.lit(0.0)))


def comparison_report(metrics: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Metrics rounded for reading, under display labels."""
    return metrics.select(
        "split",
        F.coalesce(lookup(labels, F.col("model")), F.col("model")).alias("label"),
        "n",
        F.bround("MAE", 0).alias("MAE"),
        F.bround("RMSE", 0).alias("RMSE"),
        F.bround("MAPE", 2).alias("MAPE"),
        F.bround("R2", 4).alias("R2"),
    )


def side_by_side(metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """Validation and test metrics of each model in one row."""
    cells = [
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("val", "test")
        for c in columns
    ]
    return metrics.groupBy("model").agg(*cells)


def in_row_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Keep the listed rows and number them in the listed order."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.where(F.col(column).isin(order)).withColumn("row", place.cast("long"))
