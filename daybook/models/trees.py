"""Boosted trees on the feature matrix: direct, residual and weighted residual."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import IRREGULAR_WEIGHT, PREFIX, SEED, TREE_GRID
from daybook.models.boosting import dealt_errors
from daybook.operators.panel import KEYS
from daybook.operators.scaling import minmax_fit
from daybook.operators.splits import internal_holdout
from daybook.session import concurrently, materialise, shared_folder

#: Bins (rows times features) up to which a task holds the table of a fit.
TASK_BINS = 32_000_000
#: Bins up to which fits share the cluster; beyond, the copy that a fit keeps of its rows fills it.
SHARED_BINS = 1_000_000_000


def history_sources(names: list[str], values: list[str]) -> dict[str, str]:
    """Features in the units of a series, each with the value column it is made from."""
    return {f: c for f in names for c in values if f.startswith(f"{PREFIX}{c}_")}


def pooled_rows(rows: DataFrame, names: list[str], values: list[str], label: str = "total") -> DataFrame:
    """Labelled rows with target and history features in the training range of their series.

    The ranges are those of the value columns themselves, so fitting them does not compute any
    feature. A deviation has no origin and is only divided by the range. The scale of the
    target stays beside the row so that predictions can be brought back.
    """
    sources = history_sources(names, values)
    scaler = minmax_fit(rows.where("split = 'train'"), values)
    joined = rows.join(scaler, "series_id")

    def width(c: str) -> Column:
        span = F.col(f"{c}_max") - F.col(f"{c}_min")
        return F.when(span == 0, F.lit(1.0)).otherwise(span)

    def scaled(feature: str, c: str) -> Column:
        origin = F.lit(0.0) if "_roll_std_" in feature else F.col(f"{c}_min")
        return ((F.col(feature) - origin) / width(c)).alias(feature)

    return joined.select(
        *KEYS,
        "split",
        F.col(label).cast("double").alias("y_true"),
        scaled(label, label).alias("label"),
        F.col(f"{label}_min").alias("y_low"),
        width(label).alias("y_width"),
        *[scaled(f, sources[f]) if f in sources else F.col(f) for f in names],
    )


def grid(options: dict[str, list] = TREE_GRID) -> list[dict]:
    """Every combination of the listed parameter values."""
    return [dict(zip(options, values)) for values in product(*options.values())]


def fit_trees(
    training: DataFrame,
    names: list[str],
    params: dict,
    label: str = "label",
    weight: str | None = None,
    seed: int = SEED,
    subsampling: float = 1.0,
) -> PipelineModel:
    """Assemble the named features and boost trees on them; histograms are built by executors."""
    spark: SparkSession = training.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    learner = GBTRegressor(
        labelCol=label, featuresCol="features", seed=seed, subsamplingRate=subsampling, **params
    )
    if weight:
        learner = learner.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    columns = [label, *([weight] if weight else []), *names]
    return Pipeline(stages=[assembler, learner]).fit(training.select(*columns))


def predict_trees(model: PipelineModel, rows: DataFrame, out: str = "y_pred") -> DataFrame:
    """Predictions of the target in the units of the series."""
    scaled = model.transform(rows).drop("features")
    value = F.col("prediction") * F.col("y_width") + F.col("y_low")
    return scaled.withColumn(out, value).drop("prediction")


def stored_vectors(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Date, label and assembled features of all rows, written once for every fit that reads them."""
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    return materialise(assembler.transform(rows.select("date", label, *names)).select("date", label, "features"), "vectors")


def staged_errors(fit: DataFrame, held: DataFrame, params: dict, label: str, seed: int) -> list[tuple[float, float]]:
    """Mean absolute and root mean squared error on held-out vectors after each tree of one fit."""
    model = GBTRegressor(labelCol=label, featuresCol="features", seed=seed, **params).fit(fit)
    scored = held.select("features", F.col(label).cast("double").alias(label))
    absolute, squared = [model.evaluateEachIteration(scored, loss) for loss in ("absolute", "squared")]
    return [(a, s**0.5) for a, s in zip(absolute, squared)]


def chrono_grid_search(
    training: DataFrame,
    names: list[str],
    candidates: list[dict],
    label: str = "label",
    seed: int = SEED,
    holdout_from: dt.date | None = None,
    task_bins: int = TASK_BINS,
) -> tuple[dict, DataFrame]:
    """Choose parameters on the last training days; the result is the leaderboard of all candidates.

    Candidates that differ in the number of trees alone share one fit of the largest: a boosted
    model holds all shorter ones, so its error after n trees is that of the candidate with n trees.
    ``holdout_from`` is the first held-out day where every series has the same days, a literal that
    reaches the scan of the stored vectors; without it the last rows of each series are held out.
    Up to ``task_bins`` rows times features a fit is a task; beyond, the rows of each fit are spread.
    """
    spark: SparkSession = training.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if holdout_from:
        vectors = stored_vectors(training, names, label)
        fit, held = [vectors.where(c) for c in (F.col("date") < holdout_from, F.col("date") >= holdout_from)]
    else:
        marked = internal_holdout(training)
        fit, held = [stored_vectors(marked.where(c), names, label) for c in ("not is_holdout", "is_holdout")]
    families: dict[tuple, list[int]] = {}
    for i, params in enumerate(candidates):
        shared = tuple(sorted((k, v) for k, v in params.items() if k != "maxIter"))
        families.setdefault(shared, []).append(i)

    def score(family: tuple[tuple, list[int]]) -> list[tuple[int, float, float]]:
        shared, members = family
        largest = max(candidates[i]["maxIter"] for i in members)
        errors = staged_errors(fit, held, {**dict(shared), "maxIter": largest}, label, seed)
        return [(i, *errors[candidates[i]["maxIter"] - 1]) for i in members]

    n_fit = fit.count()
    bins = (n_fit + held.count()) * len(names)
    if bins <= task_bins and all(set(params) == set(TREE_GRID) for params in candidates):
        # the deepest first, as they take longest
        dealt = sorted(families.items(), key=lambda family: -dict(family[0])["maxDepth"])
        settings = [(dict(shared), [candidates[i]["maxIter"] for i in members]) for shared, members in dealt]
        errors = [{n: e for n, *e in found} for found in dealt_errors(fit, held, n_fit, settings, label, seed)]
        found = sorted((i, *e[candidates[i]["maxIter"]]) for (_, members), e in zip(dealt, errors) for i in members)
    else:
        scores = concurrently(score, families.items()) if bins <= SHARED_BINS else map(score, families.items())
        found = sorted(row for rows in scores for row in rows)
    keys = list(candidates[0])
    rows = [(i, *[float(candidates[i][k]) for k in keys], *errors) for i, *errors in found]
    schema = ", ".join(["candidate long", *[f"{k} double" for k in keys], "holdout_mae double", "holdout_rmse double"])
    board = spark.createDataFrame(rows, schema)
    best = min(rows, key=lambda r: (r[-2], *r[1 : 1 + len(keys)], r[0]))
    return candidates[best[0]], board


def importance_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Importance of every feature of a fitted pipeline: one row per model column."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def irregular_weight(columns: list[str]) -> Column:
    """Weight of a row: larger if any of the flags is set."""
    flags = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return F.when(flags > 0, F.lit(IRREGULAR_WEIGHT)).otherwise(F.lit(1.0))


def hybrid_combine(stage1: DataFrame, corrections: DataFrame, out: str = "y_pred") -> DataFrame:
    """Stage-1 prediction plus predicted residual; a prediction without a correction is an error."""
    joined = stage1.join(corrections.select(*KEYS, "e_pred"), KEYS, "left")
    fault = F.raise_error(F.concat(F.lit("no correction for "), F.concat_ws(" ", *KEYS)))
    joined = joined.withColumn("e_pred", F.coalesce("e_pred", fault.cast("double")))
    return joined.select(
        *KEYS,
        "split",
        "y_true",
        F.col("y_pred").alias("y_pred_stage1"),
        "e_pred",
        (F.col("y_pred") + F.col("e_pred")).alias(out),
    )
