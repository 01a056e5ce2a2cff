"""Stage 1: a linear model on the scaled history window, pooled over all series."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.constants import DEGENERATE_FOLD, MIN_INITIAL_TRAIN, N_FOLDS, SEQUENCE_WINDOW
from daybook.models import gram
from daybook.operators.guards import require_empty
from daybook.operators.panel import KEYS
from daybook.operators.splits import assign_folds, fold_clean_guard
from daybook.session import materialise


@dataclass(frozen=True)
class WindowModel:
    """Coefficients of the window (oldest day first), then of the other inputs, and the constant."""

    coefficients: DenseVector
    intercept: float


def train_cut(series: gram.Series) -> gram.Cut:
    """One setting: the training rows."""
    return gram.Cut(np.where(series["split"] == "train", 0, -1), [(0, 1)])


def stage1_window(
    rows: DataFrame, width: int = SEQUENCE_WINDOW, exog: list[str] = [], dealt: bool = False
) -> tuple[WindowModel, DataFrame]:
    """Fit on the training rows of a labelled frame and predict every row with full history."""
    ordered = gram.in_order(rows.select(*KEYS, "split", "total", *exog), dealt)
    beta = gram.solve(gram.sums(ordered, train_cut, width, exog)[0, 0], width)
    predicted = gram.forecast(ordered, train_cut, width, [(0, beta)], exog)
    value = F.col("forecasts")[0]
    columns = [*KEYS, "split", F.col("total").cast("double").alias("y_true"), value.alias("y_pred")]
    return WindowModel(DenseVector(beta[1:]), float(beta[0])), predicted.where(value.isNotNull()).select(*columns)


def oof_predictions(
    training: DataFrame,
    width: int = SEQUENCE_WINDOW,
    n_folds: int = N_FOLDS,
    first: int = MIN_INITIAL_TRAIN,
    dealt: bool = False,
) -> DataFrame:
    """Predictions of each training row by a model that ended before its block.

    Fold f is fitted on the rows before its block: the sums of products of the blocks, added up
    from the first, give all fits from one pass. Scaler and model of a fold see earlier rows only.
    The folds of ``dealt`` rows are numbered again in each pass, which costs less than to store and
    move all rows.
    """
    folded = assign_folds(training.select(*KEYS, "total"), n_folds, first)
    require_empty(fold_clean_guard(folded).where("not is_clean"), "fold trained on later days")
    rows = gram.in_order(folded if dealt else materialise(folded, "folds"), dealt)

    def earlier(series: gram.Series) -> gram.Cut:
        return gram.Cut(np.maximum(series["fold"], 0).copy(), [(0, fold) for fold in range(1, n_folds + 1)])

    found = gram.sums(rows, earlier, width)
    fits = [(setting, gram.solve(products, width)) for (setting, _), products in sorted(found.items())]
    predicted = gram.forecast(rows, earlier, width, fits, own=lambda series: series["fold"] - 1)
    value = F.when(F.col("has_oof"), F.array_max("forecasts"))
    flags = ["fold", "has_oof", "exclusion_reason"]
    return predicted.select(*KEYS, F.col("total").alias("y_true"), "pos", *flags, value.alias("y_pred_oof"))


def residual_set(
    oof: DataFrame, features: DataFrame, names: list[str], excluded_fold: int = DEGENERATE_FOLD
) -> DataFrame:
    """Held-out residuals outside the excluded fold, with their features; nulls are an error."""
    kept = oof.where(F.col("has_oof") & (F.col("fold") != excluded_fold))
    rows = kept.withColumn("residual", F.col("y_true") - F.col("y_pred_oof"))
    joined = rows.join(features.select(*KEYS, *names), KEYS, "left")
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    whole = F.when(absent, F.raise_error(F.lit("residual row without features"))).otherwise(F.col("residual"))
    return joined.withColumn("residual", whole).select(
        *KEYS, "residual", "y_true", "y_pred_oof", "fold", *names
    )
