"""Controlled comparisons: window length, training size, feature parity and feature blocks.

The loops run over settings, never over data; every fit and every score is a Spark job.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.constants import (
    ABLATION_SUBSETS,
    CURVE_FRACTIONS,
    CURVE_SEEDS,
    DEGENERATE_MIN,
    PARITY_SEEDS,
    SEED,
    SEQUENCE_WINDOW,
    WHOLE_SEEDS,
)
from daybook.functions.scoring import mae, metric_columns
from daybook.models import gram
from daybook.models.linear import stage1_window, train_cut
from daybook.models.trees import chrono_grid_search, fit_trees, predict_trees
from daybook.operators.panel import KEYS
from daybook.session import concurrently


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def health_columns(y: str = "y_true", p: str = "y_pred", tag: str = "") -> list[Column]:
    """Deviation ratio, correlation and degenerate flag of a set of predictions."""
    ratio = F.try_divide(F.stddev_samp(p), F.stddev_samp(y))
    corr = F.corr(p, y)
    bad = F.coalesce((ratio < DEGENERATE_MIN) & (corr < DEGENERATE_MIN), F.lit(False))
    return [ratio.alias(f"pred_std_ratio{tag}"), corr.alias(f"pred_actual_corr{tag}"), bad.alias(f"degenerate{tag}")]


SCORES = ["n", "MAE", "RMSE", "MAPE", "R2", "pred_std_ratio", "pred_actual_corr", "degenerate"]


def score_forecasts(forecasts: DataFrame, tags: list[dict[str, Column]]) -> DataFrame:
    """Scores of every place of the forecasts, one row each with its tags, in one aggregate."""
    wide = forecasts.select(
        F.col("total").cast("double").alias("y_true"),
        *[F.col("forecasts")[i].alias(f"p_{i}") for i in range(len(tags))],
    )
    columns = [
        c
        for i in range(len(tags))
        for c in (*metric_columns("y_true", f"p_{i}", f"_{i}"), *health_columns("y_true", f"p_{i}", f"_{i}"))
    ]
    rows = [
        F.struct(*[v.alias(k) for k, v in tag.items()], *[F.col(f"{m}_{i}").alias(m) for m in SCORES])
        for i, tag in enumerate(tags)
    ]
    return wide.agg(*columns).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def window_comparison(rows: DataFrame, windows: list[int], dealt: bool = False) -> DataFrame:
    """Validation metrics of stage 1 per window length; test rows are never read."""
    seen = rows.where("split in ('train', 'val')")

    def run(width: int) -> DataFrame:
        _, predicted = stage1_window(seen, width, dealt=dealt)
        scored = predicted.where("split = 'val'").agg(*metric_columns())
        return scored.select(F.lit(width).cast("long").alias("window"), "*")

    return _stack(concurrently(run, windows))


def tail_cut(fractions: list[float], width: int) -> gram.Cutter:
    """One setting per fraction: the rows with a whole window in the last share of the training rows."""

    def cut(series: gram.Series) -> gram.Cut:
        training = np.flatnonzero(series["split"] == "train")
        n = len(training)
        kept = [n if f >= 1 else round(f * n) for f in fractions]
        starts = [training[0] + n - m + width if n else 0 for m in kept]
        edges = sorted(set(starts))
        places = np.searchsorted(edges, np.arange(len(series["split"])), side="right") - 1
        segment = np.where(series["split"] == "train", places, -1)
        return gram.Cut(segment, [(edges.index(s), len(edges)) if n else None for s in starts])

    return cut


def learning_curve(
    rows: DataFrame,
    n_train: int,
    fractions: list[float] = CURVE_FRACTIONS,
    seeds: list[int] = CURVE_SEEDS,
    whole_seeds: list[int] = WHOLE_SEEDS,
    width: int = SEQUENCE_WINDOW,
    dealt: bool = False,
) -> DataFrame:
    """Validation scores of stage 1 when only the last share of the training days is used.

    ``rows`` is a labelled panel with ``n_train`` training rows a series (``dealt``: see ``in_order``). Every (fraction, seed) is a
    replicate with rows drawn with replacement; the whole training range also has ``whole_seeds``.
    The tails are nested, so one pass over the rows sums the products of all of them.
    """
    ordered = gram.in_order(rows.where("split in ('train', 'val')").select(*KEYS, "split", "total"), dealt)
    cut = tail_cut(fractions, width)
    found = gram.sums(ordered, cut, width, seeds=[*seeds, *whole_seeds])
    runs = [(i, s) for i, f in enumerate(fractions) for s in [*seeds, *(whole_seeds if f >= 1 else [])] if (i, s) in found]
    fits = [(i, gram.solve(found[i, s], width)) for i, s in runs]

    def tag(i: int, seed: int) -> dict[str, Column]:
        kept = n_train if fractions[i] >= 1 else round(fractions[i] * n_train)
        whole = {"train_rows": kept, "train_sequences": kept - width, "seed": seed, "rows_drawn": int(found[i, seed][0, 0])}
        return {"fraction": F.lit(fractions[i])} | {k: F.lit(v).cast("long") for k, v in whole.items()}

    forecasts = gram.forecast(ordered, cut, width, fits).where("split = 'val'")
    scored = score_forecasts(forecasts, [tag(*run) for run in runs])
    return scored.withColumnRenamed("MAE", "val_MAE")


def parity_control(
    rows: DataFrame,
    scopes: dict[str, list[str]],
    univariate: float,
    reference: float,
    seeds: list[int] = PARITY_SEEDS,
    width: int = SEQUENCE_WINDOW,
) -> DataFrame:
    """Stage 1 with features of the forecast day, and the share of the gap it closes, per scope and run.

    The sums of products of all features hold those of every scope, so scopes share one pass; runs
    are replicates with rows drawn with replacement.
    """
    names = list(dict.fromkeys(c for scope in scopes.values() for c in scope))
    ordered = gram.in_order(rows.where("split in ('train', 'val')").select(*KEYS, "split", "total", *names))
    found = gram.sums(ordered, train_cut, width, names, seeds)
    runs = [(scope, seed) for scope in scopes for seed in seeds]
    fits = [(0, gram.solve(found[0, seed], width, [names.index(c) for c in scopes[scope]])) for scope, seed in runs]

    def tag(scope: str, seed: int) -> dict[str, Column]:
        counts = {"n_exog": len(scopes[scope]), "window": width, "seed": seed}
        return {"scope": F.lit(scope)} | {k: F.lit(v).cast("long") for k, v in counts.items()}

    forecasts = gram.forecast(ordered, train_cut, width, fits, names).where("split = 'val'")
    scored = score_forecasts(forecasts, [tag(*run) for run in runs]).withColumnRenamed("MAE", "val_MAE")
    closed = F.try_divide(F.lit(100.0) * (F.lit(univariate) - F.col("val_MAE")), F.lit(univariate - reference))
    return scored.withColumn("gap_closed_pct", closed)


def block_ablation(
    vectors: DataFrame,
    groups: dict[str, str],
    candidates: list[dict],
    subsets: dict = ABLATION_SUBSETS,
    seed: int = SEED,
    holdout_from: dt.date | None = None,
) -> DataFrame:
    """Retune and refit per set of feature blocks, scored on validation and test.

    ``groups`` maps each feature to its block; ``vectors`` is a stored table of pooled rows.
    """
    training = vectors.where("split = 'train'")

    def run(setting: tuple[str, list[str]]) -> DataFrame:
        subset, blocks = setting
        names = [c for c, group in groups.items() if group in blocks]
        best, _ = chrono_grid_search(training, names, candidates, seed=seed, holdout_from=holdout_from)
        predicted = predict_trees(fit_trees(training, names, best, seed=seed), vectors.where("split <> 'train'"))
        return predicted.groupBy("split").agg(*metric_columns()).select(
            F.lit(subset).alias("subset"),
            F.lit(len(names)).cast("long").alias("n_features"),
            F.lit(",".join(blocks)).alias("blocks"),
            *[F.lit(float(v)).alias(k) for k, v in best.items()],
            *["split", "n", "MAE", "RMSE", "MAPE", "R2"],
        )

    return _stack(concurrently(run, subsets.items()))


def validation_mae(predicted: DataFrame) -> float:
    """Validation MAE as a number."""
    chosen = predicted.where("split = 'val'")
    return chosen.agg(mae(F.col("y_true"), F.col("y_pred"))).first()[0]
