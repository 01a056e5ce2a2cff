"""Chronological splits, warm-up, folds and holdouts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import (
    FLOOR_EPSILON,
    HOLDOUT_FRACTION,
    MIN_INITIAL_TRAIN,
    N_FOLDS,
    TRAIN_FRACTION,
    VAL_FRACTION,
    WARMUP_DAYS,
)
from daybook.operators.guards import require_whole_days
from daybook.operators.panel import Span, by_series, date_span

SPLITS = ["train", "val", "test"]


@dataclass(frozen=True)
class SplitBounds:
    """Inclusive first and last day of each split."""

    train: tuple[dt.date, dt.date]
    val: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]

    def days(self, split: str) -> int:
        first, last = getattr(self, split)
        return (last - first).days + 1


def split_span(
    span: Span, train_fraction: float = TRAIN_FRACTION, val_fraction: float = VAL_FRACTION
) -> SplitBounds:
    """Cut a gap-free span at the floors of the cumulative fractions."""
    if not (0 < train_fraction < 1 and 0 < val_fraction < 1):
        raise ValueError("split fractions must lie between 0 and 1")
    if train_fraction + val_fraction >= 1:
        raise ValueError("split fractions leave no test days")
    n = span.n_days
    cuts = [int(f * n + FLOOR_EPSILON) for f in (train_fraction, train_fraction + val_fraction)]
    if not 0 < cuts[0] < cuts[1] < n:
        raise ValueError(f"a split would be empty for {n} days")
    edges = [0, *cuts, n]
    spans = [
        (span.start + dt.timedelta(days=a), span.start + dt.timedelta(days=b - 1))
        for a, b in zip(edges, edges[1:])
    ]
    return SplitBounds(*spans)


def chronological_split(panel: DataFrame, **fractions: float) -> SplitBounds:
    """Split a panel whose every series covers every day; refuses gaps and duplicates."""
    span = date_span(panel)
    require_whole_days(panel, span)
    return split_span(span, **fractions)


def in_split(bounds: SplitBounds, split: str, column: str = "date") -> Column:
    """Inclusive date range of one split; literals, so it reaches a Parquet scan."""
    first, last = getattr(bounds, split)
    return F.col(column).between(F.lit(first), F.lit(last))


def split_label(bounds: SplitBounds, column: str = "date") -> Column:
    """train, val, test or unassigned."""
    label = F
    for split in SPLITS:
        label = label.when(in_split(bounds, split, column), F.lit(split))
    return label.otherwise(F.lit("unassigned"))


def split_filter(df: DataFrame, bounds: SplitBounds, split: str) -> DataFrame:
    return df.where(in_split(bounds, split))


def label_split(df: DataFrame, bounds: SplitBounds) -> DataFrame:
    return df.withColumn("split", split_label(bounds))


def split_summary(df: DataFrame) -> DataFrame:
    """First day, last day, days and share of each split of a labelled frame."""
    days = df.groupBy("split", "date").agg(F.count("*").alias("rows"))
    per_split = days.groupBy("split").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_days"),
        F.sum("rows").alias("n_rows"),
    )
    share = F.lit(100.0) * F.col("n_days") / F.sum("n_days").over(Window.partitionBy())
    return per_split.withColumn("share_pct", share)


def apply_warmup(df: DataFrame, bounds: SplitBounds, rows: int = WARMUP_DAYS) -> DataFrame:
    """Drop the first rows of each series, and refuse a warm-up that reaches validation."""
    if rows < 0:
        raise ValueError("warm-up rows must not be negative")
    if rows == 0:
        return df
    numbered = df.withColumn("_rank", F.row_number().over(by_series()))
    val_start = F.lit(bounds.val[0])
    reaches = (F.col("_rank") <= rows) & (F.col("date") >= val_start)
    checked = F.when(
        reaches, F.raise_error(F.lit("warm-up reaches the validation split"))
    ).otherwise(F.col("_rank") > rows)
    return numbered.where(checked).drop("_rank")


def fold_boundaries(
    n_rows: int, n_folds: int = N_FOLDS, first: int = MIN_INITIAL_TRAIN
) -> list[tuple[int, int]]:
    """Expanding folds as (train end, block end) positions; the last block takes the rest."""
    if n_folds < 1 or n_rows - first < n_folds:
        raise ValueError(f"{n_rows} rows cannot form {n_folds} folds after {first} rows")
    block = (n_rows - first) // n_folds
    ends = [first + k * block for k in range(n_folds)]
    return list(zip(ends, [*ends[1:], n_rows]))


def fold_table(training: DataFrame, n_folds: int = N_FOLDS, first: int = MIN_INITIAL_TRAIN) -> DataFrame:
    """Fold boundaries of every series, from its own number of training rows."""
    sizes = training.groupBy("series_id").agg(F.count("*").alias("n_rows"))
    folds = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    block = F.floor((F.col("n_rows") - first) / n_folds)
    return folds.select(
        "series_id",
        F.col("fold").cast("long").alias("fold"),
        (F.lit(first) + (F.col("fold") - 1) * block).cast("long").alias("train_end"),
        F.when(F.col("fold") == n_folds, F.col("n_rows"))
        .otherwise(F.lit(first) + F.col("fold") * block)
        .cast("long")
        .alias("block_end"),
    )


def assign_folds(training: DataFrame, n_folds: int = N_FOLDS, first: int = MIN_INITIAL_TRAIN) -> DataFrame:
    """Number the training rows of each series and give each its fold, -1 before the first.

    Position and length come from windows over the series, so no join is needed.
    """
    whole = Window.partitionBy("series_id")
    pos = (F.row_number().over(by_series()) - 1).cast("long")
    block = F.floor((F.count("*").over(whole) - first) / n_folds)
    numbered = training.withColumns({"pos": pos, "_block": block})
    reached = F.lit(1) + F.floor((F.col("pos") - first) / F.col("_block"))
    fold = F.when(F.col("pos") < first, F.lit(-1)).otherwise(F.least(F.lit(n_folds), reached))
    reason = F.when(F.col("pos") < first, F.lit(f"within the first {first} training rows"))
    return numbered.withColumns(
        {
            "fold": fold.cast("long"),
            "has_oof": F.col("pos") >= first,
            "exclusion_reason": reason,
        }
    ).drop("_block")


def fold_clean_guard(folded: DataFrame) -> DataFrame:
    """Per fold and series: last training day, first held-out day, and whether they are in order.

    Rows of fold f train every later fold, so the last training day is a running maximum.
    """
    spans = folded.groupBy("series_id", "fold").agg(
        F.min("date").alias("block_start"), F.max("date").alias("_end")
    )
    w = Window.partitionBy("series_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    out = spans.withColumn("train_end", F.max("_end").over(w)).where(F.col("fold") > 0)
    return out.select(
        "series_id",
        "fold",
        "train_end",
        "block_start",
        (F.col("train_end") < F.col("block_start")).alias("is_clean"),
    )


def internal_holdout(training: DataFrame, fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    """Mark the last share of the training rows of each series, rounded half to even."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    rank = F.row_number().over(by_series())
    held = F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("long"))
    return training.withColumn("is_holdout", rank > n - held)


def holdout_start(first: dt.date, last: dt.date, fraction: float = HOLDOUT_FRACTION) -> dt.date:
    """First held-out day of ``internal_holdout`` where every series has every day from first to last."""
    n = (last - first).days + 1
    return last - dt.timedelta(days=max(1, round(n * fraction)) - 1)


def train_rows_tail(training: DataFrame, m: int) -> DataFrame:
    """The last ``m`` training rows of each series."""
    newest = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    return training.withColumn("_rank", F.row_number().over(newest)).where(f"_rank <= {m}").drop("_rank")


def training_split(features: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Training rows after the warm-up."""
    return split_filter(apply_warmup(features, bounds), bounds, "train")


def eval_frame(features: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Every row after the warm-up, with its split."""
    return label_split(apply_warmup(features, bounds), bounds)


def key_span(df: DataFrame) -> DataFrame:
    """Rows, first and last day of each series."""
    return df.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


