"""Importance resampling: draw documents whose hashed n-grams look like a target's.

Each document is turned once into the array of its features' buckets, which is stored; bucket
counts of both sides give one gain per bucket, and the arrays are scored in Arrow batches by
indexing that array of gains. Gumbel noise from a keyed hash of the doc_id makes the highest
scores a draw without replacement. The cutoff is found by bisection: jobs that count the stored
rows at or above ``STEPS`` thresholds narrow the score, then the doc_id among rows tied at it, so
nothing is sorted but the drawn rows, which are dealt by ranges of their order to be ranked.

The driver holds bucket counts, gains (``Settings.buckets`` numbers each) and thresholds. A null
text has no features; a null doc_id is drawn after all others of its score, its key is empty text.
Rows that share doc_id and score take neighbouring ranks, those with fewer features first; if the
limit falls among them, only as many as fit are drawn. Empty tables give no rows, an empty target
gives gains from the smoothing alone. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.numbering import numbered
from daybook.llm.text import lower_ascii, stage

NOT_IN_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Thresholds that one job counts; it narrows an interval to one part of STEPS + 1.
STEPS = 31
#: Order of a null doc_id, behind all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """Buckets of the features, key of the noise, and who is drawn."""

    buckets: int = 10_000
    key: str = "7"
    least_words: int = 20
    percent: int = 25


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, in lower case."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_IN_WORD), lambda w: w != "")


def bucketed(texts: DataFrame, settings: Settings) -> DataFrame:
    """Texts with ``n_words`` and ``buckets``, the bucket of every word and pair of neighbours."""
    found = texts.withColumn("_words", words(F.col("text"))).drop("text")
    follows = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    heads = F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = F.zip_with(heads, follows, lambda a, b: F.concat(a, F.lit(" "), b))

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % settings.buckets).cast("int")

    numbers = F.concat(F.transform("_words", bucket), F.transform(pairs, bucket))
    return found.select("*", F.size("_words").alias("n_words"), numbers.alias("buckets")).drop("_words")


def _counted(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket: how often it occurs in all batches of a task."""
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])


def bucket_counts(rows: DataFrame, settings: Settings) -> np.ndarray:
    """How often each bucket occurs in the stored arrays; tasks send one row per bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, settings.buckets)

    sums = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(settings.buckets, np.int64)
    for bucket, n in sums.collect():  # at most settings.buckets rows
        counts[bucket] = n
    return counts


def gains(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target over corpus, of every bucket."""
    size, all_held, all_wanted = len(held), float(held.sum()), float(wanted.sum())
    ratio = (wanted + 1.0) * (all_held + size) / ((held + 1.0) * (all_wanted + size))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weighted(batch: pa.RecordBatch, gain: np.ndarray) -> pa.RecordBatch:
    """Array of buckets replaced by their number and the floored mean of their gains."""
    arrays = batch.column("buckets")
    ends = np.cumsum(np.r_[0, gain[arrays.flatten().to_numpy(zero_copy_only=False)]])
    offsets = np.r_[0, np.cumsum(arrays.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    n = np.diff(offsets)
    sums = ends[offsets[1:]] - ends[offsets[:-1]]
    names = [c for c in batch.schema.names if c != "buckets"]
    columns = [batch.column(c) for c in names]
    means = np.where(n > 0, sums // np.maximum(n, 1), 0)
    return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(means)], [*names, "n_features", "weight"])


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows with ``n_features`` and ``weight`` instead of the array of buckets."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _weighted(batch, gain)

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name != "buckets")
    return rows.mapInArrow(weigh, f"{kinds}, n_features long, weight long")


def noise(doc_id: Column, key: str) -> Column:
    """Thousandths of a standard Gumbel value, from a keyed hash of the doc_id."""
    text = F.concat(F.lit(f"{key}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def bisect(rows: DataFrame, value: Column, wanted: int, low: int, high: int) -> int:
    """Smallest bound in [low, high] such that at least ``wanted`` rows have a value of at most it.

    Each job counts the rows at or below ``STEPS`` bounds, evenly set between what is still open.
    """
    while low < high:
        bounds = sorted({low + (high - low) * k // (STEPS + 1) for k in range(1, STEPS + 1)})
        counts = rows.agg(*[F.count(F.when(value <= b, 1)).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
        enough = [b for b, n in zip(bounds, counts) if n >= wanted]
        few = [b for b, n in zip(bounds, counts) if n < wanted]
        high = min(enough, default=high)
        low = max(few) + 1 if few else low
    return low


def draw(scored: DataFrame, wanted: int) -> DataFrame:
    """Stored rows (doc_id, n_features, score, eligible, ...) with ``rank`` of the drawn ones.

    Drawn are the ``wanted`` highest scores among the eligible, ties to the smaller doc_id.
    """
    no_rank = F.lit(None).cast("long").alias("rank")
    if wanted <= 0:
        return scored.select("*", no_rank)
    able = scored.where("eligible")
    order = F.coalesce(F.col("doc_id"), F.lit(LAST))
    down = -F.col("score")
    least, most = able.agg(F.min(down), F.max(down)).first()
    score = bisect(able, down, wanted, least, most)
    above = able.where(down < score).count()
    tied = able.where(down == score)
    first, last = tied.agg(F.min(order), F.max(order)).first()
    final = bisect(tied, order, wanted - above, first, last)
    chosen = F.col("eligible") & ((down < score) | ((down == score) & (order <= final)))
    placed = numbered(
        scored.where(chosen).withColumns({"_all": F.lit(True), "_down": down, "_order": order}),
        ["_all"],
        [F.col("_down"), F.col("_order"), F.col("n_features")],
        "drawn",
    )
    rank = F.when(F.col("position") < wanted, F.col("position") + 1).alias("rank")
    rest = scored.where(~chosen).select("*", no_rank)
    return placed.select(*scored.columns, rank).union(rest)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score, and rank if it is drawn."""
    held = stage(bucketed(docs.select("doc_id", "text"), settings), "buckets")
    wanted = bucket_counts(bucketed(target.select("text"), settings), settings)
    gain = gains(bucket_counts(held, settings), wanted)
    scores = weighted(held, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.key))
    scored = stage(scores.withColumn("eligible", F.col("n_words") >= settings.least_words), "scores")
    able = scored.where("eligible").count()
    drawn = draw(scored, able * settings.percent // 100)
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
