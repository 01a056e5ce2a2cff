"""Integrity checks. Each returns its offenders as rows; ``require_empty`` makes one fatal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.operators.panel import KEYS, Span, part_total


def require_empty(offenders: DataFrame, message: str, examples: int = 5) -> None:
    """Raise with a few examples if a check returned rows."""
    found = offenders.limit(examples).collect()
    if found:
        raise ValueError(f"{message}, e.g. {[row.asDict() for row in found]}")


def require_columns(df: DataFrame, columns: list[str], where: str) -> None:
    """Raise before any job if a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing required column(s) {missing}")


def duplicate_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def lost_rows(sources: dict[str, DataFrame], merged: DataFrame) -> DataFrame:
    """Dates each source had and the inner join dropped, tagged with the source."""
    survivors = merged.select("date").distinct()
    gone = [
        frame.select("date").distinct().join(survivors, "date", "left_anti").select(
            F.lit(name).alias("source"), "date"
        )
        for name, frame in sources.items()
    ]
    return reduce(DataFrame.unionByName, gone)


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Missing days between the first and the last day of each series.

    A row followed by a later day than the next one opens a gap; only gaps are expanded.
    """
    from daybook.operators.panel import by_series

    following = panel.select(*KEYS, F.lead("date").over(by_series()).alias("following"))
    open_gaps = following.where(F.datediff("following", "date") > 1)
    days = F.sequence(
        F.date_add("date", 1), F.date_sub("following", 1), F.expr("interval 1 day")
    )
    return open_gaps.select("series_id", F.explode(days).alias("date"))


def null_census(df: DataFrame) -> DataFrame:
    """Null count per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return melt_row(counts, df.columns, "column_name", "n_nulls", "long")


def melt_row(row: DataFrame, columns: list[str], key: str, value: str, cast: str) -> DataFrame:
    """Turn chosen columns of a small frame into rows, keeping the others as keys."""
    ids = [c for c in row.columns if c not in columns]
    wide = row.select(*ids, *[F.col(c).cast(cast).alias(c) for c in columns])
    return wide.unpivot(ids, columns, key, value)


def part_sum_residual(df: DataFrame, parts: list[str], total: str = "total") -> DataFrame:
    """Largest absolute difference between the parts and the total, per series."""
    gap = F.max(F.abs(part_total(parts) - F.col(total)))
    return df.groupBy("series_id").agg(gap.alias("max_residual"))


def integrity_report(df: DataFrame, parts: list[str], total: str = "total") -> DataFrame:
    """Five invariants per series with expected value, observed value and verdict.

    Rows are first counted per day, so that duplicates show without a distinct aggregate.
    """
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    per_day = df.groupBy(*KEYS).agg(
        F.count("*").alias("rows"),
        F.sum(nulls).alias("nulls"),
        F.max(F.abs(part_total(parts) - F.col(total))).alias("residual"),
    )
    facts = per_day.groupBy("series_id").agg(
        F.sum("rows").alias("n_rows"),
        F.count("*").alias("n_dates"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("n_span"),
        F.sum("nulls").alias("n_nulls"),
        F.max("residual").cast("long").alias("max_residual"),
    )
    zero = F.lit(0).cast("long")
    checks = [
        ("filas", F.col("n_span"), F.col("n_rows")),
        ("huecos de calendario", zero, F.col("n_span") - F.col("n_dates")),
        ("fechas duplicadas", zero, F.col("n_rows") - F.col("n_dates")),
        ("valores nulos", zero, F.col("n_nulls")),
        ("suma de operadores == total", zero, F.col("max_residual")),
    ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("check_name"),
                    expected.alias("expected"),
                    observed.alias("observed"),
                    F.when(expected == observed, "OK").otherwise("FALLO").alias("verdict"),
                )
                for name, expected, observed in checks
            ]
        )
    )
    return facts.select("series_id", rows.alias("r")).select("series_id", "r.*")


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, and the row count, dates and gaps of the whole frame."""
    per_key = df.groupBy(*KEYS).agg(
        F.count("*").alias("_rows"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{c}") for c in df.columns],
    )
    per_series = per_key.groupBy("series_id").agg(
        F.sum("_rows").alias("_rows"),
        F.count("*").alias("_keys"),
        F.min("date").alias("_low"),
        F.max("date").alias("_high"),
        *[F.sum(f"_null_{c}").alias(f"_null_{c}") for c in df.columns],
    )
    whole = per_series.agg(
        F.sum("_rows").alias("n_rows"),
        F.min("_low").alias("first_date"),
        F.max("_high").alias("last_date"),
        F.sum(F.datediff("_high", "_low") + 1 - F.col("_keys")).alias("missing_days"),
        F.sum(F.col("_rows") - F.col("_keys")).alias("duplicates"),
        *[F.sum(f"_null_{c}").alias(c) for c in df.columns],
    )
    counts = melt_row(whole, df.columns, "column_name", "n_nulls", "long")
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return counts.withColumn("data_type", types[F.col("column_name")])


def domain_guard(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Values of a column outside its declared levels, with their row counts."""
    outside = df.where(F.col(column).isNotNull() & ~F.col(column).isin(levels))
    return outside.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count("*").alias("n_rows")
    )


def unmatched_features(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Prediction keys without a feature row."""
    return predictions.select(*KEYS).join(features.select(*KEYS), KEYS, "left_anti")


def column_digest(column: Column, keys: list[str] = KEYS) -> Column:
    """Digest of a column over all rows of an aggregate, whatever their order.

    Every row gives a hash of its key and its value, and the hashes are merged by exclusive or, so
    equal columns have equal digests and nothing overflows. Keys are unique.
    """
    return F.bit_xor(F.xxhash64(*keys, column.cast("double") + F.lit(0.0)))


def leak_audit(
    df: DataFrame, features: list[str], same_day: list[str], parts: list[str], total: str = "total"
) -> DataFrame:
    """Look for same-day values in the feature matrix by comparing data, not names.

    A non-constant feature equal to a same-day column in every row is a leak, and so is a set of
    parts that adds up to the target. Columns are compared by their digests over the rows in which
    every feature is set (``n_rows`` of them), so one pass with one small value per column covers
    all pairs, however many there are.
    """
    whole = "+".join(parts)
    columns = {c: F.col(c) for c in dict.fromkeys([*features, *same_day, total])} | {whole: part_total(parts)}
    digests = [column_digest(column).alias(f"digest_{i}") for i, column in enumerate(columns.values())]
    spans = [(F.max(f) > F.min(f)).alias(f"varies_{f}") for f in features]
    seen = df.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features]))
    row = seen.agg(F.count("*").alias("n_rows"), *digests, *spans)
    place = {c: f"digest_{i}" for i, c in enumerate(columns)}

    def entry(feature: str, source: str, varies: Column) -> Column:
        alike = F.col(place[feature]) == F.col(place[source])
        leak = F.coalesce(alike & varies, F.lit(False)).alias("is_leak")
        return F.struct(F.lit(feature).alias("feature"), F.lit(source).alias("source"), "n_rows", leak)

    entries = [entry(f, s, F.col(f"varies_{f}")) for f in features for s in same_day]
    entries.append(entry(whole, total, F.lit(True)))
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def require_no_leak(df: DataFrame, features: list[str], same_day: list[str]) -> None:
    """Raise if a feature repeats a same-day column, or if no row has all features to tell."""
    audit = leak_audit(df, features, same_day, same_day[:1], same_day[0])
    only_features = audit.where(F.col("feature").isin(features) & (F.col("is_leak") | (F.col("n_rows") == 0)))
    require_empty(only_features, "same-day values in the feature matrix")


def require_whole_days(panel: DataFrame, span: Span) -> None:
    """Raise if a series lacks a day of the span or has one twice."""
    require_empty(duplicate_keys(panel), "duplicate series/date keys")
    short = panel.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") != span.n_days)
    require_empty(short, "series with missing days")
