"""Queries over windows, calendar features, scaling, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.constants import DAY_TYPES, HOLIDAY_TYPES, SEQUENCE_WINDOW, TARGET_LAGS
from daybook.functions.calendar import calendar_names, day_index, fourier_names, is_weekend, one_hot
from daybook.functions.text import slug_column
from daybook.operators import features, guards, scaling, scores, splits
from daybook.operators.panel import KEYS, bridge_days
from daybook.plans import tables as T
from daybook.plans.registry import query
from daybook.plans.sql import R, rows, twin
from daybook.plans.workspace import Workspace, rounded

LAGS = [f"feat_{c}_lag_{k}" for c in T.VALUES for k in TARGET_LAGS]
ROLLING = [f"feat_total_roll_{s}_{w}" for w in (7, 28) for s in ("mean", "std")]
EXOG_FEATURES = [
    *[f"feat_{v}_lag_{k}" for v in T.EXOG for k in (1, 2, 3, 7)],
    *[f"feat_{v}_roll_mean_7" for v in T.EXOG],
]
ALL_FEATURES = [*LAGS, *ROLLING, *calendar_names(), *fourier_names(), *EXOG_FEATURES]


@query(
    "lag_features",
    twin(f"SELECT series_id, date, {rows(*LAGS)} FROM history", "history"),
)
def lag_features(ws: Workspace) -> DataFrame:
    return features.lag_features(ws.panel, T.VALUES)


@query(
    "rolling_features",
    twin(f"SELECT series_id, date, {rows(*[f'{R(c)} AS {c}' for c in ROLLING])} FROM history", "history"),
)
def rolling_features(ws: Workspace) -> DataFrame:
    return rounded(features.rolling_features(ws.panel))


@query(
    "exog_features",
    twin(f"SELECT date, {rows(*[f'{R(c)} AS {c}' for c in EXOG_FEATURES])} FROM exog_features", "exog_features"),
)
def exog_features(ws: Workspace) -> DataFrame:
    return rounded(features.exog_features(ws.exog, T.EXOG))


@query(
    "rolling_by_date",
    twin(
        f"""SELECT series_id, date, {R("avg(total) OVER w")} AS total_mean_28d, count(total) OVER w AS n_28d
        FROM sparse WINDOW w AS (PARTITION BY series_id ORDER BY date
        RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
        "sparse",
    ),
)
def rolling_by_date(ws: Workspace) -> DataFrame:
    return rounded(features.rolling_by_date(ws.sparse, 28))


@query(
    "bridge_day",
    twin("SELECT date, day_type, feat_is_bridge_day FROM days", "days"),
)
def bridge_day(ws: Workspace) -> DataFrame:
    return bridge_days(ws.calendar).select("date", "day_type", "feat_is_bridge_day")


@query(
    "sequence_windows",
    twin(
        f"""SELECT series_id, split, count(*) AS n, sum(total)::BIGINT AS y, sum(pos)::BIGINT AS pos,
        {rows(*[f"sum(lag_{k})::BIGINT AS v{28 - k}" for k in (28, 14, 1)])}
        FROM (SELECT series_id, split, total,
        row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
        {rows(*[f"lag(total, {k}) OVER (PARTITION BY series_id ORDER BY date) AS lag_{k}" for k in (28, 14, 1)])}
        FROM baselines) WHERE pos >= 28 GROUP BY series_id, split""",
        "baselines",
    ),
)
def sequence_windows(ws: Workspace) -> DataFrame:
    """Windows of 28 days: sums of chosen elements, targets and positions per series and split."""
    sequences = features.sequence_windows(ws.baselines.select(*KEYS, "split", "total"))
    return sequences.groupBy("series_id", "split").agg(
        F.count("*").alias("n"),
        F.sum("total").alias("y"),
        F.sum("pos").alias("pos"),
        *[F.sum(F.col("history")[i]).alias(f"v{i}") for i in (0, 14, 27)],
    )


@query(
    "usable_positions",
    twin(
        """SELECT series_id, date, pos FROM (SELECT series_id, date,
        row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM panel) WHERE pos >= 28""",
        "panel",
    ),
)
def usable_positions(ws: Workspace) -> DataFrame:
    return features.usable_positions(ws.panel, SEQUENCE_WINDOW)


@query(
    "exog_vector",
    twin(
        f"""SELECT series_id, {R(" + ".join(f"sum({c})" for c in EXOG_FEATURES), 2)} AS total_sum, count(*) AS n
        FROM baselines b JOIN exog_features x ON x.date = b.date GROUP BY series_id""",
        "baselines",
        "exog_features",
    ),
)
def exog_vector(ws: Workspace) -> DataFrame:
    """Row-t exogenous vector beside each target; the sum of all elements per series."""
    from pyspark.ml.functions import vector_to_array

    matrix = features.model_matrix(ws.labelled.select(*KEYS, "total", *EXOG_FEATURES), EXOG_FEATURES)
    element_sum = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v)
    sums = matrix.groupBy("series_id").agg(F.sum(element_sum).alias("total_sum"), F.count("*").alias("n"))
    return rounded(sums, 2)


@query(
    "one_hot_fixed",
    twin(f"SELECT date, {rows(*[c for c in calendar_names() if '_type_' in c])} FROM days", "days"),
)
def one_hot_fixed(ws: Workspace) -> DataFrame:
    return ws.calendar.select(
        "date", *one_hot("day_type", DAY_TYPES), *one_hot("holiday_type", HOLIDAY_TYPES)
    )


@query("is_weekend", twin("SELECT date, day_type, feat_is_weekend FROM days", "days"))
def weekend(ws: Workspace) -> DataFrame:
    return ws.calendar.select("date", "day_type", is_weekend())


@query("calendar_features", twin(f"SELECT date, {rows(*calendar_names())} FROM days", "days"))
def calendar_features(ws: Workspace) -> DataFrame:
    return features.calendar_features(ws.calendar)


@query(
    "day_index",
    "SELECT o_orderkey, date_diff('day', DATE '2023-01-01', o_orderdate::DATE)::INT AS day_index FROM orders",
)
def day_index_query(ws: Workspace) -> DataFrame:
    orders = T.table(ws.spark, ws.sf_dir, "orders")
    dated = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return dated.select("o_orderkey", day_index().alias("day_index"))


@query(
    "fourier_features",
    twin(f"SELECT date, {rows(*[f'{R(c)} AS {c}' for c in fourier_names()])} FROM days", "days"),
)
def fourier_features(ws: Workspace) -> DataFrame:
    return rounded(features.fourier_features(ws.calendar))


@query(
    "slugify",
    twin(
        """SELECT DISTINCT holiday_name AS label, trim(regexp_replace(translate(lower(holiday_name),
        'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM calendar
        UNION ALL SELECT DISTINCT o_orderpriority, trim(regexp_replace(translate(lower(o_orderpriority),
        'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', '_', 'g'), '_') FROM orders""",
        "calendar",
    ),
)
def slugify(ws: Workspace) -> DataFrame:
    """Holiday names and order priorities as column-name fragments."""
    names = ws.calendar.select(F.col("holiday_name").alias("label")).distinct()
    priorities = T.table(ws.spark, ws.sf_dir, "orders").select(F.col("o_orderpriority").alias("label"))
    labels = names.unionByName(priorities.distinct())
    return labels.select("label", slug_column("label").alias("slug"))


def _digits(feature: str) -> int:
    """Digits to compare an average to; prices are ten thousand times the size of the rest."""
    return 3 if "price" in feature else 6


FEATURE_MEANS = " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, count({c}) AS n, {R(f'avg({c})', _digits(c))} AS plain, "
    f"{R(f'avg({c} * day(date))', _digits(c))} AS by_day FROM features GROUP BY series_id"
    for c in ALL_FEATURES
)


@query("build_features", twin(FEATURE_MEANS, "features"))
def build_features(ws: Workspace) -> DataFrame:
    """The whole feature table, compared through means per series and feature."""
    day = F.dayofmonth("date")
    wide = ws.features.groupBy("series_id").agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("n"),
                F.round(F.avg(c), _digits(c)).alias("plain"),
                F.round(F.avg(F.col(c) * day), _digits(c)).alias("by_day"),
            ).alias(c)
            for c in ALL_FEATURES
        ]
    )
    return wide.select("series_id", F.explode(F.array(*ALL_FEATURES)).alias("r")).select("series_id", "r.*")


def feature_list(ws: Workspace) -> DataFrame:
    """Names of the feature columns of the panel, as rows."""
    counts = ws.features.groupBy().agg(*[F.count(c).alias(c) for c in ws.feature_names])
    return guards.melt_row(counts, ws.feature_names, "feature", "n", "long")


@query(
    "classify_feature",
    twin(
        """, f AS ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM features" for c in ALL_FEATURES)
        + """) SELECT feature, n, CASE WHEN feature LIKE 'feat_fourier_weekly%' THEN 'fourier_weekly'
        WHEN feature LIKE 'feat_fourier_annual%' THEN 'fourier_annual'
        WHEN feature LIKE 'feat_%_type_%' OR feature LIKE 'feat_is_%' THEN 'calendar'
        WHEN feature LIKE 'feat_total_lag%' THEN 'lag_total'
        WHEN feature LIKE 'feat_total_roll%' THEN 'rolling'
        WHEN feature LIKE 'feat_part%' THEN 'lag_operator' ELSE 'weather' END AS feature_group FROM f""",
        "features",
    ),
)
def classify_feature(ws: Workspace) -> DataFrame:
    """Valid rows and group of every feature column."""
    group = features.feature_group("feature", T.PARTS, T.EXOG)
    return feature_list(ws).select("feature", "n", group.alias("feature_group"))


@query(
    "feature_report",
    twin(
        "SELECT feature, n_nulls, first_valid_date, (SELECT min(date) FROM features WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in ALL_FEATURES)
        + ") AS first_complete_date FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_nulls, "
            f"min(date) FILTER ({c} IS NOT NULL) AS first_valid_date FROM features"
            for c in ALL_FEATURES
        )
        + ")",
        "features",
    ),
)
def feature_report(ws: Workspace) -> DataFrame:
    return features.feature_report(ws.features, ws.feature_names)


_TRAIN_RANGE = """, fit AS (SELECT series_id, min(total)::DOUBLE AS lo, max(total)::DOUBLE AS hi,
    avg(total) AS m, stddev_pop(total) AS s FROM baselines WHERE split = 'train' GROUP BY series_id)"""
_SCALED = "(total - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)"


@query(
    "minmax_fit",
    twin(f"{_TRAIN_RANGE} SELECT series_id, lo AS total_min, hi AS total_max FROM fit", "baselines"),
)
def minmax_fit(ws: Workspace) -> DataFrame:
    return scaling.minmax_fit(splits.split_filter(ws.baselines, ws.bounds, "train"), ["total"])


def scaled(ws: Workspace) -> DataFrame:
    base = ws.baselines.select(*KEYS, "split", "total")
    return scaling.minmax_transform(base, minmax_fit(ws), ["total"])


@query(
    "minmax_transform",
    twin(
        f"""{_TRAIN_RANGE} SELECT b.series_id, date, split, total, {R(_SCALED)} AS total_scaled
        FROM baselines b JOIN fit f ON f.series_id = b.series_id""",
        "baselines",
    ),
)
def minmax_transform(ws: Workspace) -> DataFrame:
    return rounded(scaled(ws))


@query(
    "minmax_inverse",
    twin(
        """SELECT series_id, split, count(*) AS n, 0.0::DOUBLE AS max_gap, sum(total)::DOUBLE AS restored
        FROM baselines GROUP BY series_id, split""",
        "baselines",
    ),
)
def minmax_inverse(ws: Workspace) -> DataFrame:
    """The round trip gives the original values back."""
    back = scaling.minmax_inverse(scaled(ws), minmax_fit(ws), "total", "total_scaled", "restored")
    gap = F.max(F.abs(F.col("restored") - F.col("total")))
    return rounded(
        back.groupBy("series_id", "split").agg(
            F.count("*").alias("n"), gap.alias("max_gap"), F.sum("restored").alias("restored")
        )
    )


@query(
    "standard_fit",
    twin(
        f"{_TRAIN_RANGE} SELECT series_id, {R('m')} AS total_mean, {R('s')} AS total_std FROM fit", "baselines"
    ),
)
def standard_fit(ws: Workspace) -> DataFrame:
    train = splits.split_filter(ws.baselines, ws.bounds, "train")
    return rounded(scaling.standard_fit(train, ["total"]))


@query(
    "standard_transform",
    twin(
        f"""{_TRAIN_RANGE} SELECT b.series_id, date, total,
        {R("(total - m) / (CASE WHEN s = 0 THEN 1 ELSE s END)", 5)} AS total_scaled
        FROM baselines b JOIN fit f ON f.series_id = b.series_id WHERE split = 'test'""",
        "baselines",
    ),
)
def standard_transform(ws: Workspace) -> DataFrame:
    train = splits.split_filter(ws.baselines, ws.bounds, "train")
    test = splits.split_filter(ws.baselines, ws.bounds, "test").select(*KEYS, "total")
    return rounded(scaling.standard_transform(test, scaling.standard_fit(train, ["total"]), ["total"]), 5)


@query(
    "feature_scaler",
    twin(
        ", fit AS (SELECT series_id, "
        + rows(*[f"min({c})::DOUBLE AS {c}_lo, max({c})::DOUBLE AS {c}_hi" for c in T.VALUES])
        + " FROM panel CROSS JOIN bounds WHERE date BETWEEN train_start AND train_end GROUP BY series_id) "
        + "SELECT p.series_id, count(*) AS n, "
        + rows(
            *[
                R(f"sum(({c} - {c}_lo) / (CASE WHEN {c}_hi = {c}_lo THEN 1 ELSE {c}_hi - {c}_lo END))", 5)
                + f" AS {c}_scaled"
                for c in T.VALUES
            ]
        )
        + " FROM panel p JOIN fit f ON f.series_id = p.series_id GROUP BY p.series_id",
        "panel",
        "bounds",
    ),
)
def feature_scaler(ws: Workspace) -> DataFrame:
    """Every value column scaled to its training range; sums per series."""
    fit = scaling.minmax_fit(splits.split_filter(ws.panel, ws.bounds, "train"), T.VALUES)
    wide = scaling.minmax_transform(ws.panel, fit, T.VALUES)
    sums = [F.sum(f"{c}_scaled").alias(f"{c}_scaled") for c in T.VALUES]
    return rounded(wide.groupBy("series_id").agg(F.count("*").alias("n"), *sums), 5)


@query(
    "train_rows_tail",
    twin(
        """SELECT series_id, date, total FROM (SELECT *, row_number() OVER (PARTITION BY series_id
        ORDER BY date DESC) AS r FROM baselines WHERE split = 'train') WHERE r <= 365""",
        "baselines",
    ),
)
def train_rows_tail(ws: Workspace) -> DataFrame:
    train = splits.split_filter(ws.baselines, ws.bounds, "train").select(*KEYS, "total")
    return splits.train_rows_tail(train, 365)


@query(
    "chronological_split",
    twin(
        """SELECT split, first_date, last_date, date_diff('day', first_date, last_date) + 1 AS n_days,
        n_series * (date_diff('day', first_date, last_date) + 1) AS n_rows,
        round(100.0::DOUBLE * (date_diff('day', first_date, last_date) + 1) / n, 6) AS share_pct FROM (
        SELECT 'train' AS split, train_start AS first_date, train_end AS last_date FROM bounds
        UNION ALL SELECT 'val', val_start, val_end FROM bounds
        UNION ALL SELECT 'test', test_start, test_end FROM bounds)
        CROSS JOIN span CROSS JOIN (SELECT count(DISTINCT series_id) AS n_series FROM lines)""",
        "bounds",
        "span",
        "lines",
    ),
)
def chronological_split(ws: Workspace) -> DataFrame:
    """Boundaries from the checked panel, and the days and rows they give each split."""
    bounds = splits.chronological_split(ws.panel)
    return rounded(splits.split_summary(splits.label_split(ws.panel, bounds)))


@query(
    "label_split",
    twin(
        """SELECT series_id, date, CASE WHEN date BETWEEN train_start AND train_end THEN 'train'
        WHEN date BETWEEN val_start AND val_end THEN 'val'
        WHEN date BETWEEN test_start AND test_end THEN 'test' ELSE 'unassigned' END AS split
        FROM sparse CROSS JOIN bounds""",
        "sparse",
        "bounds",
    ),
)
def label_split(ws: Workspace) -> DataFrame:
    return splits.label_split(ws.sparse.select(*KEYS), ws.bounds)


@query("apply_warmup", twin("SELECT series_id, date, total FROM base WHERE rn > 28", "base"))
def apply_warmup(ws: Workspace) -> DataFrame:
    return splits.apply_warmup(ws.panel.select(*KEYS, "total"), ws.bounds)


@query(
    "fold_boundaries",
    twin(
        """SELECT series_id, fold, 200 + (fold - 1) * ((n - 200) // 5) AS train_end,
        CASE WHEN fold = 5 THEN n ELSE 200 + fold * ((n - 200) // 5) END AS block_end
        FROM (SELECT series_id, count(*) AS n FROM baselines WHERE split = 'train' GROUP BY series_id)
        CROSS JOIN (SELECT unnest(range(1, 6)) AS fold)""",
        "baselines",
    ),
)
def fold_boundaries(ws: Workspace) -> DataFrame:
    return splits.fold_table(splits.split_filter(ws.baselines, ws.bounds, "train"))


@query(
    "assign_folds",
    twin(
        """SELECT series_id, date, pos, fold, has_oof, CASE WHEN pos < 200
        THEN 'within the first 200 training rows' END AS exclusion_reason FROM folded""",
        "folded",
    ),
)
def assign_folds(ws: Workspace) -> DataFrame:
    train = splits.split_filter(ws.baselines, ws.bounds, "train")
    return splits.assign_folds(train).select(*KEYS, "pos", "fold", "has_oof", "exclusion_reason")


@query(
    "fold_clean_guard",
    twin(
        """SELECT a.series_id, a.fold, max(b.date) AS train_end, a.block_start, max(b.date) < a.block_start AS is_clean
        FROM (SELECT series_id, fold, min(date) AS block_start FROM folded WHERE fold > 0 GROUP BY 1, 2) a
        JOIN folded b ON b.series_id = a.series_id AND b.fold < a.fold
        GROUP BY a.series_id, a.fold, a.block_start""",
        "folded",
    ),
)
def fold_clean_guard(ws: Workspace) -> DataFrame:
    return splits.fold_clean_guard(ws.mean_oof)


@query(
    "internal_holdout",
    twin(
        """SELECT series_id, is_holdout, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (
        SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date)
        > count(*) OVER (PARTITION BY series_id)
        - greatest(1, round_even(count(*) OVER (PARTITION BY series_id) * 0.15::DOUBLE, 0)::BIGINT) AS is_holdout
        FROM baselines WHERE split = 'train') GROUP BY series_id, is_holdout""",
        "baselines",
    ),
)
def internal_holdout(ws: Workspace) -> DataFrame:
    marked = splits.internal_holdout(splits.split_filter(ws.baselines, ws.bounds, "train"))
    return marked.groupBy("series_id", "is_holdout").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "training_split",
    twin(
        """SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
        FROM baselines WHERE split = 'train' GROUP BY series_id""",
        "baselines",
    ),
)
def training_split(ws: Workspace) -> DataFrame:
    return splits.key_span(splits.training_split(ws.panel.select(*KEYS, "total"), ws.bounds))


@query(
    "eval_frame",
    twin(
        """SELECT series_id, split, count(*) AS n_rows, sum(total)::BIGINT AS total
        FROM baselines GROUP BY series_id, split""",
        "baselines",
    ),
)
def eval_frame(ws: Workspace) -> DataFrame:
    frame = splits.eval_frame(ws.panel.select(*KEYS, "total"), ws.bounds)
    return frame.groupBy("series_id", "split").agg(
        F.count("*").alias("n_rows"), F.sum("total").alias("total")
    )


@query(
    "rank_average",
    twin(
        f"""SELECT series_id, date, {R('''rank() OVER (PARTITION BY series_id ORDER BY total)
        + (count(*) OVER (PARTITION BY series_id, total) - 1) / 2.0::DOUBLE''')} AS rank_total FROM sparse""",
        "sparse",
    ),
)
def rank_average(ws: Workspace) -> DataFrame:
    ranked = scores.rank_average(ws.sparse.select(*KEYS, "total"), ["series_id"], "total", "rank_total")
    return rounded(ranked.drop("total"))
