"""Queries over sources, guards, joins and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.constants import DAY_TYPES
from daybook.functions.calendar import calendar_names
from daybook.models.arx import order_table as stored_orders
from daybook.operators import features, guards, scores, splits, subgroups
from daybook.operators import panel as P
from daybook.operators.panel import KEYS
from daybook.plans import tables as T
from daybook.plans.registry import query
from daybook.plans.sql import R, rows, twin
from daybook.plans.workspace import SMALL_TREES, Workspace, rounded
from daybook.session import scratch_path
from daybook.sources import delimited, stages

PANEL_SUMS = "SELECT series_id, count(*) AS n_days, " + rows(
    *[f"sum({c})::BIGINT AS {c}" for c in T.VALUES],
    *[f"sum({c} * (date - DATE '1970-01-01'))::BIGINT AS {c}_by_day" for c in T.VALUES],
)


def panel_sums(df: DataFrame) -> DataFrame:
    """Totals of each series, plain and weighted by the day, to compare whole panels."""
    day = F.unix_date("date").cast("long")
    return df.groupBy("series_id").agg(
        F.count("*").alias("n_days"),
        *[F.sum(c).alias(c) for c in T.VALUES],
        *[F.sum(F.col(c) * day).alias(f"{c}_by_day") for c in T.VALUES],
    )


@query(
    "read_delimited",
    twin(
        """SELECT date, weekday_es AS day_of_week_es, day_type,
        nullif(holiday_type, 'none') AS holiday_type, nullif(holiday_name, 'none') AS holiday_name
        FROM calendar""",
        "calendar",
    ),
)
def read_delimited(ws: Workspace) -> DataFrame:
    """Calendar of the order dates, written with a byte-order mark and semicolons, and read back."""
    path = scratch_path(ws.spark, "calendar-csv")
    raw = T.raw_calendar(ws.spark, ws.span).select(
        F.date_format("date", "dd/MM/yyyy").alias("\ufeffDia"),
        F.col("weekday_es").alias("Dia_semana"),
        F.col("day_type").alias("laborable / festivo / domingo festivo"),
        F.col("holiday_type").alias("Tipo de Festivo"),
        F.col("holiday_name").alias("Festividad"),
    )
    raw.write.options(sep=";", header=True).csv(path)
    return delimited.read_delimited(ws.spark, path)


@query(
    "read_with_preamble",
    twin(f"SELECT date, {rows(*[f'{R(c)} AS {c}' for c in T.EXOG])} FROM exog", "exog"),
)
def read_with_preamble(ws: Workspace) -> DataFrame:
    """Daily averages of the line items in a file with metadata above its header."""
    path = scratch_path(ws.spark, "extract-csv")
    head = ["latitude,longitude", "40.4,-3.7", "", "time,discount mean (%),tax mean (%),price mean (eur),quantity max"]
    preamble = ws.spark.createDataFrame([(line,) for line in head], "value string")
    lines = ws.exog.select(F.concat_ws(",", "date", *T.EXOG).alias("value"))
    preamble.coalesce(1).unionByName(lines).write.text(path)
    return rounded(delimited.read_with_preamble(ws.spark, path))


def demand_sheet(ws: Workspace) -> DataFrame:
    """The city series under the labels of the demand sheet, with rounding noise in the counts."""
    noise = F.lit(1e-8)
    parts = {
        "Unnamed: 1": F.date_format("date", "yyyy-MM-dd"),
        "Metro de Madrid": F.col("part_a") + noise,
        "EMT": F.col("part_n") + noise,
        "Conc. por carretera": F.col("part_r") - noise,
        "Renfe Cercanías": F.lit(0.0),
        "Total": F.col("total") + noise,
    }
    empty = F.lit(None).cast("string")
    return ws.city.select(
        *[parts.get(label, empty).alias(label) for label in delimited.DEMAND_RAW]
    )


@query(
    "canonicalise_demand",
    twin(
        """SELECT date, part_a AS metro, part_n AS emt, part_r AS carretera,
        0::BIGINT AS cercanias, total FROM city""",
        "city",
    ),
)
def canonicalise_demand(ws: Workspace) -> DataFrame:
    return delimited.canonicalise_demand(demand_sheet(ws))


@query(
    "round_integral",
    """SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS date,
    round(l_quantity)::BIGINT AS l_quantity FROM lineitem""",
)
def round_integral(ws: Workspace) -> DataFrame:
    """Quantities stored as doubles with noise, as whole numbers."""
    lines = T.table(ws.spark, ws.sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_quantity") + 1e-8).alias("l_quantity"),
    )
    return delimited.round_integral(lines, ["l_quantity"])


@query("write_stage", twin(f"{PANEL_SUMS} FROM panel GROUP BY series_id", "panel"))
def write_stage(ws: Workspace) -> DataFrame:
    """The labelled panel written partitioned by split and read back."""
    root = scratch_path(ws.spark, "stages")
    stages.write_stage(splits.label_split(ws.panel, ws.bounds), root, "panel", ["split"])
    return panel_sums(stages.read_stage(ws.spark, root, "panel"))


@query(
    "read_stage",
    twin(
        f"""SELECT model, {rows("count(*) AS n", f"{R('avg(abs(y_true - y_pred))')} AS MAE")}
        FROM tidy WHERE split = 'test' GROUP BY model""",
        "tidy",
    ),
)
def read_stage(ws: Workspace) -> DataFrame:
    """Stored predictions, of which the reader opens only the test partition."""
    root = scratch_path(ws.spark, "stages")
    stages.write_stage(ws.tidy, root, "baselines", ["split"])
    test = stages.read_stage(ws.spark, root, "baselines").where("split = 'test'")
    gap = F.abs(F.col("y_true") - F.col("y_pred"))
    return rounded(test.groupBy("model").agg(F.count("*").alias("n"), F.avg(gap).alias("MAE")))


@query("order_table")
def order_table(ws: Workspace) -> DataFrame:
    """Selected order of every series, stored and read with its explicit schema."""
    root = scratch_path(ws.spark, "stages")
    stages.write_order_table(stored_orders(ws.arx[0]), root)
    return rounded(stages.read_order_table(ws.spark, root), 4)


@query("save_load_model")
def save_load_model(ws: Workspace) -> DataFrame:
    """A fitted pipeline saved, loaded and applied to every evaluation row."""
    from daybook.models.trees import fit_trees, predict_trees

    path = scratch_path(ws.spark, "model")
    stages.save_model(fit_trees(ws.pooled.where("split = 'train'"), ws.feature_names, SMALL_TREES), path)
    predicted = predict_trees(stages.load_model(path), ws.pooled)
    return rounded(scores.all_metrics(predicted, ["split"]))


@query(
    "schema_summary",
    twin(
        "SELECT column_name, n_nulls, data_type, n_rows, first_date, last_date, missing_days, duplicates FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_nulls, '{t}' AS data_type FROM sparse"
            for c, t in [("series_id", "bigint"), ("date", "date"), *[(v, "bigint") for v in T.VALUES]]
        )
        + """) CROSS JOIN (SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
        0::BIGINT AS duplicates FROM sparse)
        CROSS JOIN (SELECT sum(gap)::BIGINT AS missing_days FROM (SELECT series_id,
        date_diff('day', min(date), max(date)) + 1 - count(*) AS gap FROM sparse GROUP BY series_id))""",
        "sparse",
    ),
)
def schema_summary(ws: Workspace) -> DataFrame:
    return guards.schema_summary(ws.sparse)


@query(
    "domain_guard",
    "SELECT l_returnflag AS value, count(*) AS n_rows FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1",
)
def domain_guard(ws: Workspace) -> DataFrame:
    """Return flags outside a declared set of levels."""
    return guards.domain_guard(T.table(ws.spark, ws.sf_dir, "lineitem"), "l_returnflag", ["A", "N"])


_AUDITED = list(features.declared_groups(T.PARTS, T.EXOG))
_SAME_DAY = [*T.VALUES, *T.EXOG]
_LEAKS = ", ".join(
    f"{{'feature': '{f}', 'source': '{s}', 'n_rows': n, 'is_leak': coalesce(alike_{i}_{j} AND varies_{i}, false)}}"
    for i, f in enumerate(_AUDITED)
    for j, s in enumerate(_SAME_DAY)
)


@query(
    "leak_audit",
    twin(
        f"""SELECT unnest([{_LEAKS}, {{'feature': 'part_a+part_n+part_r', 'source': 'total', 'n_rows': n,
          'is_leak': whole}}], recursive := true)
        FROM (SELECT count(*) AS n, bool_and(part_a + part_n + part_r = total) AS whole,
          {rows(*[f"max({f}) > min({f}) AS varies_{i}" for i, f in enumerate(_AUDITED)])},
          {rows(*[f"bool_and({f} = {s}) AS alike_{i}_{j}" for i, f in enumerate(_AUDITED) for j, s in enumerate(_SAME_DAY)])}
          FROM (SELECT f.*, {rows(*[f"x.{c}" for c in T.EXOG])} FROM features f JOIN exog x ON x.date = f.date)
          WHERE {" AND ".join(f"{f} IS NOT NULL" for f in _AUDITED)})""",
        "features",
        "exog",
    ),
)
def leak_audit(ws: Workspace) -> DataFrame:
    """Every feature against every same-day column: no feature leaks, the parts do."""
    same_day = P.attach_calendar(ws.features, ws.exog.select("date", *T.EXOG), ws.span)
    return guards.leak_audit(same_day, _AUDITED, _SAME_DAY, T.PARTS)


@query(
    "model_matrix",
    twin(
        f"""SELECT series_id, split, count(*) AS n, 11 AS width,
        sum({" + ".join(calendar_names())})::DOUBLE AS ones
        FROM baselines b JOIN days d ON d.date = b.date GROUP BY series_id, split""",
        "baselines",
        "days",
    ),
)
def model_matrix(ws: Workspace) -> DataFrame:
    """Calendar block as a vector per row; size and sum of the vector per series."""
    from pyspark.ml.functions import vector_to_array

    names = calendar_names()
    matrix = features.model_matrix(ws.labelled.select(*KEYS, "split", "total", *names), names)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return matrix.groupBy("series_id", "split").agg(
        F.count("*").alias("n"), F.max(F.size(values)).alias("width"), F.sum(total).alias("ones")
    )


@query(
    "split_filter",
    twin(
        "SELECT series_id, date, total FROM panel CROSS JOIN bounds WHERE date BETWEEN val_start AND val_end",
        "panel",
        "bounds",
    ),
)
def split_filter(ws: Workspace) -> DataFrame:
    return splits.split_filter(ws.panel.select(*KEYS, "total"), ws.bounds, "val")


@query(
    "unify_sources",
    twin(
        f"""SELECT p.series_id, p.date, part_a, part_n, part_r, total,
        {rows(*[f"{R(c)} AS {c}" for c in T.EXOG])}, weekday_es, day_type, holiday_type, holiday_name
        FROM panel p JOIN exog x ON x.date = p.date JOIN calendar c ON c.date = p.date""",
        "panel",
        "exog",
        "calendar",
    ),
)
def unify_sources(ws: Workspace) -> DataFrame:
    return rounded(ws.unified)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(ws: Workspace) -> DataFrame:
    return guards.duplicate_keys(T.table(ws.spark, ws.sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def order_dates(ws: Workspace) -> DataFrame:
    orders = T.table(ws.spark, ws.sf_dir, "orders")
    return orders.select(F.col("o_orderdate").cast("date").alias("date"))


def ship_dates(ws: Workspace) -> DataFrame:
    return T.line_events(ws.spark, ws.sf_dir).select("date")


@query(
    "lost_rows",
    twin(
        """, ordered AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders),
        shipped AS (SELECT DISTINCT date FROM lines),
        both_days AS (SELECT date FROM ordered INTERSECT SELECT date FROM shipped)
        SELECT 'orders' AS source, date FROM ordered EXCEPT ALL SELECT 'orders', date FROM both_days
        UNION ALL (SELECT 'lineitem' AS source, date FROM shipped EXCEPT ALL SELECT 'lineitem', date FROM both_days)""",
        "lines",
    ),
)
def lost_rows(ws: Workspace) -> DataFrame:
    """Days with orders but no shipments, and the other way round."""
    sources = {
        "orders": order_dates(ws).distinct(),
        "lineitem": ship_dates(ws).distinct(),
    }
    merged = sources["orders"].join(sources["lineitem"], "date")
    return guards.lost_rows(sources, merged)


@query(
    "calendar_gaps",
    twin(
        """SELECT r.series_id, d.date FROM
        (SELECT series_id, min(date) AS lo, max(date) AS hi FROM sparse GROUP BY series_id) r
        JOIN all_days d ON d.date BETWEEN r.lo AND r.hi
        ANTI JOIN sparse s ON s.series_id = r.series_id AND s.date = d.date""",
        "sparse",
        "all_days",
    ),
)
def calendar_gaps(ws: Workspace) -> DataFrame:
    return guards.calendar_gaps(ws.sparse)


@query("densify_panel", twin(f"SELECT series_id, date, {rows(*T.VALUES)} FROM panel", "panel"))
def densify_panel(ws: Workspace) -> DataFrame:
    return ws.panel


@query(
    "fill_sentinel",
    twin("SELECT date, holiday_type, holiday_name FROM calendar", "calendar"),
)
def fill_sentinel(ws: Workspace) -> DataFrame:
    raw = T.raw_calendar(ws.spark, ws.span).select("date", "holiday_type", "holiday_name")
    return P.fill_sentinel(raw, ["holiday_type", "holiday_name"])


_HISTORY = ["total", "feat_total_lag_1", "feat_total_lag_28", "feat_total_roll_mean_7", "feat_total_roll_std_28"]


@query(
    "null_census",
    twin(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_nulls FROM history" for c in _HISTORY
        ),
        "history",
    ),
)
def null_census(ws: Workspace) -> DataFrame:
    lagged = ws.panel.select(
        *KEYS, "total", *features.lag_columns(["total"], [1, 28]), *features.rolling_columns()
    )
    return guards.null_census(lagged.select(*_HISTORY))


@query(
    "integrity_report",
    twin(
        """SELECT series_id, check_name, expected, observed,
        CASE WHEN expected = observed THEN 'OK' ELSE 'FALLO' END AS verdict FROM (
        SELECT series_id, unnest(['filas', 'huecos de calendario', 'fechas duplicadas', 'valores nulos',
        'suma de operadores == total']) AS check_name,
        unnest([n_span, 0, 0, 0, 0]) AS expected,
        unnest([n_rows, n_span - n_dates, n_rows - n_dates, 0, residual]) AS observed FROM (
        SELECT series_id, count(*) AS n_rows, count(DISTINCT date) AS n_dates,
        date_diff('day', min(date), max(date)) + 1 AS n_span,
        max(abs(part_a + part_n + part_r - total)) AS residual FROM sparse GROUP BY series_id))""",
        "sparse",
    ),
)
def integrity_report(ws: Workspace) -> DataFrame:
    return guards.integrity_report(ws.sparse, T.PARTS)


@query(
    "part_sum_residual",
    twin(
        "SELECT series_id, max(abs(part_a + part_n + part_r - total))::BIGINT AS max_residual FROM panel GROUP BY series_id",
        "panel",
    ),
)
def part_sum_residual(ws: Workspace) -> DataFrame:
    return guards.part_sum_residual(ws.panel, T.PARTS)


@query(
    "order_panel_integrity",
    """WITH daily AS (SELECT c_nationkey::BIGINT AS series_id, o_orderdate::DATE AS date, count(*) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT series_id, check_name, expected, observed,
    CASE WHEN expected = observed THEN 'OK' ELSE 'FALLO' END AS verdict FROM (
    SELECT series_id, unnest(['filas', 'huecos de calendario', 'fechas duplicadas', 'valores nulos',
    'suma de operadores == total']) AS check_name, unnest([n_span, 0, 0, 0, 0]) AS expected,
    unnest([n_rows, n_span - n_rows, 0, 0, 0]) AS observed FROM (
    SELECT series_id, count(*) AS n_rows, date_diff('day', min(date), max(date)) + 1 AS n_span
    FROM daily GROUP BY series_id))""",
)
def order_panel_integrity(ws: Workspace) -> DataFrame:
    """The integrity report of the second panel: orders per nation by priority."""
    orders, parts = T.order_panel(ws.spark, ws.sf_dir)
    return guards.integrity_report(orders, parts)


@query(
    "attach_features",
    twin(
        """SELECT t.series_id, t.date, split, total, seasonal_naive, day_type, feat_is_bridge_day
        FROM baselines t LEFT JOIN days d ON d.date = t.date""",
        "baselines",
        "days",
    ),
)
def attach_features(ws: Workspace) -> DataFrame:
    """Predictions with feature columns of the same series and day."""
    rows_ = ws.baselines.select(*KEYS, "split", "total", "seasonal_naive")
    table = ws.with_days(ws.panel.select(*KEYS), ["day_type", "feat_is_bridge_day"])
    return P.attach_features(rows_, table, ["day_type", "feat_is_bridge_day"])


@query(
    "unmatched_feature_guard",
    twin(
        """SELECT series_id, date FROM baselines b ANTI JOIN sparse s
        ON s.series_id = b.series_id AND s.date = b.date""",
        "baselines",
        "sparse",
    ),
)
def unmatched_feature_guard(ws: Workspace) -> DataFrame:
    """Prediction days on which the sparse panel has no row."""
    return guards.unmatched_features(ws.baselines, ws.sparse)


@query(
    "holiday_proximity",
    twin(
        "SELECT p.series_id, p.date, total FROM panel p SEMI JOIN easter e ON e.date = p.date",
        "panel",
        "easter",
    ),
)
def holiday_proximity(ws: Workspace) -> DataFrame:
    anchors = ws.calendar.where(F.col("holiday_name").contains("Jueves Santo")).select("date")
    return P.near_dates(ws.panel.select(*KEYS, "total"), anchors, 4)


_FLAGS = [c for c in calendar_names() if c != "feat_is_weekend"]


@query(
    "coverage_check",
    twin(
        """, oof_days AS (SELECT f.fold, d.* FROM folded f JOIN days d ON d.date = f.date WHERE has_oof),
        counted AS ("""
        + " UNION ALL ".join(
            f"SELECT '{c.removeprefix('feat_')}' AS category, "
            f"coalesce(sum(CASE WHEN fold = 1 THEN {c} END), 0)::BIGINT AS n_excluded, "
            f"coalesce(sum(CASE WHEN fold <> 1 THEN {c} END), 0)::BIGINT AS n_retained FROM oof_days"
            for c in _FLAGS
        )
        + """) SELECT *, n_excluded > 0 AND n_retained = 0 AS zero_coverage_elsewhere,
        NOT bool_or(n_excluded > 0 AND n_retained = 0) OVER () AS exclusion_is_safe FROM counted""",
        "folded",
        "days",
    ),
)
def coverage_check(ws: Workspace) -> DataFrame:
    oof = ws.with_days(ws.mean_oof.select(*KEYS, "fold", "has_oof"), _FLAGS)
    return scores.coverage_check(oof, _FLAGS, 1)


@query("easter_days", twin("SELECT date FROM easter", "easter"))
def easter_days(ws: Workspace) -> DataFrame:
    return subgroups.easter_days(ws.calendar)


@query(
    "day_types",
    twin("SELECT day_type, count(*) AS n_days FROM calendar GROUP BY day_type", "calendar"),
)
def day_types(ws: Workspace) -> DataFrame:
    """Days per type, after the guard on undeclared types."""
    guards.require_empty(guards.domain_guard(ws.calendar, "day_type", DAY_TYPES), "undeclared day types")
    return ws.calendar.groupBy("day_type").agg(F.count("*").alias("n_days"))
