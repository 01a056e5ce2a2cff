import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.operators import features, guards
from daybook.operators import panel as P
from daybook.plans.tables import easter

START = D0 = dt.date(2024, 1, 1)

DAY = dt.timedelta(days=1)


def test_daily_panel_survives_a_hot_series(spark):
    rows = [(1, D0 + (i % 3) * DAY, "A", 1.0) for i in range(3000)] + [
        (s, D0, "B", 2.0) for s in range(2, 50)
    ]
    events = spark.createDataFrame(rows, "series_id bigint, date date, k string, q double")
    out = P.daily_panel(events, "k", {"a": "A", "b": "B"}, "q")
    hot = {r["date"]: (r["a"], r["b"], r["total"]) for r in out.where("series_id = 1").collect()}
    assert hot == {D0 + i * DAY: (1000, 0, 1000) for i in range(3)}
    plan = out._jdf.queryExecution().toString()
    assert "partial_sum" in plan


def test_densify_fills_both_ends_and_the_middle(spark):
    rows = [(1, D0 + 2 * DAY, 5), (1, D0 + 4 * DAY, 7), (2, D0, 1)]
    sparse = spark.createDataFrame(rows, "series_id bigint, date date, total bigint")
    out = P.densify(sparse, P.Span(D0, D0 + 5 * DAY), ["total"])
    got = {(r["series_id"], (r["date"] - D0).days): r["total"] for r in out.collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 5, 0, 7, 0]
    assert [got[2, i] for i in range(6)] == [1, 0, 0, 0, 0, 0]


def test_densify_adds_no_join_and_feature_windows_share_one_sort(spark, make_panel):
    panel = make_panel({1: [1, 2, 3]})
    dense = P.densify(panel, P.Span(D0, D0 + 9 * DAY), ["total"])
    wide = dense.select(*P.KEYS, *features.lag_columns(["total"]), *features.rolling_columns())
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning(series_id") == 1
    assert plan.count("+- Sort") + plan.count(":- Sort") == 2


def sources(spark, drop=None, duplicate=None):
    days = [D0 + i * DAY for i in range(5)]
    frames = {}
    for name in ("demand", "exog", "calendar"):
        mine = [d for d in days if drop not in ((name, d), ("all", d))]
        mine += [duplicate[1]] if duplicate and duplicate[0] == name else []
        frames[name] = spark.createDataFrame([(1, d, 1) for d in mine], f"series_id bigint, date date, v_{name} bigint")
    return frames


def test_inner_join_names_the_lost_day(spark):
    frames = sources(spark, drop=("exog", D0 + 2 * DAY))
    merged = P.unify_sources(
        frames["demand"], frames["exog"].drop("series_id"), frames["calendar"].drop("series_id"), P.Span(D0, D0 + 4 * DAY)
    )
    lost = guards.lost_rows(frames, merged).collect()
    assert {(r["source"], r["date"]) for r in lost} == {
        ("demand", D0 + 2 * DAY),
        ("calendar", D0 + 2 * DAY),
    }


def test_gap_common_to_all_sources_and_duplicates(spark):
    frames = sources(spark, drop=("all", D0 + 2 * DAY), duplicate=("exog", D0))
    assert [r["date"] for r in guards.calendar_gaps(frames["demand"]).collect()] == [D0 + 2 * DAY]
    assert guards.duplicate_keys(frames["exog"]).collect()[0]["n_rows"] == 2
    with pytest.raises(ValueError, match="duplicate"):
        guards.require_empty(guards.duplicate_keys(frames["exog"]), "duplicate dates")
    with pytest.raises(ValueError, match="missing days"):
        guards.require_whole_days(frames["demand"], P.Span(D0, D0 + 4 * DAY))


def test_integrity_report_flags_each_defect(spark):
    rows = [(1, D0, 1, 2, 3), (1, D0, 1, 2, 3), (1, D0 + 3 * DAY, 1, None, 3), (2, D0, 1, 1, 5)]
    df = spark.createDataFrame(rows, "series_id bigint, date date, a bigint, b bigint, total bigint")
    out = {(r["series_id"], r["check_name"]): (r["observed"], r["verdict"]) for r in guards.integrity_report(df, ["a", "b"]).collect()}
    assert out[1, "huecos de calendario"] == (2, "FALLO")
    assert out[1, "fechas duplicadas"] == (1, "FALLO")
    assert out[1, "valores nulos"] == (1, "FALLO")
    assert out[2, "suma de operadores == total"] == (3, "FALLO")
    assert out[2, "filas"] == (1, "OK")


def test_leak_audit_finds_copies_by_value(spark, make_panel):
    panel = make_panel({1: [3, 1, 4, 1, 5, 9]})
    df = panel.select("*", F.col("total").alias("part"), F.col("total").alias("feat_x"), *features.lag_columns(["total"], [1]))
    leaks = guards.leak_audit(df, ["feat_x", "feat_total_lag_1"], ["total"], ["part"]).where("is_leak")
    assert {r["feature"] for r in leaks.collect()} == {"feat_x", "part"}
    with pytest.raises(ValueError, match="same-day"):
        guards.require_no_leak(df, ["feat_x"], ["total"])
    guards.require_no_leak(df, ["feat_total_lag_1"], ["total"])


def test_domain_guard_and_missing_column(spark):
    df = spark.createDataFrame([("laborable",), ("puente",)], "day_type string")
    assert [r["value"] for r in guards.domain_guard(df, "day_type", ["laborable"]).collect()] == ["puente"]
    with pytest.raises(ValueError, match="missing required"):
        guards.require_columns(df, ["date"], "here")


def test_near_dates_is_a_semi_join(spark, make_panel):
    panel = make_panel({1: range(20)})
    anchors = spark.createDataFrame([(D0 + 6 * DAY,), (D0 + 8 * DAY,)], "date date")
    assert P.near_dates(panel, anchors, 2).count() == 7


def test_bridge_day_needs_a_working_day_beside_a_holiday(spark):
    types = ["laborable", "festivo", "laborable", "laborable", "sabado", "domingo festivo", "laborable"]
    rows = [("c", D0 + i * DAY, t) for i, t in enumerate(types)]
    cal = spark.createDataFrame(rows, "calendar_id string, date date, day_type string")
    flags = [r["feat_is_bridge_day"] for r in P.bridge_days(cal).orderBy("date").collect()]
    assert flags == [1, 0, 1, 0, 0, 0, 1]


def test_small_side_broadcasts_only_below_the_bound(spark):
    from daybook.session import BROADCAST_ROW_LIMIT, small_side

    df = spark.range(3)
    hinted = small_side(df, 3)._jdf.queryExecution().logical().toString()
    plain = small_side(df, BROADCAST_ROW_LIMIT + 1)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_easter_dates():
    assert [easter(y) for y in (1995, 2000, 2024, 2025)] == [
        dt.date(1995, 4, 16),
        dt.date(2000, 4, 23),
        dt.date(2024, 3, 31),
        dt.date(2025, 4, 20),
    ]


def unified_inputs(spark, make_panel):
    panel = make_panel({1: [3, 1, 2, 4], 2: [5, 6, 7, 8]})
    days = panel.select("date").distinct()
    exog = days.withColumn("wind", F.dayofmonth("date") * 1.5)
    calendar = days.select("date", F.lit("laborable").alias("day_type"), F.lit(None).cast("string").alias("holiday_type"))
    return panel, exog, calendar, P.Span(START, START + dt.timedelta(days=3))


def test_checked_unification_stores_what_the_join_gives(spark, make_panel):
    panel, exog, calendar, span = unified_inputs(spark, make_panel)
    stored = P.unify_checked(panel, exog, calendar, span)
    plain = P.unify_sources(panel, exog, calendar, span)
    assert stored.columns == plain.columns
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.holiday_type for r in stored.collect()} == {"none"}


@pytest.mark.parametrize(
    "fault, message",
    [
        ("exog lacks", "rows without exogenous data': 2"),
        ("calendar lacks", "rows without calendar data': 2"),
        ("calendar repeats", "repeated days': 2"),
        ("panel repeats", "repeated days': 1"),
        ("panel lacks", "gaps': 1"),
        ("panel ends", "gaps': 1"),
        ("panel begins", "gaps': 1"),
        ("null", "nulls in wind': 2"),
        ("outside", "exogenous days outside the panel': 1"),
    ],
)
def test_checked_unification_names_what_is_wrong(spark, make_panel, fault, message):
    panel, exog, calendar, span = unified_inputs(spark, make_panel)
    second, last = F.lit(START + dt.timedelta(days=1)), F.lit(span.end)
    one = F.col("series_id") == 1
    if fault == "exog lacks":
        exog = exog.where(F.col("date") != second)
    elif fault == "calendar lacks":
        calendar = calendar.where(F.col("date") != second)
    elif fault == "calendar repeats":
        calendar = calendar.union(calendar.where(F.col("date") == second))
    elif fault == "panel repeats":
        panel = panel.union(panel.where(one & (F.col("date") == second)))
    elif fault == "panel lacks":
        panel = panel.where(~(one & (F.col("date") == second)))
    elif fault == "panel ends":
        panel = panel.where(~(one & (F.col("date") == last)))
    elif fault == "panel begins":
        panel = panel.where(~(one & (F.col("date") == F.lit(span.start))))
    elif fault == "null":
        exog = exog.withColumn("wind", F.when(F.col("date") != second, F.col("wind")))
    else:
        exog = exog.union(spark.createDataFrame([(START - dt.timedelta(days=1), 1.0)], "date date, wind double"))
    with pytest.raises(ValueError, match=message):
        P.unify_checked(panel, exog, calendar, span)


def test_leak_audit_sees_each_column_and_needs_complete_rows(spark, make_panel):
    df = make_panel({1: [4, 2, 9, 3], 2: [1, 1, 2, 8]}).withColumns(
        {"wind": F.col("total") * 0.5, "feat_wind": F.col("total") / 2, "feat_two": F.lit(2), "two": F.lit(2), "part": F.col("total")}
    )
    lagged = df.withColumn("feat_total_lag_1", F.lag("total").over(P.by_series()))
    audit = guards.leak_audit(lagged, ["feat_wind", "feat_two", "feat_total_lag_1"], ["total", "wind", "two"], ["part"])
    assert {(r.feature, r.source) for r in audit.where("is_leak").collect()} == {("feat_wind", "wind"), ("part", "total")}
    assert {r.n_rows for r in audit.collect()} == {6}
    with pytest.raises(ValueError, match="same-day values"):
        guards.require_no_leak(lagged.withColumn("feat_total_lag_1", F.lit(None).cast("long")), ["feat_total_lag_1"], ["total"])
