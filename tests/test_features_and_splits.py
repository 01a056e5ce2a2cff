import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from daybook.constants import HOLIDAY_TYPES, TARGET_LAGS
from daybook.functions.calendar import calendar_names, fourier_names
from daybook.functions.text import slug, slug_column
from daybook.operators import features, scaling, splits
from daybook.operators.panel import Span

D0 = dt.date(2024, 1, 1)
DAY = dt.timedelta(days=1)


def by_date(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def test_rolling_mean_leaves_out_the_current_row(make_panel):
    panel = make_panel({1: [2**i for i in range(10)]})
    values = by_date(panel.select("date", features.trailing("total", 3, "mean").alias("m")), "m")
    assert values[:3] == [None, None, None]
    assert values[3] == pytest.approx(7 / 3)
    stds = by_date(panel.select("date", features.trailing("total", 3, "std").alias("s")), "s")
    assert stds[3] == pytest.approx(math.sqrt(7 / 3))


def test_lags_stay_within_their_series(make_panel):
    panel = make_panel({1: range(30), 2: range(100, 130)})
    rows = features.lag_features(panel, ["total"]).where("series_id = 2")
    for lag in TARGET_LAGS:
        values = by_date(rows, f"feat_total_lag_{lag}")
        assert values == [None] * lag + list(range(100, 130 - lag))


def test_rolling_by_date_ignores_gaps(spark):
    days = [0, 1, 5, 6]
    rows = [(1, D0 + d * DAY, 10 * d) for d in days]
    df = spark.createDataFrame(rows, "series_id bigint, date date, total bigint")
    out = features.rolling_by_date(df, 4).orderBy("date").collect()
    assert [r["n_4d"] for r in out] == [0, 1, 1, 1]
    assert [r["total_mean_4d"] for r in out] == [None, 0.0, 10.0, 50.0]


def test_full_width_of_the_feature_table(spark):
    parts = ["metro", "emt", "carretera", "cercanias"]
    weather = [f"w{i}" for i in range(21)]
    span = Span(D0, D0 + 39 * DAY)
    panel = spark.range(40).select(
        F.lit(1).cast("long").alias("series_id"),
        F.expr("date_add(date'2024-01-01', int(id))").alias("date"),
        (F.col("id") * F.col("id") + 100).alias("total"),
        *[(F.col("id") + i).alias(c) for i, c in enumerate(parts)],
    )
    exog = panel.select("series_id", "date", *[(F.col("total") + i).cast("double").alias(w) for i, w in enumerate(weather)])
    calendar = panel.select(
        F.lit("c").alias("calendar_id"), "date", F.lit("lunes").alias("weekday_es"), F.lit("laborable").alias("day_type"),
        F.lit("none").alias("holiday_type"), F.lit("none").alias("holiday_name"),
    )
    table = features.build_features(panel, calendar, exog, parts, weather, span)
    names = features.feature_names(table)
    assert len(names) == 161 and table.count() == 40
    groups = spark.createDataFrame([(n,) for n in names], "f string").groupBy(features.feature_group("f", parts, weather).alias("g")).count()
    assert {r["g"]: r["count"] for r in groups.collect()} == {
        "calendar": 11, "fourier_weekly": 2, "fourier_annual": 4, "lag_total": 7, "lag_operator": 28, "rolling": 4, "weather": 105,
    }
    report = features.feature_report(table, names).collect()
    assert {r["first_complete_date"] for r in report} == {D0 + 28 * DAY}
    exog_lag = table.where(F.col("date") == D0 + 10 * DAY).first()
    assert exog_lag["feat_w3_lag_7"] == 3 * 3 + 100 + 3
    assert exog_lag["feat_w0_roll_mean_7"] == pytest.approx(sum(i * i + 100 for i in range(3, 10)) / 7)


def test_fourier_depends_on_the_date_alone(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 8),), (dt.date(2022, 12, 31),)], "date date")
    rows = features.fourier_features(df).orderBy("date").collect()
    assert rows[0]["feat_fourier_weekly_k1_sin"] == pytest.approx(math.sin(-2 * math.pi / 7))
    assert rows[1]["feat_fourier_annual_k2_cos"] == pytest.approx(math.cos(2 * math.pi * 2 * 7 / 365.25))
    assert len(calendar_names()) == 11 and len(fourier_names()) == 6


def test_slug_twins_agree(spark):
    labels = [*HOLIDAY_TYPES, "  Jueves  Santo ", "Año--Nuevo", "ÉPICA (1)", "1-URGENT"]
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    for row in df.select("v", slug_column("v").alias("s")).collect():
        assert row["s"] == slug(row["v"])
    assert slug("Festivo de la Comunidad de Madrid") == "festivo_de_la_comunidad_de_madrid"


def test_window_never_holds_its_target(make_panel):
    for width in (5, 7, 14):
        rows = features.sequence_windows(make_panel({1: range(50), 2: range(50)}), width).collect()
        assert len(rows) == 2 * (50 - width)
        assert all(r["history"] == list(range(r["total"] - width, r["total"])) and r["pos"] == r["total"] for r in rows)


def test_split_counts_and_dates():
    bounds = splits.split_span(Span(dt.date(2023, 1, 1), dt.date(2026, 8, 2)))
    assert [bounds.days(s) for s in splits.SPLITS] == [917, 196, 197]
    assert bounds.val[0] - bounds.train[1] == DAY and bounds.test[0] - bounds.val[1] == DAY
    with pytest.raises(ValueError):
        splits.split_span(Span(D0, D0 + 99 * DAY), 0.9, 0.1)
    with pytest.raises(ValueError):
        splits.split_span(Span(D0, D0 + DAY))


def test_split_refuses_gaps(make_panel):
    whole = make_panel({1: range(100), 2: range(100)})
    assert splits.chronological_split(whole).days("train") == 70
    with pytest.raises(ValueError, match="missing days"):
        splits.chronological_split(whole.where(F.col("date") != D0 + 50 * DAY))
    with pytest.raises(ValueError, match="duplicate"):
        splits.chronological_split(whole.unionByName(whole.where(F.col("date") == D0)))


def test_warmup_refuses_to_enter_validation(make_panel):
    panel = make_panel({1: range(40)})
    bounds = splits.split_span(Span(D0, D0 + 39 * DAY))
    assert splits.apply_warmup(panel, bounds, 20).count() == 20
    assert splits.apply_warmup(panel, bounds, 0).count() == 40
    with pytest.raises(Exception, match="warm-up reaches"):
        splits.apply_warmup(panel, bounds, 35).count()


def test_folds_tile_the_training_rows(make_panel):
    assert splits.fold_boundaries(889) == [(200, 337), (337, 474), (474, 611), (611, 748), (748, 889)]
    with pytest.raises(ValueError):
        splits.fold_boundaries(200)
    folded = splits.assign_folds(make_panel({1: range(889), 2: range(889)}))
    sizes = {(r["series_id"], r["fold"]): r["count"] for r in folded.groupBy("series_id", "fold").count().collect()}
    for s in (1, 2):
        assert [sizes[s, f] for f in (-1, 1, 2, 3, 4, 5)] == [200, 137, 137, 137, 137, 141]
    checks = splits.fold_clean_guard(folded).collect()
    assert len(checks) == 10 and all(r["is_clean"] for r in checks)


def test_holdout_is_the_end_of_training(make_panel):
    marked = splits.internal_holdout(make_panel({1: range(100)})).where("is_holdout")
    assert sorted(r["total"] for r in marked.collect()) == list(range(85, 100))


def test_tail_keeps_the_newest(make_panel):
    assert sorted(r["total"] for r in splits.train_rows_tail(make_panel({1: range(9)}), 3).collect()) == [6, 7, 8]


def test_scalers_use_training_rows_and_do_not_clip(make_panel):
    train = make_panel({1: [10, 20], 2: [5, 5]})
    fit = scaling.minmax_fit(train, ["total"])
    late = make_panel({1: [30, 0], 2: [7, 5]})
    scaled = scaling.minmax_transform(late, fit, ["total"])
    got = {(r["series_id"], r["total"]): r["total_scaled"] for r in scaled.collect()}
    assert got == {(1, 30): 2.0, (1, 0): -1.0, (2, 7): 2.0, (2, 5): 0.0}
    back = scaling.minmax_inverse(scaled, fit, "total", "total_scaled", "back")
    assert all(r["back"] == r["total"] for r in back.collect())
    z = scaling.standard_transform(train, scaling.standard_fit(train, ["total"]), ["total"])
    assert sorted(r["total_scaled"] for r in z.where("series_id = 1").collect()) == [-1.0, 1.0]


def test_model_matrix_refuses_nulls(make_panel):
    panel = make_panel({1: range(5)})
    lagged = features.lag_features(panel, ["total"]).join(panel, ["series_id", "date"])
    with pytest.raises(Exception):
        features.model_matrix(lagged, ["feat_total_lag_1"]).collect()
