import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.constants import ARX_REGRESSORS, TREE_GRID
from daybook.models import arx, linear, trees
from daybook.operators import features, scores, splits
from daybook.operators.panel import Span
from daybook.session import materialise

START = dt.date(2024, 1, 1)
PARAMS = {"maxDepth": 3, "maxIter": 8, "stepSize": 0.3, "minInstancesPerNode": 2}


def weekly(seed, n=420, scale=1):
    rng = np.random.default_rng(seed)
    shape = np.array([100, 110, 105, 108, 120, 60, 40]) * scale
    return [int(v) for v in shape[np.arange(n) % 7] + rng.normal(0, 5 * scale, n)]


@pytest.fixture(scope="module")
def panel(make_panel):
    return make_panel({1: weekly(1), 2: weekly(2, scale=10)})


@pytest.fixture(scope="module")
def span():
    return Span(START, START + dt.timedelta(days=419))


@pytest.fixture(scope="module")
def bounds(span):
    return splits.split_span(span)


@pytest.fixture(scope="module")
def days(spark, span):
    dates = spark.range(span.n_days).select(F.expr("date_add(date'2024-01-01', int(id))").alias("date"))
    flags = [(F.weekday("date") >= 5).cast("int").alias(ARX_REGRESSORS[0])]
    flags += [(F.dayofmonth("date") == 3 + i).cast("int").alias(c) for i, c in enumerate(ARX_REGRESSORS[1:])]
    return dates.select("date", *flags, F.lit("c").alias("calendar_id"))


def test_arx_matches_least_squares(spark, panel, days, span, bounds):
    rows = splits.eval_frame(arx.design_rows(panel, days, span), bounds)
    training = rows.where("split = 'train'")
    candidates = arx.candidate_orders(training)
    assert candidates.count() == 2 * 4 * 8
    pick = candidates.where("series_id = 1 and d = 0 and sd = 1 and p = 2 and sp = 1").first()
    local = training.where("series_id = 1").orderBy("date").select("z01", "x01").collect()
    used = [0, 1, 2, 3, *range(5, 10)]
    x = np.array([[r["x01"][i] for i in used] for r in local])
    z = np.array([r["z01"] for r in local])
    beta, *_ = np.linalg.lstsq(x, z, rcond=None)
    rss = float(((z - x @ beta) ** 2).sum())
    assert pick["rss"] == pytest.approx(rss, rel=1e-6) and pick["n"] == len(z)
    assert pick["aic"] == pytest.approx(len(z) * np.log(rss / len(z)) + 2 * len(used), rel=1e-6)


def test_arx_beats_the_weekly_naive_and_reads_no_later_row(spark, panel, days, span, bounds):
    orders, predicted = arx.seasonal_arx(panel, days, span, bounds)
    assert orders.count() == 2
    naive = scores.baseline_columns(panel).select("series_id", "date", "seasonal_naive")
    table = scores.wide_metrics(predicted.join(naive, ["series_id", "date"]).where("split = 'test'"), ["seasonal_arx", "seasonal_naive"], ["series_id"])
    mae = {(r["series_id"], r["model"]): r["MAE"] for r in table.collect()}
    assert all(mae[s, "seasonal_arx"] < mae[s, "seasonal_naive"] for s in (1, 2))
    cut = bounds.test[0] + dt.timedelta(days=10)
    bent = panel.withColumn("total", F.when(F.col("date") > cut, F.lit(10**6)).otherwise(F.col("total")))
    again = arx.seasonal_arx(bent, days, span, bounds)[1]
    before = [df.where(F.col("date") <= cut).orderBy("series_id", "date").collect() for df in (predicted, again)]
    assert before[0] == before[1]


def test_differencing_is_undone_exactly(spark, panel, days, span, bounds):
    rows = splits.eval_frame(arx.design_rows(panel, days, span), bounds)
    y = rows.orderBy("series_id", "date").where("series_id = 1").collect()
    values = weekly(1)
    for r in y[:50]:
        t = (r["date"] - START).days
        assert r["z11"] == values[t] - values[t - 1] - values[t - 7] + values[t - 8]


def test_stage1_matches_least_squares_on_scaled_windows(spark, panel, bounds):
    rows = splits.eval_frame(panel, bounds)
    model, predicted = linear.stage1_window(rows, 7)
    mae = scores.all_metrics(predicted, ["split"]).where("split = 'test'").first()["MAE"]
    assert mae < 60
    x, y = [], []
    for s, scale in ((1, 1), (2, 10)):
        values = np.array(weekly(s, scale=scale), float)[28:294]
        train = values[7:]
        low, width = train.min(), np.ptp(train)
        scaled = (values - low) / width
        x += [scaled[t - 7 : t] for t in range(7, len(scaled))]
        y += list(scaled[7:])
    design = np.column_stack([np.array(x), np.ones(len(y))])
    beta = np.linalg.lstsq(design, np.array(y), rcond=None)[0]
    assert np.allclose(model.coefficients.toArray(), beta[:-1], atol=1e-6)


def test_oof_covers_each_row_from_earlier_rows(spark, panel, bounds):
    training = splits.training_split(panel, bounds)
    oof = materialise(linear.oof_predictions(training, 7, 3, 100))
    assert oof.count() == training.count() == oof.select("series_id", "date").distinct().count()
    assert oof.where("has_oof").where("y_pred_oof is null").count() == 0
    assert oof.where("not has_oof").where("y_pred_oof is not null").count() == 0
    last = oof.where("fold = 3").agg(F.min("date")).first()[0]
    bent = training.withColumn("total", F.when(F.col("date") >= last, F.lit(10**6)).otherwise(F.col("total")))
    again = linear.oof_predictions(bent, 7, 3, 100)
    early = [df.where("fold between 1 and 2").orderBy("series_id", "date").select("y_pred_oof").collect() for df in (oof, again)]
    assert np.allclose([r[0] for r in early[0]], [r[0] for r in early[1]])


@pytest.fixture(scope="module")
def pooled(spark, panel, bounds):
    table = panel.select("*", *features.lag_columns(["total"]), *features.rolling_columns())
    names = features.feature_names(table)
    rows = trees.pooled_rows(splits.eval_frame(table, bounds), names, ["total"])
    return materialise(rows), names


def test_trees_beat_the_mean_and_repeat(spark, pooled):
    rows, names = pooled
    train = rows.where("split = 'train'")
    runs = [trees.predict_trees(trees.fit_trees(train, names, PARAMS), rows) for _ in range(2)]
    tables = [scores.all_metrics(r, ["series_id", "split"]).orderBy("series_id", "split").collect() for r in runs]
    assert tables[0] == tables[1]
    assert all(r["R2"] > 0.5 for r in tables[0] if r["split"] == "test")


def test_grid_search_reads_the_training_tail(spark, pooled):
    rows, names = pooled
    options = {"maxDepth": [1, 3], "maxIter": [5], "stepSize": [0.3], "minInstancesPerNode": [2]}
    best, board = trees.chrono_grid_search(rows.where("split = 'train'"), names, trees.grid(options))
    assert board.count() == 2 and best["maxDepth"] == 3
    assert len(trees.grid(TREE_GRID)) == 54


def test_staged_errors_equal_fits_of_their_own(spark, pooled, bounds):
    rows, names = pooled
    training = rows.where("split = 'train'")
    options = {"maxDepth": [2, 3], "maxIter": [2, 4, 7], "stepSize": [0.3], "minInstancesPerNode": [2]}
    cut = training.agg(F.min("date"), F.max("date")).first()
    start = splits.holdout_start(*cut)
    board = trees.chrono_grid_search(training, names, trees.grid(options), holdout_from=start)[1].collect()
    assert len(board) == 6
    ranked = trees.chrono_grid_search(training, names, trees.grid(options))[1].collect()
    assert np.allclose([tuple(r) for r in board], [tuple(r) for r in ranked])
    for row in (board[0], board[4]):
        params = {k: row[k] if k == "stepSize" else int(row[k]) for k in options}
        alone = trees.fit_trees(training.where(F.col("date") < start), names, params)
        held = alone.transform(training.where(F.col("date") >= start))
        y, p = F.col("label"), F.col("prediction")
        mae, rmse = held.agg(F.avg(F.abs(y - p)), F.sqrt(F.avg((y - p) ** 2))).first()
        assert (row.holdout_mae, row.holdout_rmse) == pytest.approx((mae, rmse), rel=1e-9)


def test_weights_and_hybrid_identity(spark, pooled, bounds, panel):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "a int, b int")
    assert [r[0] for r in df.select(trees.irregular_weight(["a", "b"])).collect()] == [1.0, 3.0, 3.0]
    stage1 = panel.select("series_id", "date", F.lit("test").alias("split"), F.col("total").cast("double").alias("y_true"), F.lit(50.0).alias("y_pred"))
    fix = panel.select("series_id", "date", (F.col("total") - 50.0).alias("e_pred"))
    out = trees.hybrid_combine(stage1, fix)
    assert out.where("y_pred <> y_true").count() == 0 and out.count() == panel.count()
    with pytest.raises(Exception, match="no correction for"):
        trees.hybrid_combine(stage1, fix.where(F.col("date") > START)).collect()


def test_residual_set_refuses_missing_features(spark, panel):
    oof = panel.select("series_id", "date", F.col("total").cast("double").alias("y_true"), F.lit(1.0).alias("y_pred_oof"), F.lit(2).alias("fold"), F.lit(True).alias("has_oof"))
    lagged = features.lag_features(panel, ["total"])
    with pytest.raises(Exception, match="without features"):
        linear.residual_set(oof, lagged, ["feat_total_lag_28"]).collect()
    late = oof.where(F.col("date") >= START + dt.timedelta(days=28))
    assert linear.residual_set(late, lagged, ["feat_total_lag_28"]).count() == late.count()
