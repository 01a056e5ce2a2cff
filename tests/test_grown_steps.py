"""Steps that grow with the panel: wide rows stay where they are, a series is one group."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.constants import ARX_REGRESSORS
from daybook.models import arx
from daybook.operators import splits
from daybook.operators.panel import KEYS
from daybook.plans import workspace

START = dt.date(2023, 1, 1)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    days = {s: [0, *sorted(rng.choice(range(1, 499), 150, False).tolist()), 499] for s in range(6)}
    rows = [
        (s, START + dt.timedelta(days=d), "ANR"[d % 3], float(rng.integers(1, 50)), 0.05, 0.02, 10.0 + d % 5)
        for s in days
        for d in days[s]
    ]
    schema = "l_suppkey long, l_shipdate date, l_returnflag string, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    return workspace.Workspace(spark, folder)


def test_wide_rows_of_the_residual_set_are_not_moved_or_stored_before(ws, monkeypatch):
    kept, moves = workspace.materialise, {}

    def seen(frame, name="stage"):
        moves[name] = plan(frame).count("Exchange hashpartitioning")
        return kept(frame, name)

    monkeypatch.setattr(workspace, "materialise", seen)
    found = ws.residuals
    # of the two sides of the join at most the narrow one moves
    assert moves["residuals"] <= plan(ws.dealt_pooled).count("Exchange hashpartitioning") + 1
    assert "pooled" not in vars(ws)
    held = ws.oof.where("has_oof").join(ws.pooled.select(*KEYS, "label", "y_width", "feat_total_lag_1"), KEYS)
    held = held.withColumn("r", (F.col("y_true") - F.col("y_pred_oof")) / F.col("y_width"))
    both = found.join(held.select(*KEYS, "r", F.col("feat_total_lag_1").alias("f")), KEYS)
    assert both.count() == found.count() > 500
    assert both.where("abs(label - r) > 1e-9 or abs(f - feat_total_lag_1) > 1e-9").count() == 0


def test_one_group_per_series_equals_the_steps_of_the_autoregression(ws):
    dates = ws.spark.range(ws.span.n_days).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("date"))
    flags = [(F.dayofyear("date") % (3 + i) == 0).cast("int").alias(c) for i, c in enumerate(ARX_REGRESSORS)]
    days = dates.select("date", *flags, F.lit("c").alias("calendar_id"))
    panel = ws.panel.select(*KEYS, "total")
    orders, predicted = arx.seasonal_arx(panel, days, ws.span, ws.bounds)
    rows = splits.eval_frame(arx.design_rows(panel, days, ws.span), ws.bounds)
    chosen = arx.select_order(arx.candidate_orders(rows.where("split = 'train'")))
    for a, b in zip(*[f.orderBy("series_id").collect() for f in (orders, chosen)], strict=True):
        assert a[:6] == b[:6] and a["beta"] == pytest.approx(b["beta"], rel=1e-6, abs=1e-7)
        assert (a["rss"], a["aic"]) == pytest.approx((b["rss"], b["aic"]), rel=1e-9)
    steps = arx.forecast(rows, chosen).select("series_id", "date", "split", "total", "seasonal_arx")
    for a, b in zip(*[f.orderBy(*KEYS).collect() for f in (predicted, steps)], strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-6)
    moves = plan(ws.panel.select(*KEYS, "total")).count("Exchange hashpartitioning")
    assert plan(predicted).count("Exchange hashpartitioning") == moves


def test_a_warm_up_that_reaches_validation_raises(ws):
    late = ws.panel.select(*KEYS, "total").where(F.col("date") >= ws.bounds.val[0])
    days = ws.calendar.select("date", "calendar_id", *[F.lit(0).alias(c) for c in ARX_REGRESSORS])
    with pytest.raises(Exception, match="warm-up reaches the validation split"):
        arx.seasonal_arx(late, days, ws.span, ws.bounds)[1].count()
