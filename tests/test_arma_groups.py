"""The seasonal moving-average model in one group per series, against its steps as frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.constants import ARX_REGRESSORS
from daybook.models import arma
from daybook.operators import splits
from daybook.operators.panel import Span

N = 400


@pytest.fixture(scope="module")
def setting(spark, make_panel):
    rng = np.random.default_rng(8)
    walk = 50_000 + np.cumsum(rng.normal(0, 300, N))
    series = {1: [int(v) for v in walk], 2: [int(v) for v in 9_000 + rng.normal(0, 500, N)], 3: [5] * N}
    panel = make_panel(series)
    nameless = panel.where("series_id = 1").withColumn("series_id", F.lit(None).cast("bigint"))
    short = panel.where("series_id = 1").limit(20).withColumn("series_id", F.lit(4).cast("bigint"))
    panel = panel.unionByName(nameless).unionByName(short)
    start = dt.date(2024, 1, 1)
    span = Span(start, start + dt.timedelta(days=N - 1))
    dates = spark.range(N).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    flags = [(F.pmod(F.dayofyear("date"), F.lit(5 + i)) == 0).cast("int").alias(c) for i, c in enumerate(ARX_REGRESSORS)]
    days = dates.select("date", *flags, F.lit("c").alias("calendar_id"))
    return panel, days, span, splits.split_span(span)


def test_groups_give_the_orders_and_forecasts_of_the_steps(spark, setting):
    training = F.col("split") == "train"
    shocked = arma.innovations(arma.labelled_units(*setting), training).persist()
    steps = {r["series_id"]: r for r in arma.select_order(arma.candidate_orders(shocked, training)).collect()}
    orders, forecasts = arma.seasonal_arma(*setting)
    found = {r["series_id"]: r for r in orders.collect()}
    assert set(found) == set(steps) == {1, 2, 3}
    for key in (1, 2):
        assert [found[key][c] for c in ("d", "sd", "p", "q", "sp", "sq", "n")] == [steps[key][c] for c in ("d", "sd", "p", "q", "sp", "sq", "n")]
        assert found[key]["rss"] == pytest.approx(steps[key]["rss"], rel=1e-9)
        assert found[key]["beta"] == pytest.approx(steps[key]["beta"], rel=1e-6, abs=1e-6)
    rows = arma.forecast(shocked.where(f"place > {arma.HEAD}"), arma.select_order(arma.candidate_orders(shocked, training)))
    expected = {(r["series_id"], r["date"]): (r["split"], r["seasonal_arma"]) for r in rows.collect()}
    made = {(r["series_id"], r["date"]): (r["split"], r["seasonal_arma"]) for r in forecasts.collect()}
    assert set(made) == set(expected) and len(made) == 3 * (N - arma.HEAD)
    for key, (split, value) in expected.items():
        assert made[key][0] == split and made[key][1] == pytest.approx(value, rel=1e-6)


def test_rows_are_shuffled_once_and_no_stage_is_stored(spark, setting, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("a stage is written")

    monkeypatch.setattr(type(spark.range(1).write), "parquet", refuse)
    for frame in arma.seasonal_arma(*setting):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "inline" not in plan
