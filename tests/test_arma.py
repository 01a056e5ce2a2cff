"""Moving-average orders against simulated series and plain least squares."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.constants import ARX_REGRESSORS
from daybook.models import arma
from daybook.operators import splits
from daybook.operators.panel import Span

N = 1500


@pytest.fixture(scope="module")
def shocked(spark, make_panel):
    noise = np.random.default_rng(4).normal(0, 1000, N + 7)
    first = 50_000 + noise[7:] + 0.6 * noise[6:-1]
    weekly = 50_000 + noise[7:] + 0.5 * noise[:-7]
    panel = make_panel({1: [int(v) for v in first], 2: [int(v) for v in weekly]})
    start = panel.agg(F.min("date")).first()[0]
    span = Span(start, start + dt.timedelta(days=N - 1))
    dates = spark.range(N).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    flags = [(F.pmod(F.dayofyear("date"), F.lit(5 + i)) == 0).cast("int").alias(c) for i, c in enumerate(ARX_REGRESSORS)]
    days = dates.select("date", *flags, F.lit("c").alias("calendar_id"))
    bounds = splits.split_span(span)
    units = arma.labelled_units(panel, days, span, bounds)
    return arma.innovations(units, F.col("split") == "train").where("d = 0 AND sd = 0").persist()


@pytest.fixture(scope="module")
def candidates(shocked):
    return arma.candidate_orders(shocked, F.col("split") == "train").persist()


def test_moving_averages_are_recovered(candidates):
    assert candidates.count() == 2 * 80
    first = candidates.where("series_id = 1 AND p = 0 AND q = 1 AND sp = 0 AND sq = 0").first()
    assert first["beta"][arma._FIRST_MA] == pytest.approx(0.6, abs=0.08)
    weekly = candidates.where("series_id = 2 AND p = 0 AND q = 0 AND sp = 0 AND sq = 1").first()
    assert weekly["beta"][arma._FIRST_MA + 2] == pytest.approx(0.5, abs=0.08)
    chosen = {r["series_id"]: r for r in arma.select_order(candidates).collect()}
    assert chosen[1]["q"] >= 1 and chosen[2]["sq"] >= 1


def test_an_order_equals_least_squares_on_its_rows(shocked, candidates):
    rows = shocked.where(f"series_id = 1 AND split = 'train' AND place > {arma.HEAD}").orderBy("date").collect()
    used = arma.order_columns(1, 1, 0, 1)
    x = np.array([[*r["x"], *r["shocks"]] for r in rows], float)[:, used]
    z = np.array([r["z"] for r in rows])
    beta = np.linalg.lstsq(x, z, rcond=None)[0]
    pick = candidates.where("series_id = 1 AND p = 1 AND q = 1 AND sp = 0 AND sq = 1").first()
    rss = float(((z - x @ beta) ** 2).sum())
    assert pick["n"] == len(z) and pick["rss"] == pytest.approx(rss, rel=1e-5)
    assert np.array(pick["beta"])[used] == pytest.approx(beta, rel=1e-3, abs=1e-3)


def test_forecasts_beat_the_noise_and_read_no_later_row(shocked, candidates):
    out = arma.forecast(shocked.where(f"place > {arma.HEAD}"), arma.select_order(candidates.where("series_id = 1")))
    test = out.where("split = 'test'").agg(F.stddev(F.col("total") - F.col("seasonal_arma")).alias("e"), F.stddev("total").alias("s")).first()
    assert test["e"] < 0.92 * test["s"]
    assert out.where("seasonal_arma IS NULL").count() == 0
