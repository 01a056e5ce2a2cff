"""Fits from sums of products against plain least squares on explicit windows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.models import gram, linear, studies
from daybook.operators import splits, verdicts
from daybook.operators.panel import Span

START = dt.date(2024, 1, 1)
WIDTH, DAYS = 5, 260


def values(seed, scale):
    rng = np.random.default_rng(seed)
    shape = np.array([50, 70, 60, 90, 20, 10, 30])
    return ((shape[np.arange(DAYS) % 7] + rng.normal(0, 6, DAYS)) * scale).round().astype(int).tolist()


SERIES = {1: values(1, 1), 2: values(2, 25), 7: [4] * DAYS}


@pytest.fixture(scope="module")
def panel(make_panel):
    return make_panel(SERIES).withColumn("x", (F.dayofweek("date") == 3).cast("int")).withColumn("w", F.col("x") * 2)


@pytest.fixture(scope="module")
def bounds():
    return splits.split_span(Span(START, START + dt.timedelta(days=DAYS - 1)))


def windows(total, first, last, extra=()):
    """Scaled inputs and targets of the rows first <= t < last, with the scale."""
    total = np.array(total, float)
    low, span = total[first:last].min(), np.ptp(total[first:last]) or 1.0
    scaled = (total - low) / span
    x = [[1.0, *scaled[t - WIDTH : t], *[e[t] for e in extra]] for t in range(first, last)]
    return np.array(x), scaled[first:last], low, span


def least_squares(parts, weights=None):
    x, y = np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    w = np.sqrt(np.ones(len(y)) if weights is None else np.concatenate(weights))
    return np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]


def test_out_of_fold_predictions_equal_refits(spark, panel, bounds):
    training = splits.training_split(panel, bounds)
    first, n = splits.WARMUP_DAYS, bounds.days("train")
    rows = {(r.series_id, r.date): r for r in linear.oof_predictions(training, WIDTH, 3, 60).collect()}
    ends = splits.fold_boundaries(n - first, 3, 60)
    for fold, (train_end, block_end) in enumerate(ends, 1):
        local = {s: v[first:n] for s, v in SERIES.items()}
        beta = least_squares([windows(v, WIDTH, train_end) for v in local.values()])
        for s, v in local.items():
            _, _, low, span = windows(v, WIDTH, train_end)
            for t in range(train_end, block_end):
                scaled = (np.array(v[t - WIDTH : t], float) - low) / span
                row = rows[s, START + dt.timedelta(days=first + t)]
                assert row.fold == fold
                assert row.y_pred_oof == pytest.approx((beta[0] + scaled @ beta[1:]) * span + low, rel=1e-6, abs=1e-6)


def test_no_window_is_stored_and_rows_move_once(spark, panel, bounds):
    plan = linear.oof_predictions(splits.training_split(panel, bounds), WIDTH, 3, 60)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and text.count("RepartitionByExpression") == 1


def draws_of(s, seed):
    days = np.array([START + dt.timedelta(days=i) for i in range(DAYS)], "datetime64[D]")
    return gram.draws({"series_id": np.full(DAYS, s), "date": days}, seed)


def test_replicates_draw_rows_with_mean_one():
    drawn = np.concatenate([draws_of(s, 42) for s in range(200)])
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03
    assert np.corrcoef(drawn, np.concatenate([draws_of(s, 1) for s in range(200)]))[0, 1] < 0.02


def test_learning_curve_equals_refits_on_the_tail(spark, panel, bounds):
    rows = splits.label_split(panel, bounds)
    n, fractions = bounds.days("train"), [0.25, 0.6, 1.0]
    curve = studies.learning_curve(rows, n, fractions, [42, 1], [3], WIDTH).collect()
    assert {(r.fraction, r.seed) for r in curve} == {(f, s) for f in fractions for s in (42, 1)} | {(1.0, 3)}
    for r in curve:
        kept = n if r.fraction >= 1 else round(r.fraction * n)
        first = n - kept + WIDTH
        parts = {s: windows(v, first, n) for s, v in SERIES.items()}
        weights = [draws_of(s, r.seed)[first:n] for s in SERIES]
        beta = least_squares(list(parts.values()), weights)
        errors = []
        for s, v in SERIES.items():
            _, _, low, span = parts[s]
            for t in range(n, n + bounds.days("val")):
                scaled = (np.array(v[t - WIDTH : t], float) - low) / span
                errors.append(abs(v[t] - ((beta[0] + scaled @ beta[1:]) * span + low)))
        assert r.val_MAE == pytest.approx(np.mean(errors), rel=1e-6)
        assert (r.train_rows, r.train_sequences, r.n) == (kept, kept - WIDTH, len(errors))
        assert r.rows_drawn == sum(w.sum() for w in weights)


def test_parity_scopes_share_one_pass_and_runs_differ(spark, panel, bounds):
    rows = splits.label_split(panel, bounds)
    scopes = {"one": ["x"], "both": ["x", "w"]}
    runs = studies.parity_control(rows, scopes, 10.0, 5.0, [42, 1, 2, 3, 4], WIDTH)
    found = {(r.scope, r.seed): r for r in runs.collect()}
    assert len(found) == 10
    n = bounds.days("train")
    extra = [np.array([(START + dt.timedelta(days=t)).isoweekday() == 2 for t in range(DAYS)], float)]
    beta = least_squares([windows(v, WIDTH, n, extra) for v in SERIES.values()], [draws_of(s, 2)[WIDTH:n] for s in SERIES])
    errors = []
    for v in SERIES.values():
        _, _, low, span = windows(v, WIDTH, n)
        for t in range(n, n + bounds.days("val")):
            x = np.r_[1.0, (np.array(v[t - WIDTH : t], float) - low) / span, extra[0][t]]
            errors.append(abs(v[t] - (x @ beta * span + low)))
    assert found["one", 2].val_MAE == pytest.approx(np.mean(errors), rel=1e-6)
    # a column that is a multiple of another adds nothing, and the sums must not blow it up
    assert found["both", 2].val_MAE == pytest.approx(np.mean(errors), rel=1e-5)
    mae = sorted(r.val_MAE for (scope, _), r in found.items() if scope == "one")
    assert mae[0] < mae[2] < mae[4]
    middle = (mae[0] + mae[4]) / 2
    reference = 10.0 - (10.0 - middle) / 0.6
    judged = verdicts.parity_verdicts(runs.withColumn("degenerate", F.lit(False)), 10.0, reference)
    assert {r.verdict for r in judged.collect()} == {"mixto/ambiguo"}


def test_series_shorter_than_a_window_and_empty_panels(spark, make_panel, bounds):
    rows = splits.label_split(make_panel({1: SERIES[1], 3: [5, 6, 7]}), bounds)
    _, predicted = linear.stage1_window(rows, WIDTH)
    assert predicted.where("series_id = 3").count() == 0 and predicted.count() == DAYS - WIDTH
