"""Fits on the dealt panel: dense rows are neither moved again nor stored, and results stay the same."""

import datetime as dt

import numpy as np
import pytest

from daybook.models import linear, studies
from daybook.operators import splits
from daybook.operators.panel import KEYS
from daybook.plans import workspace
from daybook.session import materialise


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    rng, start = np.random.default_rng(3), dt.date(2023, 1, 1)
    days = {s: [0, *sorted(rng.choice(range(1, 419), 150, False).tolist()), 419] for s in range(12)}
    rows = [(s, start + dt.timedelta(days=d), "ANR"[d % 3], float(rng.integers(1, 50))) for s in days for d in days[s]]
    folder = str(tmp_path_factory.mktemp("lines"))
    lines = spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_returnflag string, l_quantity double")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return workspace.Workspace(spark, folder)


def moves(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_out_of_fold_rows_stay_where_they_are(ws):
    training = splits.training_split(ws.panel, ws.bounds)
    dealt = linear.oof_predictions(training, 7, 3, 100, dealt=True)
    assert moves(dealt) == moves(ws.panel.select(*KEYS, "total")) > 0
    plain = linear.oof_predictions(materialise(training), 7, 3, 100)
    found, expected = [[tuple(r) for r in f.orderBy(*KEYS).collect()] for f in (dealt, plain)]
    assert len(found) == len(expected) > 1000
    for a, b in zip(found, expected):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] or a[-1] == pytest.approx(b[-1], rel=1e-9))


def test_curves_and_windows_equal_those_of_moved_rows(ws):
    rows = splits.eval_frame(ws.panel.select(*KEYS, "total"), ws.bounds)
    stored, n = materialise(rows), ws.bounds.days("train") - workspace.WARMUP_DAYS
    assert moves(linear.stage1_window(rows, 7, dealt=True)[1]) == moves(rows)

    def both(run):
        return [sorted(map(tuple, run(f, dealt).collect())) for f, dealt in ((rows, True), (stored, False))]

    for run in (
        lambda f, dealt: studies.window_comparison(f, [7, 14], dealt=dealt),
        lambda f, dealt: studies.learning_curve(f, n, [0.5, 1.0], [42], [3], 7, dealt=dealt),
    ):
        for a, b in zip(*both(run), strict=True):
            assert a == pytest.approx(b, rel=1e-9)
