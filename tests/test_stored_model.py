"""A fitted pipeline that is saved and loaded predicts what the fitted one does."""

import datetime as dt
from types import SimpleNamespace

from daybook.models.trees import fit_trees, predict_trees
from daybook.operators import scores
from daybook.plans.queries_sources import save_load_model
from daybook.plans.workspace import SMALL_TREES, rounded


def test_a_loaded_model_scores_like_the_fitted_one(spark):
    start = dt.date(2024, 1, 1)
    rows = [
        (1, start + dt.timedelta(days=i), "train" if i < 60 else "val", float(i % 7), float(i % 7), 0.0, 1.0, float(i % 3), float(i % 7 > 3))
        for i in range(80)
    ]
    schema = "series_id long, date date, split string, y_true double, label double, y_low double, y_width double, feat_a double, feat_b double"
    ws = SimpleNamespace(spark=spark, pooled=spark.createDataFrame(rows, schema), feature_names=["feat_a", "feat_b"])
    fitted = fit_trees(ws.pooled.where("split = 'train'"), ws.feature_names, SMALL_TREES)
    expected = rounded(scores.all_metrics(predict_trees(fitted, ws.pooled), ["split"]))
    found = save_load_model(ws)
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() == 2
