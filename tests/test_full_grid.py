"""The tree queries tune over the whole grid, and a fit in one task is the fit whose rows are spread."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest

from daybook.constants import TREE_GRID
from daybook.models import studies, trees
from daybook.models.boosting import split_points
from daybook.plans import queries_learning
from daybook.plans.workspace import Workspace

START = dt.date(2024, 1, 1)


class Asked(Exception):
    """Carries the candidates a query searches."""


def asked(call, monkeypatch, place, name, at):
    def search(*args, **options):
        raise Asked(args[at])

    monkeypatch.setattr(place, name, search)
    with pytest.raises(Asked) as error:
        call()
    return error.value.args[0]


@pytest.fixture(scope="module")
def rows(spark):
    days = [(1 + i % 3, START + dt.timedelta(days=i // 3), "train", float((i * 37) % 101 + 20 * (i % 7)), float(i % 7), float((i * i) % 53), float(i % 2)) for i in range(360)]
    return spark.createDataFrame(days, "series_id long, date date, split string, label double, feat_a double, feat_b double, feat_c double").repartition(3).cache()


def test_the_queries_search_the_whole_grid(spark, rows, monkeypatch):
    ws = SimpleNamespace(spark=spark, pooled=rows, residuals=rows, feature_names=["feat_a"], holdout_from=START)
    whole = trees.grid(TREE_GRID)
    assert asked(lambda: Workspace.tuned.func(ws), monkeypatch, trees, "chrono_grid_search", 2) == whole
    assert asked(lambda: Workspace.residual_params.func(ws), monkeypatch, trees, "chrono_grid_search", 2) == whole
    monkeypatch.setattr(queries_learning, "groups_of", lambda _: {"feat_a": "calendar"})
    assert asked(lambda: queries_learning.block_ablation(ws), monkeypatch, studies, "block_ablation", 2) == whole


def test_a_fit_in_one_task_is_the_fit_whose_rows_are_spread(rows):
    names = ["feat_a", "feat_b", "feat_c"]
    candidates = trees.grid({"maxDepth": [2, 4], "maxIter": [3, 6], "stepSize": [0.2], "minInstancesPerNode": [1, 20]})
    start = START + dt.timedelta(days=100)
    (best, board), (same, spread) = (trees.chrono_grid_search(rows, names, candidates, holdout_from=start, task_bins=b) for b in (trees.TASK_BINS, 0))
    assert best == same and board.count() == 8
    assert np.allclose(*([tuple(r) for r in b.orderBy("candidate").collect()] for b in (board, spread)), rtol=1e-9)


def test_limits_lie_between_values_or_near_equal_counts():
    assert split_points(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert len(split_points(np.ones(5))) == 0
    assert split_points(np.arange(8.0), 4).tolist() == [1.5, 3.5, 5.5]
