"""Repeated predictions are found from one row a series and day; models are counted only on suspicion."""

import datetime as dt

import pytest

from daybook.operators import reshape

SCHEMA = "series_id long, date date, split string, model string, y_true double, y_pred double"


def tidy(spark, models, day=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(1, day, "test", m, 1.0, 1.0) for m in models], SCHEMA)


def test_clean_predictions_are_not_grouped_by_model(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all keys were counted")

    monkeypatch.setattr(reshape, "duplicate_keys", refuse)
    assert reshape.check_predictions(tidy(spark, ["a", "b", "c", None])).count() == 4


def test_every_repeated_prediction_is_found(spark):
    many = [f"m{i}" for i in range(100)]
    assert reshape.check_predictions(tidy(spark, many)).count() == 100
    for repeated in ([*many, "m7"], ["a", "b", "a"], [None, "a", None]):
        with pytest.raises(ValueError, match="repeated predictions"):
            reshape.check_predictions(tidy(spark, repeated).unionByName(tidy(spark, ["a"], dt.date(2024, 1, 2))))
