"""Metrics of overlapping groups from sums by day, against an aggregate over spread rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.constants import SUBGROUPS
from daybook.operators import scores, subgroups

START = dt.date(2024, 3, 20)
MODELS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for s in range(3):
        for d in range(60):
            day = START + dt.timedelta(days=d)
            kind = ["laborable"] * 5 + ["sabado", "domingo"]
            y = None if (s, d) == (1, 4) else 0 if d == 9 else 7 if d < 3 else (s * 31 + d * 7) % 23
            a = None if d < 2 or y is None else y + 0.3 * (d % 5)
            made.append((s, day, ["val", "test"][d >= 30], y, a, float(d % 11), kind[day.weekday()], d % 6 == 0, d % 13 == 0, None if d < 7 else d - 30.0, [None, False, True][(s + d) % 3]))
    schema = "series_id long, date date, scope string, total long, a double, b double, day_type string, bridge boolean, is_easter boolean, delta7 double, is_anomalous boolean"
    return spark.createDataFrame(made, schema).withColumn("feat_is_bridge_day", F.col("bridge").cast("int"))


def table(frame, keys):
    return {tuple(r[k] for k in [*keys, "model"]): {c: r[c] for c in ["n", "n_days", *scores.METRICS] if c in frame.columns} for r in frame.collect()}


def same(found, expected):
    assert set(found) == set(expected) and expected
    for key, row in found.items():
        assert all(row[c] == expected[key][c] or row[c] == pytest.approx(expected[key][c], rel=1e-9) for c in row), key


def test_subgroups_from_day_sums_equal_spread_rows(rows):
    rules = subgroups.subgroup_conditions()
    names = F.array_compact(F.array(*[F.when(rules[g], F.lit(g)) for g in SUBGROUPS]))
    spread = rows.withColumn("scope", F.explode(F.array("scope", F.lit("val_test")))).withColumn("subgroup", F.explode(names))
    expected = table(scores.wide_metrics(spread, MODELS, ["scope", "subgroup"], days=True), ["scope", "subgroup"])
    metrics = subgroups.subgroup_metrics(rows, MODELS)
    same(table(metrics, ["scope", "subgroup"]), expected)
    errors = {(r.date, r.subgroup): (r.n, r.e0, r.e1) for r in subgroups.day_errors(rows, MODELS, F.lit(START)).collect()}
    gaps = [F.sum(F.abs(F.col("total") - F.col(m))) for m in MODELS]
    plain = rows.withColumn("subgroup", F.explode(names)).groupBy("date", "subgroup").agg(F.count("*"), *gaps)
    assert {(r[0], r[1]): pytest.approx(tuple(r)[2:]) for r in plain.collect()} == errors


def test_day_types_from_day_sums_and_constant_truths(rows):
    spread = rows.withColumn("group", F.explode(scores.day_groups()))
    expected = scores.wide_metrics(spread, MODELS, ["scope", "group"], days=True).where("n > 0")
    found = scores.wide_day_type_breakdown(rows, MODELS, ["scope"])
    same(table(found, ["scope", "group"]), table(expected, ["scope", "group"]))
    flat = rows.withColumn("total", F.lit(0.1)).withColumn("g", F.lit(1))
    got = scores.metrics_of_sums(scores.day_sums(flat, MODELS, ["g"]), MODELS, ["g"])
    assert [r.R2 for r in got.collect()] == [None, None]


def test_rows_are_spread_after_they_are_summed(rows):
    plan = subgroups.subgroup_metrics(rows, MODELS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.rindex("Aggregate")
