import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from daybook.constants import DRIFT_CEILING
from daybook.operators import reshape, residuals, scores, subgroups, verdicts

D0 = dt.date(2024, 1, 1)
TIDY = "series_id bigint, date date, split string, model string, y_true double, y_pred double"


def tidy(spark, pairs, model="m", split="test"):
    rows = [(1, D0 + dt.timedelta(days=i), split, model, y, p) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, TIDY)


def metrics(spark, pairs):
    return scores.all_metrics(tidy(spark, pairs), ["model"]).first()


def test_metric_edge_cases(spark):
    perfect = metrics(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)])
    assert (perfect["MAE"], perfect["RMSE"], perfect["MAPE"], perfect["R2"]) == (0, 0, 0, 1)
    assert metrics(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)])["R2"] == pytest.approx(0)
    assert metrics(spark, [(1.0, 3.0), (2.0, 0.0), (3.0, 1.0)])["R2"] < 0
    outlier = metrics(spark, [(0.0, 0.0), (0.0, 10.0)])
    assert outlier["RMSE"] == pytest.approx(math.sqrt(50)) and outlier["MAE"] == 5
    missing = metrics(spark, [(1.0, None), (2.0, 3.0), (None, 1.0)])
    assert (missing["n"], missing["MAE"]) == (1, 1)
    zero = metrics(spark, [(0.0, 5.0), (10.0, 11.0)])
    assert zero["MAPE"] == pytest.approx(10)
    assert metrics(spark, [(4.0, 5.0), (4.0, 3.0)])["R2"] is None


def test_no_pairs_is_an_error(spark):
    with pytest.raises(ValueError, match="no observation"):
        scores.require_pairs(tidy(spark, [(1.0, None)]))


def test_wide_metrics_equal_the_long_form(spark):
    wide = spark.createDataFrame(
        [(1, 5.0, 4.0, None), (1, 7.0, 9.0, 7.5), (2, 1.0, 1.0, 2.0)], "series_id bigint, total double, a double, b double"
    )
    got = {(r["series_id"], r["model"]): r for r in scores.wide_metrics(wide, ["a", "b"], ["series_id"]).collect()}
    assert got[1, "b"]["n"] == 1 and got[1, "b"]["MAE"] == 0.5
    assert got[1, "a"]["RMSE"] == pytest.approx(math.sqrt(2.5))


def test_breakdown_groups_overlap(spark):
    days = [("laborable", 1, 150.0), ("laborable", 0, 110.0), ("sabado", 0, 120.0), ("festivo", 0, 200.0)]
    rows = [(t, b, 100.0, p, "m") for t, b, p in days]
    df = spark.createDataFrame(rows, "day_type string, feat_is_bridge_day int, y_true double, y_pred double, model string")
    df = df.selectExpr("*", "date'2024-01-01' as date")
    table = scores.day_type_breakdown(df, ["model"])
    got = {r["group"]: (r["n"], r["MAE"]) for r in table.collect()}
    assert got == {
        "laborable": (2, 30), "laborable, bridge day": (1, 50), "laborable, ordinary": (1, 10), "sabado": (1, 20), "festivo": (1, 100),
    }
    assert all(r["small_sample"] for r in table.collect())
    wide = scores.breakdown_wide(table, ["m"]).where("`group` = 'festivo'").first()
    assert (wide["n"], wide["m_MAE"]) == (1, 100)


def test_ensemble_weights(spark):
    table = spark.createDataFrame([("v", "a", 10.0), ("v", "b", 5.0), ("v", "c", 1.0)], "split string, model string, MAE double")
    weights = {r["model"]: r["weight"] for r in scores.ensemble_weights(table, ["a", "b"], ["split"]).collect()}
    assert weights == {"a": pytest.approx(1 / 3), "b": pytest.approx(2 / 3)}
    wide = spark.createDataFrame([(100.0, 90.0, 110.0), (200.0, 210.0, 190.0)], "total double, a double, b double")
    equal = wide.select(scores.weighted_mean({"a": 0.5, "b": 0.5}).alias("p"), "total")
    assert all(r["p"] == r["total"] for r in equal.collect())
    assert scores.inverse_mae_weights(wide, ["a", "b"]) == {"a": 0.5, "b": 0.5}


def test_rank_ties_and_small_groups(spark):
    rows = [("g", "a", 1.0, 10), ("g", "b", 1.0, 10), ("g", "c", 2.0, 10), ("h", "a", 1.0, 9)]
    df = spark.createDataFrame(rows, "subgroup string, model string, MAE double, n int")
    got = {(r["subgroup"], r["model"]): r["rank_MAE"] for r in scores.rank_min(df, ["subgroup"]).collect()}
    assert got == {("g", "a"): 1, ("g", "b"): 1, ("g", "c"): 3, ("h", "a"): None}
    ranks = scores.rank_average(df, ["subgroup"], "MAE", "r").where("subgroup = 'g'")
    assert sorted(r["r"] for r in ranks.collect()) == [1.5, 1.5, 3.0]


def test_bh_is_monotone_and_matches_hand_values(spark):
    ps = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r["k"]: (r["p_adj_bh"], r["significant"]) for r in scores.bh_adjust(df, [], "p", "k").collect()}
    assert got[0][0] == pytest.approx(0.04) and got[2][0] == pytest.approx(0.16 / 3)
    assert got[1][0] == pytest.approx(0.16 / 3) and got[3][0] == pytest.approx(0.5)
    assert got[4] == (None, False)
    assert [got[k][1] for k in range(4)] == [True, True, True, False]


def test_error_chain_shares_sum_to_100(spark):
    rows = [("test", m, 5, v, v, v, 0.5) for m, v in (("a", 10.0), ("b", 7.0), ("c", 2.0))]
    df = spark.createDataFrame(rows, "split string, model string, n int, MAE double, RMSE double, MAPE double, R2 double")
    chain = scores.error_chain(df, ["a", "b", "c"], ["split"]).orderBy("step").collect()
    assert [r["delta_MAE_abs"] for r in chain] == [0, -3, -5]
    assert sum(r["gap_share_pct"] for r in chain) == pytest.approx(100)


def test_coverage_marks_a_category_of_one_fold(spark):
    rows = [(True, 1, 1, 1), (True, 2, 0, 1), (True, 3, 0, 0), (False, -1, 1, 1)]
    df = spark.createDataFrame(rows, "has_oof boolean, fold int, feat_only int, feat_both int")
    got = {r["category"]: r for r in scores.coverage_check(df, ["feat_only", "feat_both"], 1).collect()}
    assert got["only"]["zero_coverage_elsewhere"] and not got["both"]["zero_coverage_elsewhere"]
    assert not got["both"]["exclusion_is_safe"]


def metric_table(spark, change=None, drop=False):
    models = ["a", "b"][: 1 if drop else 2]
    rows = [(m, "test", 10, 100.0 * (change or 1.0) if m == "a" else 50.0, 120.0, 3.0, 0.9) for m in models]
    return spark.createDataFrame(rows, "model string, split string, n bigint, MAE double, RMSE double, MAPE double, R2 double")


def test_verify_metrics_levels(spark):
    keys, base = ["model", "split"], metric_table(spark)
    reshape.require_same_metrics(base, base, keys, DRIFT_CEILING)
    for factor, verdict in ((1 + 1e-5, "environment drift"), (1.4, "real change")):
        cells = reshape.verify_metrics(metric_table(spark, factor), base, keys, DRIFT_CEILING)
        bad = cells.where("verdict <> 'ok'").collect()
        assert [(r["model"], r["metric"], r["verdict"]) for r in bad] == [("a", "MAE", verdict)]
        with pytest.raises(ValueError, match="tolerance"):
            reshape.require_same_metrics(metric_table(spark, factor), base, keys, DRIFT_CEILING)
    with pytest.raises(ValueError, match="different rows"):
        reshape.require_same_metrics(metric_table(spark, drop=True), base, keys, DRIFT_CEILING)
    counts = base.withColumn("n", F.col("n") + 1)
    worst = reshape.verify_metrics(counts, base, keys, DRIFT_CEILING).where("metric = 'n'").first()
    assert worst["rel_deviation"] == float("inf")


def test_prediction_guards(spark):
    good = tidy(spark, [(1.0, 1.0), (2.0, 2.0)])
    assert reshape.check_predictions(good).count() == 2
    with pytest.raises(ValueError, match="outside"):
        reshape.check_predictions(tidy(spark, [(1.0, 1.0)], split="unassigned"))
    with pytest.raises(ValueError, match="repeated"):
        reshape.check_predictions(good.unionByName(good))
    partial = tidy(spark, [(1.0, 1.0)], model="short")
    kept = reshape.eval_matrix(good.unionByName(partial), ["test"], ["m", "short"])
    assert {r["model"] for r in kept.collect()} == {"m"}
    first = reshape.dedupe_first([good, good.withColumn("y_pred", F.lit(9.0))], ["series_id", "date", "model"])
    assert sorted(r["y_pred"] for r in first.collect()) == [1.0, 2.0]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    table = residuals.residual_histogram(tidy(spark, [(float(i), 0.0) for i in range(41)]), ["model"])
    got = {r["bin"]: r["n"] for r in table.collect()}
    assert max(got) == 40 and got[40] == 2 and sum(got.values()) == 41
    flat = residuals.residual_histogram(tidy(spark, [(1.0, 0.0)] * 3), ["model"]).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(1, 3)]


def test_unknown_feature_has_no_group(spark):
    table = spark.createDataFrame([("feat_x", 1.0)], "feature string, importance double")
    with pytest.raises(Exception, match="without a group"):
        reshape.importance_by_group(table, F.lit(None).cast("string")).collect()


def parity_runs(spark, maes, degenerate=0):
    rows = [("s", v, i < degenerate) for i, v in enumerate(maes)]
    return spark.createDataFrame(rows, "scope string, val_MAE double, degenerate boolean")


@pytest.mark.parametrize(
    "maes,degenerate,verdict",
    [
        ([400e3, 401e3, 402e3], 2, "fallo de capacidad/muestra"),
        ([300e3, 301e3, 302e3], 0, "asimetria informativa"),
        ([400e3, 401e3, 402e3], 0, "limitacion arquitectonica"),
        ([300e3, 313e3, 330e3], 0, "mixto/ambiguo"),
        ([340e3, 341e3, 342e3], 0, "mixto/ambiguo"),
    ],
)
def test_parity_verdict_order(spark, maes, degenerate, verdict):
    table = verdicts.parity_verdicts(parity_runs(spark, maes, degenerate), 416_324.0, 244_843.0)
    assert table.first()["verdict"] == verdict


def test_ablation_verdicts(spark):
    values = {"completo": 100.0, "solo_temporal": 105.0, "solo_exogeno": 104.9, "sin_meteo": 200.0}
    rows = [(s, 3, split, v) for s, v in values.items() for split in ("val", "test")]
    df = spark.createDataFrame(rows, "subset string, n_features int, split string, MAE double")
    got = {r["subset"]: r["verdict"] for r in verdicts.ablation_verdicts(df).collect()}
    assert got == {
        "completo": "referencia", "solo_temporal": "aporta (>= umbral)", "solo_exogeno": "no aporta (< umbral)", "sin_meteo": "solo informativo",
    }


def test_subgroup_verdict_levels(spark):
    wins = spark.createDataFrame(
        [
            ("test", "sabado", 30, True), ("val", "sabado", 30, True),
            ("test", "domingo", 30, True), ("val", "domingo", 30, False),
            ("test", "festivo", 5, True), ("val", "festivo", 30, True),
            ("test", "entre_semana", 30, False), ("val", "entre_semana", 30, True),
            ("test", "periodo_navidad", 90, True), ("val", "periodo_navidad", 90, True),
        ],
        "scope string, subgroup string, n_days bigint, focal_ranks_first boolean",
    )
    boot = spark.createDataFrame([("sabado", True), ("domingo", True)], "subgroup string, significant boolean")
    got = {r["subgroup"]: r["verdict"] for r in subgroups.subgroup_verdicts(wins, boot).collect()}
    assert got == {
        "sabado": "gana con evidencia", "domingo": "primero sin evidencia", "festivo": "no inferencial (n insuficiente)",
        "entre_semana": "no gana", "periodo_navidad": "no analizable (sin solape val-test)",
    }
