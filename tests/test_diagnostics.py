import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.functions.tails import beta_ratio, gamma_tail
from daybook.operators import scores, spectra, splits, subgroups
from daybook.operators.panel import Span


def series(make_panel, arrays):
    return make_panel({i: [float(v) for v in x] for i, x in enumerate(arrays)}, "residual", "double")


def test_ar1_and_white_noise(make_panel):
    rng = np.random.default_rng(42)
    noise = rng.normal(size=4000)
    ar = np.zeros(4000)
    for t in range(1, 4000):
        ar[t] = 0.7 * ar[t - 1] + noise[t]
    white = np.random.default_rng(7).normal(size=2000)
    df = series(make_panel, [ar, white])
    acf = {(r["series_id"], r["lag"]): r for r in spectra.acf(df).collect()}
    for k in (1, 2, 3):
        assert acf[0, k]["acf"] == pytest.approx(0.7**k, abs=0.05)
    assert sum(acf[1, k]["outside_band"] for k in range(1, 36)) <= 4
    pacf = {(r["series_id"], r["lag"]): r["pacf"] for r in spectra.pacf(df).collect()}
    assert pacf[0, 1] == pytest.approx(0.7, abs=0.05)
    assert all(abs(pacf[0, k]) < 0.06 for k in range(2, 10))


def test_pacf_solves_the_yule_walker_equations(make_panel):
    x = np.cumsum(np.random.default_rng(3).normal(size=300))
    centred = x - x.mean()
    n = len(x)
    gamma = np.array([centred[k:] @ centred[: n - k] / (n - k) for k in range(11)])
    got = {r["lag"]: r["pacf"] for r in spectra.pacf(series(make_panel, [x]), max_lag=10).collect()}
    for k in range(1, 11):
        toeplitz = np.array([[gamma[abs(i - j)] for j in range(k)] for i in range(k)])
        # The adjusted zero lag equals the plain one, so the system needs no rescaling.
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, gamma[1 : k + 1])[-1], abs=1e-9)


def test_ljung_box_against_its_formula(make_panel):
    x = np.random.default_rng(5).normal(size=393)
    c = x - x.mean()
    r = [c[k:] @ c[:-k] / (c @ c) for k in range(1, 15)]
    q = 393 * 395 * sum(v * v / (393 - k) for k, v in enumerate(r, 1))
    row = spectra.ljung_box(series(make_panel, [x])).where("lag = 14").first()
    assert row["lb_stat"] == pytest.approx(q)
    closed = math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(7))
    assert row["lb_pvalue"] == pytest.approx(closed)


def test_tails_against_closed_forms():
    assert float(gamma_tail(0.5, 1.0)) == pytest.approx(math.erfc(1.0))
    assert float(gamma_tail(3.5, 0.0)) == 1.0
    for t in (0.1, 1.0, 50.0):
        assert float(beta_ratio(0.5, 0.5, 1 / (1 + t * t))) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
        assert float(beta_ratio(1.0, 0.5, 2 / (2 + t * t))) == pytest.approx(1 - t / math.sqrt(2 + t * t))


def test_periodogram_finds_the_week(make_panel):
    t = np.arange(700)
    x = np.sin(2 * np.pi * t / 7) + 0.1 * np.random.default_rng(1).normal(size=700)
    table = spectra.periodogram(series(make_panel, [x, x[:699]]))
    top = table.where("series_id = 0").orderBy(F.desc("power")).first()
    assert top["period_days"] == pytest.approx(7) and top["power_share"] > 0.8
    sums = table.groupBy("series_id").agg(F.sum("power_share").alias("s"), F.count("*").alias("n")).orderBy("series_id").collect()
    assert [r["n"] for r in sums] == [350, 349] and all(r["s"] == pytest.approx(1) for r in sums)
    ratio = spectra.period7_ratio(table).where("series_id = 0").first()
    assert ratio["peak7_ratio"] == pytest.approx(top["power_share"] * 350)


def test_partial_correlation_collapses_when_the_season_is_held(spark):
    t = np.arange(400)
    rng = np.random.default_rng(9)
    season = np.sin(2 * np.pi * t / 365.25)
    controls = {f"c{i}": v for i, v in enumerate((season, np.cos(2 * np.pi * t / 365.25)))}
    y, x = season + 0.05 * rng.normal(size=400), season + 0.05 * rng.normal(size=400)
    z = rng.normal(size=400)
    rows = [(1, int(i), float(y[i]), float(x[i]), float(z[i]), *[float(c[i]) for c in controls.values()]) for i in t]
    df = spark.createDataFrame(rows, "series_id bigint, k int, residual double, x double, z double, c0 double, c1 double")
    df = df.withColumn("date", F.expr("date_add(date'2024-01-01', k)"))
    got = {r["feature"]: r for r in spectra.partial_spearman(df, ["x", "z"], ["c0", "c1"]).collect()}
    assert got["x"]["spearman_raw"] > 0.9 and abs(got["x"]["spearman_partial"]) < 0.3

    def ranks(v):
        return np.argsort(np.argsort(v)).astype(float)

    design = np.column_stack([np.ones(400), *[ranks(c) for c in controls.values()]])

    def left(v):
        r = ranks(v)
        return r - design @ np.linalg.lstsq(design, r, rcond=None)[0]

    for name, values in (("x", x), ("z", z)):
        assert got[name]["spearman_partial"] == pytest.approx(np.corrcoef(left(y), left(values))[0, 1], abs=1e-9)
        assert 0 <= got[name]["p_partial"] <= 1


def test_rank_correlations_rank_the_rows_that_count(spark):
    rng = np.random.default_rng(21)
    names = ["residual", "a", "b", "same", "flat", "empty", "c0", "c1"]
    rows = []
    for series_id in (1, 2):
        for k in range(90):
            v = dict(zip(names, [float(x) for x in rng.integers(0, 12, len(names))]))  # many ties
            v |= {"flat": 3.0, "empty": None, "c0": v["c0"] + k / 9}
            if k % 5 == 0:
                v |= {"b": None, "same": None}
            if k % 7 == 3:
                v["a"] = None
            if k == 11:
                v["residual"] = None
            if k == 12:
                v["c1"] = None
            rows.append((series_id, k, *[v[n] for n in names]))
    schema = "series_id bigint, k int, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(rows, schema).withColumn("date", F.expr("date_add(date'2024-01-01', k)"))
    features, controls = ["a", "b", "same", "flat", "empty"], ["c0", "c1"]
    assert spectra.null_patterns(df, features, ["residual", *controls]) == [["a"], ["b", "same"], ["flat"], ["empty"]]
    table = spectra.rank_correlations(df, features, controls)
    got = {(r["series_id"], r["feature"]): r for r in table.collect()}
    assert len(got) == 8  # no row counts for "empty"
    whole = df.toPandas()
    for (series_id, feature), row in got.items():
        use = whole[whole.series_id == series_id][["residual", feature, *controls]].dropna().rank()
        assert row["n"] == len(use)
        if feature == "flat":
            assert row["spearman_raw"] is None and row["spearman_partial"] is None
            continue
        assert row["spearman_raw"] == pytest.approx(use.corr().iloc[0, 1], abs=1e-12)
        inverse = np.linalg.inv(use.corr().to_numpy())
        expected = -inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1])
        assert row["spearman_partial"] == pytest.approx(expected, abs=1e-9)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    rows_part = plan[plan.index("Aggregate [series_id") :]
    assert "Generate" not in rows_part and "Expand" not in plan  # rows are not multiplied


def test_rank_correlations_by_day_equal_those_of_the_rows(spark):
    rng = np.random.default_rng(22)
    features, controls = ["a", "b", "empty"], ["c0", "c1"]
    days = [
        (k, float(rng.integers(9)), None if k % 4 == 0 else float(rng.integers(30)), None, float(k % 17), None if k == 5 else float(k))
        for k in range(80)
    ]
    days = spark.createDataFrame(days, "k int, a double, b double, empty double, c0 double, c1 double")
    days = days.withColumn("date", F.expr("date_add(date'2024-01-01', k)")).drop("k")
    rows = [(s, int(k), float(rng.integers(20))) for s in (1, 2, 3) for k in range(80)]
    rows = spark.createDataFrame(rows, "series_id bigint, k int, residual double")
    rows = rows.withColumn("date", F.expr("date_add(date'2024-01-01', k)")).drop("k")
    order = ["series_id", "feature"]
    got = spectra.rank_correlations_by_day(rows, days, features, controls, 80).orderBy(*order).collect()
    wanted = spectra.rank_correlations(rows.join(days, "date"), features, controls).orderBy(*order).collect()
    assert len(got) == 6
    for a, b in zip(got, wanted, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-12)
    gap = rows.where("NOT (series_id = 2 AND date = date'2024-02-01')")
    with pytest.raises(Exception, match="not every day"):
        spectra.rank_correlations_by_day(gap, days, features, controls, 80).collect()


def test_mad_reads_training_rows_only(make_panel):
    values = [0] * 140 + [10**6] * 60
    panel = make_panel({1: values})
    bounds = splits.split_span(Span(panel.first()["date"], panel.agg(F.max("date")).first()[0]))
    assert subgroups.train_mad(subgroups.weekly_change(panel), bounds).first()["mad_scale"] == 0.0


def errors(spark, n_days=60):
    rng = np.random.default_rng(2)
    rows = [("g", 1, float(a), float(b), i) for i, (a, b) in enumerate(zip(rng.uniform(1, 2, n_days), rng.uniform(1, 2, n_days)))]
    return spark.createDataFrame(rows, "subgroup string, n bigint, e0 double, e1 double, pos bigint").withColumn("subgroup", F.lit("sabado"))


def test_bootstrap_equals_brute_force(spark):
    import hashlib

    df, n_days, n_boot = errors(spark), 60, 40
    row = subgroups.block_bootstrap(df, ["f", "r"], ["f"], ["r"], n_days, n_boot).first()
    data = {r["pos"]: r for r in df.collect()}
    deltas = []
    for b in range(n_boot):
        positions = []
        for j in range(9):
            start = int(hashlib.md5(f"42:{b}:{j}".encode()).hexdigest()[:8], 16) % (n_days - 6)
            positions += range(start, start + 7)
        positions = positions[:n_days]
        f, r = (sum(data[p][e] for p in positions) / n_days for e in ("e0", "e1"))
        deltas.append(f - r)
    low, high = np.percentile(deltas, [2.5, 97.5])
    p = min(1.0, 2 * min(np.mean(np.array(deltas) <= 0), np.mean(np.array(deltas) >= 0)))
    assert row["ci_low"] == pytest.approx(low) and row["ci_high"] == pytest.approx(high)
    assert row["p_raw"] == pytest.approx(p) and row["frac_usable"] == 1.0
    again = subgroups.block_bootstrap(df, ["f", "r"], ["f"], ["r"], n_days, n_boot).first()
    assert again == row


def test_bootstrap_hides_the_interval_of_a_rare_group(spark):
    rare = errors(spark).where("pos % 3 = 0")
    row = subgroups.block_bootstrap(rare, ["f", "r"], ["f"], ["r"], 60, 60).first()
    assert row["frac_usable"] < 0.9 and row["ci_low"] is None and row["p_raw"] is not None


def test_families_choose_their_best(spark):
    rows = [("test", "g", m, 60, 19, v) for m, v in (("a", 3.0), ("b", 1.0), ("h", 1.0), ("i", 2.0))]
    df = spark.createDataFrame(rows, "scope string, subgroup string, model string, n bigint, n_days bigint, MAE double")
    row = subgroups.win_table(df, ["i", "h"], ["a", "b"]).first()
    assert (row["best_model"], row["best_focal"], row["delta_MAE"], row["focal_ranks_first"]) == ("b", "h", 0.0, False)
    assert not row["inferential"]  # 60 rows, but 19 days


def test_rolling_mae_needs_full_windows(make_panel):
    df = make_panel({1: [float(i) for i in range(30)]}, "y_true", "double").selectExpr("*", "0.0D as y_pred", "'m' as model")
    out = scores.rolling_mae(df, 28).orderBy("date").collect()
    assert [r["MAE"] for r in out] == [13.5, 14.5, 15.5]
