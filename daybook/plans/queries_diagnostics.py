"""Queries over residual structure, subgroups and the block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook import constants as K
from daybook.constants import FDR_Q, MAX_LAG, SUBGROUPS
from daybook.operators import features, reports, residuals, scores, spectra, subgroups, verdicts
from daybook.operators import panel as P
from daybook.operators.panel import KEYS
from daybook.plans import tables as T
from daybook.plans.queries_features import EXOG_FEATURES
from daybook.plans.queries_scores import CALENDAR_COLUMNS
from daybook.plans.registry import query
from daybook.plans.sql import R, rows, twin
from daybook.plans.workspace import ANNUAL_TERMS, Workspace, rounded

REPLICATES = 2000
# Decimals where means of 640 rows and the like would end in a tie at the sixth.
FINE = 8


@query(
    "stage1_residuals",
    twin(f"SELECT series_id, date, split, y_true, {R('y_pred')} AS y_pred, {R('residual')} AS residual FROM resid", "resid"),
)
def stage1_residuals(ws: Workspace) -> DataFrame:
    return rounded(residuals.stage1_residuals(ws.tidy_of("moving_average_28")))


@query(
    "oof_residuals",
    twin(
        f"""SELECT series_id, date, fold, y_true, {R("y_pred")} AS y_pred, {R("y_true - y_pred")} AS residual
        FROM folded WHERE has_oof AND fold <> 1""",
        "folded",
    ),
)
def oof_residuals(ws: Workspace) -> DataFrame:
    return rounded(residuals.oof_residuals(ws.mean_oof, 1))


@query(
    "acf",
    twin(
        f"""SELECT series_id, lag, n, {R("acf")} AS acf, {R("band")} AS band, abs(acf) > band AS outside_band
        FROM acf_band""",
        "acf_band",
    ),
)
def acf(ws: Workspace) -> DataFrame:
    return rounded(spectra.acf(ws.stage1_like))


@query(
    "pacf",
    twin(
        f""", r AS (SELECT series_id, list(acf * n / (n - lag) ORDER BY lag) AS r FROM acf GROUP BY series_id),
        walk AS (SELECT series_id, r, 1 AS k, [r[1]] AS phi FROM r
        UNION ALL SELECT series_id, r, k + 1, list_concat(
            list_transform(range(1, k + 1), lambda i: phi[i] - last * phi[k + 1 - i]), [last]) FROM (
            SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i])))
            / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) AS last
            FROM walk WHERE k < {MAX_LAG}))
        SELECT series_id, k::BIGINT AS lag, {R("phi[k]")} AS pacf FROM walk""",
        "acf",
    ),
)
def pacf(ws: Workspace) -> DataFrame:
    return rounded(spectra.pacf(ws.stage1_like))


_LJUNG = " UNION ALL ".join(
    f"SELECT series_id, {h}::BIGINT AS lag, max(n) * (max(n) + 2.0::DOUBLE) * sum(acf * acf / (n - lag)) AS lb_stat "
    f"FROM acf WHERE lag <= {h} GROUP BY series_id"
    for h in (7, 14, 28)
)


@query("ljung_box_statistic", twin(f"SELECT series_id, lag, {R('lb_stat')} AS lb_stat FROM ({_LJUNG})", "acf"))
def ljung_box_statistic(ws: Workspace) -> DataFrame:
    return rounded(spectra.ljung_box_statistic(ws.stage1_like))


# Tails by Simpson's rule: the chi-square of odd and even degrees alike, and the cosine power whose
# integral is that of the t distribution; both independent of the continued fractions they check.
_STEPS = 2000
_SIMPSON = f"CASE WHEN j IN (0, {_STEPS}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"


@query(
    "ljung_box",
    twin(
        f"""SELECT series_id, lag, {R("any_value(lb_stat)")} AS lb_stat,
        {R(f"1 - sum({_SIMPSON} * 2 * pow(u, lag - 1) * exp(-u * u / 2) / (pow(2, lag / 2.0::DOUBLE) * gamma(lag / 2.0::DOUBLE))) * any_value(top) / (3.0::DOUBLE * {_STEPS})")}
        AS lb_pvalue FROM (SELECT *, j * top / {_STEPS} AS u FROM (
        SELECT *, least(sqrt(lb_stat), 40.0::DOUBLE) AS top, unnest(range(0, {_STEPS + 1})) AS j FROM ({_LJUNG})))
        GROUP BY series_id, lag""",
        "acf",
    ),
)
def ljung_box(ws: Workspace) -> DataFrame:
    return rounded(spectra.ljung_box(ws.stage1_like))


@query(
    "report_acf",
    twin(
        f"""SELECT a.series_id, a.lag, {R("acf")} AS acf, {R("band")} AS band, abs(acf) > band AS outside_band,
        {R("lb_stat")} AS lb_stat FROM acf_band a LEFT JOIN ({_LJUNG}) q
        ON q.series_id = a.series_id AND q.lag = a.lag WHERE a.lag IN (1, 2, 3, 7, 14, 21, 28)""",
        "acf_band",
    ),
)
def report_acf(ws: Workspace) -> DataFrame:
    statistic = spectra.ljung_box_statistic(ws.stage1_like)
    return rounded(reports.acf_report(spectra.acf(ws.stage1_like), statistic))


_PERIODOGRAM = """, wave AS (SELECT series_id, n, bin, (CASE WHEN 2 * bin = n THEN 1 ELSE 2 END) * (c * c + s * s) / n AS power
    FROM (SELECT series_id, max(n) AS n, bin, sum(x * cos(2 * pi() * bin * pos / n)) AS c,
    sum(x * sin(2 * pi() * bin * pos / n)) AS s FROM (
    SELECT *, unnest(range(1, n // 2 + 1)) AS bin FROM centred) GROUP BY series_id, bin)),
    spectrum AS (SELECT *, power / sum(power) OVER (PARTITION BY series_id) AS share,
    n / bin::DOUBLE AS period FROM wave) """


@query(
    "periodogram",
    twin(
        f"""{_PERIODOGRAM} SELECT series_id, bin, {R("bin / n::DOUBLE")} AS frequency, {R("period")} AS period_days,
        {R("power", 4)} AS power, {R("share")} AS power_share FROM spectrum""",
        "centred",
    ),
)
def periodogram(ws: Workspace) -> DataFrame:
    table = spectra.periodogram(ws.stage1_like).withColumn("power", F.round("power", 4))
    return rounded(table)


@query(
    "period7_ratio",
    twin(
        f"""{_PERIODOGRAM} SELECT series_id, count(*) AS n_bins,
        {R("arg_min(share, abs(period - 7)) * count(*)", 5)} AS peak7_ratio FROM spectrum GROUP BY series_id""",
        "centred",
    ),
)
def period7_ratio(ws: Workspace) -> DataFrame:
    return rounded(spectra.period7_ratio(spectra.periodogram(ws.stage1_like)), 5)


def exog_correlations(ws: Workspace) -> DataFrame:
    """Rank correlations of the residual with the exogenous features of its day, net of the season.

    The terms are rounded, so that equal phases of the year tie in the ranks.
    """
    exog = features.exog_features(ws.exog, T.EXOG).drop("series_id")
    terms = ws.days.select("date", *[F.round(c, 9).alias(c) for c in ANNUAL_TERMS])
    first, last = ws.bounds.val[0], ws.bounds.test[1]
    days = terms.where(F.col("date").between(first, last)).join(exog, "date", "left")
    return spectra.rank_correlations_by_day(
        ws.stage1_like, days, EXOG_FEATURES, ANNUAL_TERMS, (last - first).days + 1
    )


def exog_tests(ws: Workspace) -> DataFrame:
    return spectra.correlation_tests(exog_correlations(ws), len(ANNUAL_TERMS))


def _partial_sql() -> str:
    """Rank correlations and their partial forms by the recursion formula, one control a step."""
    names = ["y", "x", "c0", "c1", "c2", "c3"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def rank(c: str, by: str) -> str:
        return (
            f"rank() OVER (PARTITION BY {by} ORDER BY {c}) "
            f"+ (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
        )

    own = [rank("residual", "series_id") + " AS y"]
    own += [rank(f"round({c}, 9)", "series_id") + f" AS c{i}" for i, c in enumerate(ANNUAL_TERMS)]
    out = f""", ranked AS (SELECT r.series_id, r.date, {rows(*own)}
        FROM resid r JOIN days d ON d.date = r.date),
        long AS (SELECT date, feature, value FROM (UNPIVOT (SELECT date, {rows(*EXOG_FEATURES)} FROM exog_features)
        ON {rows(*EXOG_FEATURES)} INTO NAME feature VALUE value)),
        joined AS (SELECT r.*, feature, {rank("value", "r.series_id, feature")} AS x
        FROM ranked r JOIN long l ON l.date = r.date),
        s0 AS (SELECT series_id, feature, count(*) AS n, {rows(*[f"corr({a}, {b}) AS {a}_{b}" for a, b in pairs])}
        FROM joined GROUP BY series_id, feature)"""
    left = names
    for step, gone in enumerate(["c0", "c1", "c2", "c3"]):
        left = [v for v in left if v != gone]
        key = lambda a, b: "_".join(sorted((a, b), key=names.index))
        terms = [
            f"({key(a, b)} - {key(a, gone)} * {key(b, gone)}) / nullif(sqrt((1 - {key(a, gone)} * {key(a, gone)})"
            f" * (1 - {key(b, gone)} * {key(b, gone)})), 0) AS {key(a, b)}"
            for i, a in enumerate(left)
            for b in left[i + 1 :]
        ]
        raw = "y_x AS raw" if step == 0 else "raw"
        out += f", s{step + 1} AS (SELECT series_id, feature, n, {raw}, {rows(*terms)} FROM s{step})"
    return out


@query(
    "rank_correlations",
    twin(
        f"""{_partial_sql()} SELECT series_id, feature, n, {R("raw", 5)} AS spearman_raw,
        {R("y_x", 5)} AS spearman_partial FROM s4""",
        "resid",
        "days",
        "exog_features",
    ),
)
def rank_correlations(ws: Workspace) -> DataFrame:
    """Raw and partial Spearman coefficients of the residual with every exogenous feature."""
    return rounded(exog_correlations(ws), 5)


def _tested_sql() -> str:
    """The coefficients with p-values and adjusted p-values of each series."""
    dof = f"n - 2 - (CASE WHEN net THEN {len(ANNUAL_TERMS)} ELSE 0 END)"
    return f"""{_partial_sql()}, sides AS (
        SELECT series_id, feature, false AS net, n, raw AS r FROM s4
        UNION ALL SELECT series_id, feature, true, n, y_x FROM s4),
        steps AS (SELECT *, least(pi() / 2 - low, 10 / sqrt(power)) AS width, unnest(range(0, {_STEPS + 1})) AS j
        FROM (SELECT *, {dof} - 1 AS power, asin(abs(r)) AS low FROM sides)),
        tails AS (SELECT series_id, feature, net, least(1, any_value(width) / (3.0::DOUBLE * {_STEPS})
        * sum({_SIMPSON} * pow(greatest(0, cos(low + j * width / {_STEPS})), power))
        * exp(lgamma(any_value(power) / 2.0::DOUBLE + 1) - lgamma(any_value(power) / 2.0::DOUBLE + 0.5)) * 2 / sqrt(pi())) AS p
        FROM steps GROUP BY series_id, feature, net),
        pvalues AS (SELECT series_id, feature, max(p) FILTER (NOT net) AS p_raw, max(p) FILTER (net) AS p_partial
        FROM tails GROUP BY series_id, feature),
        tested AS (SELECT series_id, feature, n, raw, y_x AS part, p_raw, p_partial, least(1, min(p_partial * m / i) OVER (
        PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p_partial, feature) AS i,
        count(p_partial) OVER (PARTITION BY series_id) AS m FROM s4 JOIN pvalues USING (series_id, feature)))"""


_TESTED_COLUMNS = rows(
    "series_id, feature, n",
    f"{R('raw')} AS spearman_raw, {R('part')} AS spearman_partial",
    f"{R('p_raw')} AS p_raw, {R('p_partial')} AS p_partial, {R('p_adj')} AS p_adj_bh, p_adj <= {FDR_Q}::DOUBLE AS significant",
)
_EXOG_PARTS = ("resid", "days", "exog_features")


@query("partial_spearman", twin(f"{_tested_sql()} SELECT {_TESTED_COLUMNS} FROM tested", *_EXOG_PARTS))
def partial_spearman(ws: Workspace) -> DataFrame:
    """The coefficients with p-values and the false-discovery decision."""
    return rounded(exog_tests(ws))


@query(
    "report_top_correlations",
    twin(
        f"""{_tested_sql()} SELECT {_TESTED_COLUMNS}, position FROM (SELECT *, row_number() OVER (
        PARTITION BY series_id ORDER BY abs(part) DESC NULLS LAST, feature) AS position FROM tested) WHERE position <= 10""",
        *_EXOG_PARTS,
    ),
)
def report_top_correlations(ws: Workspace) -> DataFrame:
    return rounded(
        reports.top_correlations(exog_tests(ws))
    )


def _acceptance_sql() -> str:
    """Facts of every series and the rules over them."""

    def answer(question: str, statistic: str, value: str, structure: float, white: float, rules: tuple[str, str]) -> str:
        return f"""SELECT series_id, '{question}' AS question, {statistic} AS statistic, {R(value)} AS value,
            {float(structure)}::DOUBLE AS threshold_structure, {float(white)}::DOUBLE AS threshold_white,
            CASE WHEN {rules[0]} THEN '{K.VERDICT_STRUCTURE}' WHEN {rules[1]} THEN '{K.VERDICT_WHITE}'
            ELSE '{K.VERDICT_AMBIGUOUS}' END AS verdict FROM facts"""

    calendar = """avg(abs(y_true - y_pred)) FILTER (day_type = 'festivo') / nullif(avg(abs(y_true - y_pred))
        FILTER (day_type = 'laborable' AND feat_is_bridge_day <> 1), 0)"""
    strong = f"p_adj <= {FDR_Q}::DOUBLE AND abs(part) >= {K.EXOG_PARTIAL_RHO_MIN}"
    answers = [
        answer(
            "Memoria temporal (ACF/PACF)",
            f"printf('{K.MEMORY_STATISTIC}', {MAX_LAG}, max_acf, max_lag, CASE WHEN max_outside THEN 'fuera' ELSE 'dentro' END, n_outside, {MAX_LAG})",
            "max_acf",
            K.ACF_STRUCTURE_MIN,
            K.ACF_WHITE_MAX,
            (
                f"max_acf >= {K.ACF_STRUCTURE_MIN} AND max_outside",
                f"max_acf < {K.ACF_WHITE_MAX} AND n_outside <= {K.BAND_EXCEEDANCE_WHITE_MAX}",
            ),
        ),
        answer(
            "Estacionalidad semanal",
            f"printf('{K.WEEK_STATISTIC}', acf7, peak7, spread)",
            "abs(acf7)",
            K.ACF_STRUCTURE_MIN,
            K.ACF_WHITE_MAX,
            (
                f"abs(acf7) >= {K.ACF_STRUCTURE_MIN} AND peak7 >= {K.SPECTRAL_PEAK_RATIO_MIN} AND spread >= {K.WEEKDAY_SPREAD_STRUCTURE_MIN}",
                f"abs(acf7) < {K.ACF_WHITE_MAX} AND peak7 < {K.SPECTRAL_PEAK_RATIO_MIN} AND spread < {K.WEEKDAY_SPREAD_WHITE_MAX}",
            ),
        ),
        answer(
            "Concentracion en calendario",
            f"printf('{K.CALENDAR_STATISTIC}', ratio)",
            "ratio",
            K.CALENDAR_RATIO_STRUCTURE_MIN,
            K.CALENDAR_RATIO_WHITE_MAX,
            (f"ratio >= {K.CALENDAR_RATIO_STRUCTURE_MIN}", f"ratio < {K.CALENDAR_RATIO_WHITE_MAX}"),
        ),
        answer(
            "Senal meteorologica (parcial, BH)",
            f"printf('{K.EXOG_STATISTIC}', n_strong, {K.EXOG_PARTIAL_RHO_MIN}::DOUBLE, {FDR_Q}::DOUBLE)",
            "n_strong",
            K.EXOG_MIN_SIGNIFICANT,
            0,
            (f"n_strong >= {K.EXOG_MIN_SIGNIFICANT}", "n_strong = 0"),
        ),
    ]
    return f"""{_tested_sql()} {_PERIODOGRAM},
        memory AS (SELECT series_id, max(abs(acf)) AS max_acf, arg_max(lag, abs(acf)) AS max_lag,
        arg_max(abs(acf) > band, abs(acf)) AS max_outside, count(*) FILTER (abs(acf) > band) AS n_outside,
        max(acf) FILTER (lag = 7) AS acf7 FROM acf_band GROUP BY series_id),
        weekly AS (SELECT series_id, max(coalesce(mean_residual / nullif(sigma, 0), 0))
        - min(coalesce(mean_residual / nullif(sigma, 0), 0)) AS spread FROM weekdays GROUP BY series_id),
        peaks AS (SELECT series_id, arg_min(share, abs(period - 7)) * count(*) AS peak7 FROM spectrum GROUP BY series_id),
        concentration AS (SELECT series_id, {calendar} AS ratio FROM resid_days GROUP BY series_id),
        signal AS (SELECT series_id, count(*) FILTER ({strong}) AS n_strong FROM tested GROUP BY series_id),
        facts AS (SELECT * FROM memory JOIN weekly USING (series_id) JOIN peaks USING (series_id)
        JOIN concentration USING (series_id) JOIN signal USING (series_id))
        {" UNION ALL ".join(answers)}"""


@query(
    "acceptance_verdicts",
    twin(_acceptance_sql(), *_EXOG_PARTS, "acf_band", "centred", "weekdays", "resid_days"),
)
def acceptance_verdicts(ws: Workspace) -> DataFrame:
    rows_ = ws.with_days(ws.stage1_like, ["weekday_es", *CALENDAR_COLUMNS])
    return rounded(
        verdicts.acceptance_verdicts(
            spectra.acf(rows_),
            residuals.weekday_profile(rows_),
            spectra.period7_ratio(spectra.periodogram(rows_)),
            residuals.calendar_group_residuals(rows_),
            exog_tests(ws),
        )
    )


@query(
    "bh_adjust",
    twin(
        f""", tested AS (SELECT series_id, lag, exp(-abs(acf) * sqrt(n)) AS p FROM acf)
        SELECT series_id, lag, {R("p")} AS p, {R("adj")} AS p_adj_bh, adj <= 0.10::DOUBLE AS significant FROM (
        SELECT *, least(1, min(p * m / i) OVER (PARTITION BY series_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p, lag) AS i,
        count(*) OVER (PARTITION BY series_id) AS m FROM tested))""",
        "acf",
    ),
)
def bh_adjust(ws: Workspace) -> DataFrame:
    """False-discovery control over the lags of each series, on an exponential bound."""
    bound = F.exp(-F.abs("acf") * F.sqrt("n"))
    tested = spectra.acf(ws.stage1_like).select("series_id", "lag", bound.alias("p"))
    return rounded(scores.bh_adjust(tested, ["series_id"], "p", "lag"))


@query(
    "subgroup_masks",
    twin(
        f"""SELECT f.series_id, {rows(*[f"count(*) FILTER (subgroup = '{g}') AS {g}" for g in SUBGROUPS])}
        FROM member f GROUP BY f.series_id""",
        "member",
    ),
)
def subgroup_masks(ws: Workspace) -> DataFrame:
    """Days of each series in every subgroup, over the whole panel."""
    days = subgroups.with_easter(P.bridge_days(ws.calendar), ws.span).drop("calendar_id")
    changes = subgroups.with_anomaly(subgroups.weekly_change(ws.panel.select(*KEYS, "total")), ws.mad)
    masks = subgroups.subgroup_masks(P.attach_calendar(changes, days, ws.span))
    return masks.groupBy("series_id").agg(*[F.count_if(g).alias(g) for g in SUBGROUPS])


@query("train_mad", twin(f"SELECT series_id, {R('mad_scale')} AS mad_scale FROM mad", "mad"))
def train_mad(ws: Workspace) -> DataFrame:
    return rounded(ws.mad)


@query(
    "subgroup_metrics",
    twin(
        f"""SELECT scope, subgroup, model, n, n_days, {rows(*[f"{R(m, FINE)} AS {m}" for m in ("MAE", "RMSE", "MAPE", "R2")])},
        CASE WHEN n_days >= 10 THEN rank() OVER (PARTITION BY scope, subgroup ORDER BY MAE) END AS rank_MAE,
        n_days >= 20 AS inferential FROM sub_metrics""",
        "sub_metrics",
    ),
)
def subgroup_metrics(ws: Workspace) -> DataFrame:
    return rounded(ws.subgroup_metrics, FINE)


@query(
    "win_table",
    twin(
        f"""SELECT scope, subgroup, n, n_days, best_model, {R("best_MAE", FINE)} AS best_MAE, best_focal,
        {R("best_focal_MAE", FINE)} AS best_focal_MAE, inferential, {R("delta_MAE", FINE)} AS delta_MAE,
        {R("delta_pct", FINE)} AS delta_pct, focal_ranks_first FROM wins""",
        "wins",
    ),
)
def win_table(ws: Workspace) -> DataFrame:
    return rounded(ws.win_table, FINE)


_BOOT = f""", day_errors AS (SELECT subgroup, date_diff('day', val_end, date) - 1 AS pos, model,
    count(*) AS n, sum(abs(y_true - y_pred)) AS e FROM tidy t
    JOIN member m USING (series_id, date) CROSS JOIN bounds
    WHERE split = 'test' AND subgroup NOT LIKE 'periodo%' GROUP BY ALL),
    size AS (SELECT date_diff('day', test_start, test_end) + 1 AS d FROM bounds),
    draws AS (SELECT b, start + o AS pos FROM (SELECT b, j, o, d,
    ('0x' || substr(md5('42:' || b || ':' || j), 1, 8))::BIGINT % (d - 6) AS start
    FROM size, range({REPLICATES}) r1(b), range((SELECT (d + 6) // 7 FROM size)) r2(j), range(7) r3(o))
    WHERE j * 7 + o < d),
    per_model AS (SELECT b, subgroup, model, count(*) AS drawn, sum(e) / sum(n) AS mae
    FROM draws JOIN day_errors USING (pos) GROUP BY ALL),
    replicate AS (SELECT b, subgroup, min(mae) FILTER (model LIKE 'ensemble%')
    - min(mae) FILTER (model NOT LIKE 'ensemble%') AS delta FROM per_model WHERE drawn >= 20 GROUP BY ALL),
    observed AS (SELECT subgroup, n, n_days, min(mae) FILTER (model LIKE 'ensemble%')
    - min(mae) FILTER (model NOT LIKE 'ensemble%') AS delta_MAE FROM (SELECT subgroup, model, sum(n)::BIGINT AS n,
    count(*) AS n_days, sum(e) / sum(n) AS mae FROM day_errors GROUP BY ALL) WHERE n_days >= 20 GROUP BY ALL),
    spread AS (SELECT subgroup, count(*) / {REPLICATES}.0::DOUBLE AS frac,
    least(1, 2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT))) AS p,
    quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM replicate GROUP BY subgroup),
    boot AS (SELECT o.subgroup, o.n, o.n_days, delta_MAE, CASE WHEN frac >= 0.9 THEN lo END AS ci_low,
    CASE WHEN frac >= 0.9 THEN hi END AS ci_high, p AS p_raw, coalesce(frac, 0) AS frac_usable,
    row_number() OVER (ORDER BY p NULLS LAST, o.subgroup) AS i, count(p) OVER () AS m
    FROM observed o LEFT JOIN spread s ON s.subgroup = o.subgroup),
    tested AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN least(1, min(p_raw * m / i) OVER (ORDER BY i
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adj_bh FROM boot) """


@query(
    "block_bootstrap",
    twin(
        f"""{_BOOT} SELECT subgroup, n, n_days, {rows(*[f"{R(c)} AS {c}" for c in
        ("delta_MAE", "ci_low", "ci_high", "p_raw", "frac_usable", "p_adj_bh")])},
        coalesce(p_adj_bh <= 0.10::DOUBLE, false) AS significant FROM tested""",
        "tidy",
        "member",
        "bounds",
    ),
)
def block_bootstrap(ws: Workspace) -> DataFrame:
    return rounded(ws.bootstrap(REPLICATES))


@query(
    "subgroup_verdicts",
    twin(
        f"""{_BOOT} SELECT w.subgroup, n_test, n_val, CASE
        WHEN w.subgroup LIKE 'periodo%' THEN 'no analizable (sin solape val-test)'
        WHEN n_test < 20 THEN 'no inferencial (n insuficiente)'
        WHEN first_test AND first_val AND n_val >= 20 AND coalesce(p_adj_bh <= 0.10, false) THEN 'gana con evidencia'
        WHEN first_test THEN 'primero sin evidencia' ELSE 'no gana' END AS verdict FROM (
        SELECT subgroup, coalesce(max(n_days) FILTER (scope = 'test'), 0) AS n_test,
        coalesce(max(n_days) FILTER (scope = 'val'), 0) AS n_val,
        coalesce(bool_or(focal_ranks_first) FILTER (scope = 'test'), false) AS first_test,
        coalesce(bool_or(focal_ranks_first) FILTER (scope = 'val'), false) AS first_val
        FROM wins GROUP BY subgroup) w LEFT JOIN tested t ON t.subgroup = w.subgroup""",
        "tidy",
        "member",
        "bounds",
        "wins",
    ),
)
def subgroup_verdicts(ws: Workspace) -> DataFrame:
    return subgroups.subgroup_verdicts(ws.win_table, ws.bootstrap(REPLICATES))


@query("report_subgroups")
def report_subgroups(ws: Workspace) -> DataFrame:
    """Win tables of both scopes beside the verdict of each subgroup."""
    reading = subgroups.subgroup_verdicts(ws.win_table, ws.bootstrap(REPLICATES))
    return rounded(reports.subgroup_report(ws.subgroup_metrics, ws.win_table, reading))
