"""Shared common-table expressions of the SQL twins, joined by name with their dependencies."""

from __future__ import annotations

from daybook.constants import DAY_TYPES, FOURIER_TERMS, HOLIDAY_TYPES, WEEKDAYS_ES
from daybook.functions.text import slug
from daybook.plans.tables import BASELINES, EXOG, MODELS, PARTS, holidays


def R(expression: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    value = f"round(({expression})::DOUBLE, {digits})"
    return f"(CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END)"


def rows(*values: str) -> str:
    return ", ".join(values)


_HOLIDAYS = ",\n".join(
    f"(DATE '{day}', '{kind}', '{name}')" for day, kind, name in holidays(1990, 2010)
)
_WEEKDAYS = ", ".join(f"'{n}'" for n in WEEKDAYS_ES)
ONE_HOTS = rows(
    *[f"(day_type = '{v}')::INT AS feat_day_type_{slug(v)}" for v in DAY_TYPES],
    *[f"(holiday_type = '{v}')::INT AS feat_holiday_type_{slug(v)}" for v in HOLIDAY_TYPES],
    "(day_type IN ('sabado', 'domingo', 'domingo festivo'))::INT AS feat_is_weekend",
)
FOURIER = rows(
    *[
        f"{fn}(2 * pi() * {k} * date_diff('day', DATE '2023-01-01', date) / {period}) "
        f"AS feat_fourier_{label}_k{k}_{fn}"
        for label, period, k in FOURIER_TERMS
        for fn in ("sin", "cos")
    ]
)
ERROR = "y_true - y_pred"


def metrics(y: str = "y_true", p: str = "y_pred", digits: int = 6) -> str:
    """The five metric columns."""
    e = f"({y}::DOUBLE - {p}::DOUBLE)"
    seen = f"(CASE WHEN {e} IS NOT NULL THEN {y}::DOUBLE END)"
    return rows(
        f"count({e}) AS n",
        f"{R(f'avg(abs({e}))', digits)} AS MAE",
        f"{R(f'sqrt(avg({e} * {e}))', digits)} AS RMSE",
        f"{R(f'100 * avg(abs({e} / nullif({y}::DOUBLE, 0)))', digits)} AS MAPE",
        f"{R(f'1 - sum({e} * {e}) / nullif(var_pop({seen}) * count({seen}), 0)', digits)} AS R2",
    )


def trailing(column: str, width: int, fn: str, key: str = "PARTITION BY series_id ") -> str:
    """A statistic of the rows before the current one, null until there are enough."""
    over = f"OVER ({key}ORDER BY date ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({column}) {over} = {width} THEN {fn}({column}) {over} END"


# name: (dependencies, body)
CTES: dict[str, tuple[list[str], str]] = {
    "lines": (
        [],
        """SELECT l_suppkey::BIGINT AS series_id, l_shipdate::DATE AS date, l_returnflag,
            l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem""",
    ),
    "span": (
        ["lines"],
        "SELECT min(date) AS lo, max(date) AS hi, date_diff('day', min(date), max(date)) + 1 AS n FROM lines",
    ),
    "bounds": (
        ["span"],
        """SELECT lo AS train_start, lo + ((70 * n) // 100 - 1)::INT AS train_end,
            lo + ((70 * n) // 100)::INT AS val_start, lo + ((85 * n) // 100 - 1)::INT AS val_end,
            lo + ((85 * n) // 100)::INT AS test_start, hi AS test_end FROM span""",
    ),
    "sparse": (
        ["lines"],
        """SELECT series_id, date,
            coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0)::BIGINT AS part_a,
            coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0)::BIGINT AS part_n,
            coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0)::BIGINT AS part_r,
            sum(l_quantity)::BIGINT AS total
            FROM lines GROUP BY series_id, date""",
    ),
    "all_days": (
        ["span"],
        "SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM span",
    ),
    "panel": (
        ["sparse", "all_days"],
        """SELECT s.series_id, d.date, coalesce(p.part_a, 0) AS part_a,
            coalesce(p.part_n, 0) AS part_n, coalesce(p.part_r, 0) AS part_r,
            coalesce(p.total, 0) AS total
            FROM (SELECT DISTINCT series_id FROM sparse) s CROSS JOIN all_days d
            LEFT JOIN sparse p ON p.series_id = s.series_id AND p.date = d.date""",
    ),
    "city": (
        ["panel"],
        """SELECT (-1)::BIGINT AS series_id, date, sum(part_a)::BIGINT AS part_a,
            sum(part_n)::BIGINT AS part_n, sum(part_r)::BIGINT AS part_r,
            sum(total)::BIGINT AS total FROM panel GROUP BY date""",
    ),
    "holiday_list": (
        [],
        f"SELECT * FROM (VALUES {_HOLIDAYS}) AS h(date, holiday_type, holiday_name)",
    ),
    "calendar": (
        ["all_days", "holiday_list"],
        f"""SELECT d.date, list_extract([{_WEEKDAYS}], isodow(d.date)::INT) AS weekday_es,
            CASE WHEN holiday_name IS NOT NULL AND isodow(d.date) = 7 THEN 'domingo festivo'
                 WHEN holiday_name IS NOT NULL THEN 'festivo'
                 WHEN isodow(d.date) = 7 THEN 'domingo'
                 WHEN isodow(d.date) = 6 THEN 'sabado' ELSE 'laborable' END AS day_type,
            coalesce(holiday_type, 'none') AS holiday_type,
            coalesce(holiday_name, 'none') AS holiday_name
            FROM all_days d LEFT JOIN holiday_list h ON h.date = d.date""",
    ),
    "days": (
        ["calendar"],
        f"""SELECT *, {ONE_HOTS}, {FOURIER},
            (day_type = 'laborable' AND (
                coalesce(lag(day_type) OVER (ORDER BY date) IN ('festivo', 'domingo festivo'), false)
                OR coalesce(lead(day_type) OVER (ORDER BY date) IN ('festivo', 'domingo festivo'), false)
            ))::INT AS feat_is_bridge_day FROM calendar""",
    ),
    "easter": (
        ["calendar"],
        """SELECT DISTINCT c.date FROM calendar c JOIN calendar j
            ON j.holiday_name LIKE '%Jueves Santo%'
            AND c.date BETWEEN j.date - 4 AND j.date + 4""",
    ),
    "exog": (
        ["lines", "all_days"],
        """SELECT d.date, coalesce(discount_mean, 0) AS discount_mean,
            coalesce(tax_mean, 0) AS tax_mean, coalesce(price_mean, 0) AS price_mean,
            coalesce(quantity_max, 0) AS quantity_max
            FROM all_days d LEFT JOIN (SELECT date,
                sum(round_even(l_discount * 100, 0)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS discount_mean,
                sum(round_even(l_tax * 100, 0)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS tax_mean,
                sum(round_even(l_extendedprice * 100, 0)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS price_mean,
                max(l_quantity)::DOUBLE AS quantity_max FROM lines GROUP BY date) x
            ON x.date = d.date""",
    ),
    "exog_features": (
        ["exog"],
        "SELECT date, "
        + rows(
            *[f"lag({v}, {k}) OVER (ORDER BY date) AS feat_{v}_lag_{k}" for v in EXOG for k in (1, 2, 3, 7)],
            *[f"{trailing(v, 7, 'avg', '')} AS feat_{v}_roll_mean_7" for v in EXOG],
        )
        + " FROM exog",
    ),
    "history": (
        ["panel"],
        "SELECT series_id, date, total, "
        + rows(
            *PARTS,
            *[
                f"lag({c}, {k}) OVER (PARTITION BY series_id ORDER BY date) AS feat_{c}_lag_{k}"
                for c in ["total", *PARTS]
                for k in (1, 2, 3, 7, 14, 21, 28)
            ],
            *[
                f"{trailing('total', w, fn)} AS feat_total_roll_{stat}_{w}"
                for w in (7, 28)
                for stat, fn in (("mean", "avg"), ("std", "stddev_samp"))
            ],
        )
        + " FROM panel",
    ),
    "features": (
        ["history", "days", "exog_features"],
        """SELECT h.*, d.* EXCLUDE (date), x.* EXCLUDE (date) FROM history h
            LEFT JOIN days d ON d.date = h.date LEFT JOIN exog_features x ON x.date = h.date""",
    ),
    "base": (
        ["panel"],
        f"""SELECT series_id, date, total,
            row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
            lag(total, 1) OVER (PARTITION BY series_id ORDER BY date)::DOUBLE AS persistence,
            lag(total, 7) OVER (PARTITION BY series_id ORDER BY date)::DOUBLE AS seasonal_naive,
            {trailing('total', 7, 'avg')} AS moving_average_7,
            {trailing('total', 28, 'avg')} AS moving_average_28 FROM panel""",
    ),
    "baselines": (
        ["base", "bounds"],
        f"""SELECT series_id, date, total, {rows(*BASELINES)},
            CASE WHEN date BETWEEN train_start AND train_end THEN 'train'
                 WHEN date BETWEEN val_start AND val_end THEN 'val'
                 WHEN date BETWEEN test_start AND test_end THEN 'test'
                 ELSE 'unassigned' END AS split
            FROM base CROSS JOIN bounds WHERE rn > 28""",
    ),
    "weights": (
        ["baselines"],
        """SELECT (1 / s) / (1 / s + 1 / m) AS w_naive, (1 / m) / (1 / s + 1 / m) AS w_mean FROM (
            SELECT avg(abs(total::DOUBLE - seasonal_naive)) AS s,
            avg(abs(total::DOUBLE - moving_average_28)) AS m FROM baselines WHERE split = 'val')""",
    ),
    "wide": (
        ["baselines", "weights"],
        """SELECT b.*, seasonal_naive * 0.5::DOUBLE + moving_average_28 * 0.5::DOUBLE AS ensemble_equal,
            seasonal_naive * (SELECT w_naive FROM weights) + moving_average_28 * (SELECT w_mean FROM weights)
            AS ensemble_inverse_mae FROM baselines b""",
    ),
    "tidy": (
        ["wide"],
        f"""SELECT series_id, date, split, model, total::DOUBLE AS y_true, y_pred
            FROM (UNPIVOT wide ON {rows(*MODELS)} INTO NAME model VALUE y_pred)""",
    ),
    "metrics": (
        ["tidy"],
        "SELECT split, model, count(*) AS n, avg(abs(y_true - y_pred)) AS MAE, "
        "sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS RMSE, "
        "100 * avg(abs((y_true - y_pred) / nullif(y_true, 0))) AS MAPE, "
        "1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0) AS R2 "
        "FROM tidy GROUP BY split, model",
    ),
    "resid": (
        ["baselines"],
        """SELECT series_id, date, split, total::DOUBLE AS y_true, moving_average_28 AS y_pred,
            total::DOUBLE - moving_average_28 AS residual FROM baselines WHERE split <> 'train'""",
    ),
    "resid_days": (
        ["resid", "days"],
        "SELECT r.*, d.* EXCLUDE (date) FROM resid r JOIN days d ON d.date = r.date",
    ),
    "tidy_days": (
        ["tidy", "days"],
        "SELECT t.*, day_type, weekday_es, feat_is_bridge_day FROM tidy t JOIN days d ON d.date = t.date",
    ),
    "folded": (
        ["baselines"],
        """SELECT *, CASE WHEN pos < 200 THEN -1
                ELSE least(5, 1 + (pos - 200) // ((n_rows - 200) // 5)) END::BIGINT AS fold,
            pos >= 200 AS has_oof, total::DOUBLE AS y_true,
            CASE WHEN pos >= 200 THEN moving_average_7 END AS y_pred FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
            count(*) OVER (PARTITION BY series_id) AS n_rows FROM baselines WHERE split = 'train')""",
    ),
    "changes": (
        ["panel"],
        "SELECT series_id, date, total, total - lag(total, 7) OVER (PARTITION BY series_id ORDER BY date) AS delta7 FROM panel",
    ),
    "mad": (
        ["changes", "bounds"],
        """SELECT series_id, 1.4826::DOUBLE * median(abs(delta7 - centre)) AS mad_scale FROM (
            SELECT c.series_id, delta7::DOUBLE AS delta7,
            median(delta7::DOUBLE) OVER (PARTITION BY c.series_id) AS centre
            FROM changes c CROSS JOIN bounds
            WHERE delta7 IS NOT NULL AND date BETWEEN train_start AND train_end) GROUP BY series_id""",
    ),
    "flagged": (
        ["changes", "mad"],
        """SELECT c.series_id, c.date, c.total, delta7,
            coalesce(abs(delta7) > 3.0::DOUBLE * mad_scale, false) AS is_anomalous
            FROM changes c LEFT JOIN mad m ON m.series_id = c.series_id""",
    ),
    "member": (
        ["flagged", "days", "easter"],
        """SELECT f.series_id, f.date, unnest(list_filter([
            CASE WHEN day_type = 'laborable' AND b = 0 THEN 'laborable_ordinario' END,
            CASE WHEN day_type = 'laborable' AND b = 1 THEN 'laborable_puente' END,
            CASE WHEN day_type = 'sabado' THEN 'sabado' END,
            CASE WHEN day_type = 'domingo' THEN 'domingo' END,
            CASE WHEN day_type = 'festivo' THEN 'festivo' END,
            CASE WHEN day_type IN ('sabado', 'domingo') THEN 'fin_de_semana' END,
            CASE WHEN day_type IN ('laborable', 'festivo') THEN 'entre_semana' END,
            CASE WHEN irregular THEN 'calendario_irregular' ELSE 'calendario_ordinario' END,
            CASE WHEN month(f.date) IN (7, 8) THEN 'verano_jul_ago' ELSE 'resto_del_anio' END,
            CASE WHEN (month(f.date) = 12 AND day(f.date) >= 22)
                OR (month(f.date) = 1 AND day(f.date) <= 6) THEN 'periodo_navidad' END,
            CASE WHEN in_easter THEN 'periodo_semana_santa' END,
            CASE WHEN is_anomalous THEN 'demanda_anomala' END,
            CASE WHEN delta7 IS NOT NULL AND NOT is_anomalous THEN 'demanda_regular' END
            ], lambda g: g IS NOT NULL)) AS subgroup
            FROM flagged f JOIN (SELECT d.date, day_type, feat_is_bridge_day AS b,
                day_type = 'festivo' OR feat_is_bridge_day = 1 AS irregular,
                e.date IS NOT NULL AS in_easter
                FROM days d LEFT JOIN easter e ON e.date = d.date) k ON k.date = f.date""",
    ),
    "sub_metrics": (
        ["tidy", "member"],
        """SELECT scope, subgroup, model, count(*) AS n, count(DISTINCT t.date) AS n_days, avg(abs(y_true - y_pred)) AS MAE,
            sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS RMSE,
            100 * avg(abs((y_true - y_pred) / nullif(y_true, 0))) AS MAPE,
            1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0) AS R2
            FROM (SELECT *, unnest([split, 'val_test']) AS scope FROM tidy WHERE split <> 'train') t
            JOIN member m ON m.series_id = t.series_id AND m.date = t.date GROUP BY scope, subgroup, model""",
    ),
    "wins": (
        ["sub_metrics"],
        """SELECT *, n_days >= 20 AS inferential, best_focal_MAE - best_MAE AS delta_MAE,
            100 * (best_focal_MAE - best_MAE) / nullif(best_MAE, 0) AS delta_pct,
            best_focal_MAE < best_MAE AS focal_ranks_first FROM (
            SELECT scope, subgroup, max(n) AS n, max(n_days) AS n_days,
            arg_min(model, (MAE, model)) FILTER (model NOT LIKE 'ensemble%') AS best_model,
            min(MAE) FILTER (model NOT LIKE 'ensemble%') AS best_MAE,
            arg_min(model, (MAE, model)) FILTER (model LIKE 'ensemble%') AS best_focal,
            min(MAE) FILTER (model LIKE 'ensemble%') AS best_focal_MAE
            FROM sub_metrics GROUP BY scope, subgroup)""",
    ),
    "centred": (
        ["resid"],
        """SELECT *, residual - avg(residual) OVER (PARTITION BY series_id) AS x,
            row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
            count(*) OVER (PARTITION BY series_id) AS n FROM resid""",
    ),
    "acf": (
        ["centred"],
        """SELECT a.series_id, k.k AS lag, max(a.n) AS n, sum(a.x * b.x) / max(v.c0) AS acf
            FROM centred a CROSS JOIN (SELECT unnest(range(1, 36)) AS k) k
            JOIN centred b ON b.series_id = a.series_id AND b.pos = a.pos - k.k
            JOIN (SELECT series_id, sum(x * x) AS c0 FROM centred GROUP BY series_id) v
            ON v.series_id = a.series_id GROUP BY a.series_id, k.k""",
    ),
    "acf_band": (
        ["acf"],
        """SELECT *, 1.959963984540054::DOUBLE * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (
            PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band
            FROM acf""",
    ),
    "weekdays": (
        ["resid_days"],
        """SELECT series_id, weekday_es, count(*) AS n, avg(residual) AS mean_residual,
            median(residual) AS median_residual, stddev_samp(residual) AS sd,
            avg(abs(residual)) AS mean_abs_residual, max(sigma) AS sigma FROM (
            SELECT *, stddev_samp(residual) OVER (PARTITION BY series_id) AS sigma FROM resid_days)
            GROUP BY series_id, weekday_es""",
    ),
}


# Expressions that others read several times.
KEPT = {"panel", "baselines", "weights"}


def twin(select: str, *needs: str) -> str:
    """A query with the named expressions, and what they build on, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    heads = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}({CTES[name][1]})" for name in order
    )
    return f"WITH RECURSIVE {heads}\n{select}" if heads else select
