"""Autocorrelation, spectrum and rank correlation of residual series."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.constants import FDR_Q, LJUNG_BOX_LAGS, MAX_LAG, NORMAL_975
from daybook.functions.tails import chi_square_tail, correlation_p
from daybook.operators.features import melt
from daybook.operators.panel import KEYS, by_series
from daybook.operators.scores import bh_adjust, rank_average
from daybook.session import materialise, small_side

#: Series whose spectra a task holds as arrays at one time.
SERIES_AT_A_TIME = 256


def acf_arrays(rows: DataFrame, column: str = "residual", max_lag: int = MAX_LAG) -> DataFrame:
    """Series length and the biased autocorrelations of lags 1..max_lag as one array per series.

    The lagged products come from one window pass and one aggregate, without a self-join.
    """
    centre = F.avg(column).over(Window.partitionBy("series_id"))
    centred = rows.select(*KEYS, (F.col(column) - centre).alias("_x"))
    w = by_series()
    lags = range(1, max_lag + 1)
    shifted = centred.select(
        "series_id", "_x", *[F.lag("_x", k).over(w).alias(f"_x{k}") for k in lags]
    )
    sums = shifted.groupBy("series_id").agg(
        F.count("_x").alias("n"),
        F.sum(F.col("_x") * F.col("_x")).alias("_c0"),
        *[F.sum(F.col("_x") * F.col(f"_x{k}")).alias(f"_c{k}") for k in lags],
    )
    ratios = [F.coalesce(F.try_divide(F.col(f"_c{k}"), F.col("_c0")), F.lit(0.0)) for k in lags]
    return sums.select("series_id", "n", F.array(*ratios).alias("r"))


def acf(rows: DataFrame, column: str = "residual", max_lag: int = MAX_LAG) -> DataFrame:
    """Autocorrelation per lag with the Bartlett band around zero."""
    arrays = acf_arrays(rows, column, max_lag)
    lagged = arrays.select("series_id", "n", F.posexplode("r").alias("_k", "acf"))
    w = Window.partitionBy("series_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(w), F.lit(0.0))
    half = F.lit(NORMAL_975) * F.sqrt((F.lit(1.0) + F.lit(2.0) * earlier) / F.col("n"))
    return lagged.select(
        "series_id",
        (F.col("_k") + 1).cast("long").alias("lag"),
        "n",
        "acf",
        half.alias("band"),
        (F.abs("acf") > half).alias("outside_band"),
    )


def partial_autocorrelations(r: Column, n: Column) -> Column:
    """Partial autocorrelations from autocorrelations: the Durbin-Levinson recursion.

    Uses the adjusted estimates, whose denominators are n - k.
    """
    adjusted = F.transform(r, lambda v, i: v * n / (n - i - 1))
    start = F.struct(
        F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out")
    )

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    def step(state: Column, value: Column) -> Column:
        phi = state["phi"]
        known = F.slice(adjusted, 1, F.size(phi))
        top = value - dot(phi, F.reverse(known))
        last = F.coalesce(F.try_divide(top, F.lit(1.0) - dot(phi, known)), F.lit(0.0))
        rest = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(
            F.concat(rest, F.array(last)).alias("phi"),
            F.concat(state["out"], F.array(last)).alias("out"),
        )

    return F.aggregate(adjusted, start, step, lambda state: state["out"])


def pacf(rows: DataFrame, column: str = "residual", max_lag: int = MAX_LAG) -> DataFrame:
    """Partial autocorrelation per series and lag."""
    arrays = acf_arrays(rows, column, max_lag)
    partial = partial_autocorrelations(F.col("r"), F.col("n"))
    lagged = arrays.select("series_id", F.posexplode(partial).alias("_k", "pacf"))
    return lagged.select("series_id", (F.col("_k") + 1).cast("long").alias("lag"), "pacf")


def ljung_box_statistic(
    rows: DataFrame, column: str = "residual", lags: list[int] = LJUNG_BOX_LAGS
) -> DataFrame:
    """Portmanteau statistic up to each of the given lags, per series."""
    arrays = acf_arrays(rows, column, max(lags))
    n = F.col("n").cast("double")
    terms = F.transform("r", lambda v, i: v * v / (n - i - 1))

    def q(h: int) -> Column:
        total = F.aggregate(F.slice(terms, 1, h), F.lit(0.0), lambda s, v: s + v)
        return F.struct(
            F.lit(h).cast("long").alias("lag"), (n * (n + 2) * total).alias("lb_stat")
        )

    return arrays.select("series_id", F.explode(F.array(*[q(h) for h in lags])).alias("q")).select(
        "series_id", "q.*"
    )


def ljung_box(rows: DataFrame, column: str = "residual", lags: list[int] = LJUNG_BOX_LAGS) -> DataFrame:
    """The statistic with its chi-square p-value."""
    table = ljung_box_statistic(rows, column, lags)
    return table.withColumn("lb_pvalue", chi_square_tail(F.col("lb_stat"), F.col("lag").cast("double")))


def _density(x: np.ndarray) -> np.ndarray:
    """One-sided density of a demeaned array, the zero frequency left out."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / x.size
    last = -1 if x.size % 2 == 0 else None
    power[1:last] *= 2.0
    return power[1:]


def _powers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``series_id, n, power`` of ``series_id, n, x``, a few series at a time.

    A batch holds as many series as Spark sends, so only slices of it are turned into arrays and sent back.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, SERIES_AT_A_TIME):
            piece = batch.slice(start, SERIES_AT_A_TIME)
            lists = piece.column("x")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = [_density(x) for x in np.split(flat, ends[:-1])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            power = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([piece.column("series_id"), piece.column("n"), power], ["series_id", "n", "power"])


def periodogram(rows: DataFrame, column: str = "residual") -> DataFrame:
    """Power and power share per frequency of each series.

    A series is an array no longer than the calendar; its transform costs n log n, where
    joining rows to frequencies would cost n squared.
    """
    ordered = F.sort_array(F.collect_list(F.struct("date", F.col(column).cast("double").alias("x"))))
    series = rows.groupBy("series_id").agg(ordered.alias("s")).where(F.size("s") > 1)
    values = series.select("series_id", F.size("s").alias("n"), F.transform("s", lambda p: p["x"]).alias("x"))
    kind = dict(rows.dtypes)["series_id"]
    powers = values.mapInArrow(_powers, f"series_id {kind}, n int, power array<double>")
    total = F.aggregate("power", F.lit(0.0), lambda s, v: s + v)
    bins = powers.withColumn("total", total).select(
        "series_id", "n", "total", F.posexplode("power").alias("_k", "power")
    )
    frequency = (F.col("_k") + 1) / F.col("n")
    return bins.select(
        "series_id",
        (F.col("_k") + 1).cast("long").alias("bin"),
        frequency.alias("frequency"),
        (F.lit(1.0) / frequency).alias("period_days"),
        "power",
        F.coalesce(F.try_divide(F.col("power"), F.col("total")), F.lit(0.0)).alias("power_share"),
    )


def period7_ratio(spectrum: DataFrame) -> DataFrame:
    """Share of the bin nearest seven days as a multiple of the mean share, per series."""
    nearest = F.min(F.struct(F.abs(F.col("period_days") - 7.0), F.col("bin"), F.col("power_share")))
    peak = spectrum.groupBy("series_id").agg(F.count("*").alias("n_bins"), nearest.alias("p"))
    return peak.select("series_id", "n_bins", (F.col("p.power_share") * F.col("n_bins")).alias("peak7_ratio"))


def eliminate(names: list[str], gone: str, r: dict[frozenset, Column]) -> dict[frozenset, Column]:
    """Pairwise correlations of ``names`` with the variable ``gone`` held fixed."""
    out = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ra, rb = r[frozenset((a, gone))], r[frozenset((b, gone))]
            spread = F.sqrt((F.lit(1.0) - ra * ra) * (F.lit(1.0) - rb * rb))
            out[frozenset((a, b))] = F.try_divide(r[frozenset((a, b))] - ra * rb, spread)
    return out


def null_patterns(rows: DataFrame, features: list[str], needed: list[str]) -> list[list[str]]:
    """The features in groups that are null on the same rows, of those that have all of ``needed``.

    Order-free sums of row hashes over the null rows tell the patterns apart, in one aggregate that
    gives one row; equal sums of both hashes mean equal patterns.
    """
    complete = F.lit(True)
    for name in needed:
        complete = complete & F.col(name).isNotNull()
    keys = [k for k in KEYS if k in rows.columns]
    marks = [F.xxhash64(*keys), F.xxhash64(F.lit("again"), *keys)]
    sums = [
        F.sum(F.when(F.col(name).isNull(), mark).cast("decimal(38, 0)")).alias(f"{name}_{i}")
        for name in features
        for i, mark in enumerate(marks)
    ]
    found = rows.where(complete).agg(*sums).first()
    groups: dict[tuple, list[str]] = {}
    for name in features:
        groups.setdefault((found[f"{name}_0"], found[f"{name}_1"]), []).append(name)
    return list(groups.values())


def masked_rank(column: str, counted: str, by: str = "series_id") -> Column:
    """Average rank of a column among the rows of its series that ``counted`` marks with one.

    Both windows of all masks over one column share a sort: the running count is taken in order of
    the column, the ties among neighbours in the same order.
    """
    up_to = F.sum(counted).over(
        Window.partitionBy(by).orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ties = F.sum(counted).over(Window.partitionBy(by, column))
    return F.when(F.col(counted) == 1, up_to - (ties - 1) / F.lit(2.0))


def rank_correlations(
    rows: DataFrame, features: list[str], controls: list[str], column: str = "residual"
) -> DataFrame:
    """Spearman correlation of the residual with every feature, raw and net of the controls.

    A row counts for a feature if residual, controls and feature are all there; every rank is taken
    among the rows that count, within a series. Features with nulls on the same rows share the ranks
    of residual and controls, so there is one sort per column and no row is repeated. Average ranks
    of n rows have mean (n + 1) / 2, so sums of products suffice: one wide aggregate, exact up to
    2^53, gives all pairs of all features, and the partial coefficient follows by eliminating the
    controls in turn. A feature without spread has null coefficients; without rows it gives none.
    """
    patterns = null_patterns(rows, features, [column, *controls])
    own = [column, *controls]
    masked = rows.select("series_id", *own, *features)
    for g, group in enumerate(patterns):
        there = F.col(group[0]).isNotNull()
        for name in own:
            there = there & F.col(name).isNotNull()
        masked = masked.withColumn(f"_m{g}", there.cast("int"))
    sets = range(len(patterns))
    for i, name in enumerate(own):
        masked = masked.withColumns({f"_o{i}_{g}": masked_rank(name, f"_m{g}") for g in sets}).drop(name)
    place = {name: g for g, group in enumerate(patterns) for name in group}
    for i, name in enumerate(features):
        masked = masked.withColumn(f"_x{i}", masked_rank(name, f"_m{place[name]}")).drop(name)

    def product(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    variables = range(len(own))
    sums = {f"n_{g}": F.sum(f"_m{g}") for g in sets}
    sums |= {f"o{i}_{j}_{g}": product(f"_o{i}_{g}", f"_o{j}_{g}") for g in sets for i in variables for j in variables if i <= j}
    for k, name in enumerate(features):
        sums |= {f"x{k}_{i}": product(f"_x{k}", f"_o{i}_{place[name]}") for i in variables}
        sums[f"x{k}"] = product(f"_x{k}", f"_x{k}")
    table = masked.groupBy("series_id").agg(*[total.alias(label) for label, total in sums.items()])

    def line(k: int, name: str) -> dict[str, Column]:
        g = place[name]
        fields = {"n": F.col(f"n_{g}"), "xx": F.col(f"x{k}")}
        fields |= {f"x{i}": F.col(f"x{k}_{i}") for i in variables}
        return fields | {f"o{i}_{j}": F.col(f"o{i}_{j}_{g}") for i in variables for j in variables if i <= j}

    return _coefficients(table, {name: line(k, name) for k, name in enumerate(features)}, len(own))


def _coefficients(table: DataFrame, lines: dict[str, dict[str, Column]], n_own: int) -> DataFrame:
    """Raw and partial coefficients of every feature from sums of products of average ranks.

    ``lines`` has for each feature its row count ``n``, its own square ``xx``, its products ``x0``...
    with the residual (0) and the controls, and the products ``o0_0``... among those. Ranks of n
    rows have mean (n + 1) / 2.
    """
    variables = range(n_own)
    pairs = [(i, j) for i in variables for j in variables if i <= j]
    cells = [
        F.struct(F.lit(name).alias("feature"), *[value.alias(label) for label, value in fields.items()])
        for name, fields in lines.items()
    ]
    table = table.select("series_id", F.explode(F.array(*cells)).alias("_")).select("series_id", "_.*").where("n > 0")

    centre = F.col("n") * ((F.col("n") + 1) / F.lit(2.0)) * ((F.col("n") + 1) / F.lit(2.0))
    spread = {"x": F.col("xx") - centre} | {f"o{i}": F.col(f"o{i}_{i}") - centre for i in variables}

    def correlation(a: str, b: str, products: Column) -> Column:
        return F.try_divide(products - centre, F.sqrt(spread[a] * spread[b]))

    current = {frozenset(("x", f"o{i}")): correlation("x", f"o{i}", F.col(f"x{i}")) for i in variables}
    for i, j in pairs:
        if i < j:
            current[frozenset((f"o{i}", f"o{j}"))] = correlation(f"o{i}", f"o{j}", F.col(f"o{i}_{j}"))
    left = ["x", *[f"o{i}" for i in variables]]
    raw = current[frozenset(("x", "o0"))]
    table = table.withColumns({"spearman_raw": raw} | {f"r_{p}": value for p, value in enumerate(current.values())})
    current = {pair: F.col(f"r_{p}") for p, pair in enumerate(current)}
    for depth, gone in enumerate(f"o{i}" for i in variables[1:]):
        left = [v for v in left if v != gone]
        held = eliminate(left, gone, current)
        table = table.withColumns({f"s{depth}_{i}": value for i, value in enumerate(held.values())})
        current = {pair: F.col(f"s{depth}_{i}") for i, pair in enumerate(held)}
    return table.select(
        "series_id", "feature", "n", "spearman_raw", current[frozenset(("x", "o0"))].alias("spearman_partial")
    )


def day_ranks(days: DataFrame, features: list[str], controls: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """``date`` with the rank columns of a day table, and the null pattern of every feature.

    Features of pattern g have ranks ``_x{k}``, the controls ``_o{i}_{g}``, among the days on which
    controls and feature are there. The table has at most the days of the calendar.
    """
    patterns = null_patterns(days, features, controls)
    place = {name: g for g, group in enumerate(patterns) for name in group}
    cells = {f"_x{k}": (name, place[name]) for k, name in enumerate(features)}
    cells |= {f"_o{i}_{g}": (name, g) for g in range(len(patterns)) for i, name in enumerate(controls, 1)}
    long = None
    for g, group in enumerate(patterns):
        there = days.dropna(subset=[group[0], *controls]).withColumn("_g", F.lit(g))
        part = melt(there, ["date", "_g"], [*group, *controls], "_name", "_value")
        long = part if long is None else long.unionByName(part)
    ranked = rank_average(long, ["_g", "_name"], "_value", "_rank")
    wide = ranked.groupBy("date").agg(
        *[F.max(F.when((F.col("_g") == g) & (F.col("_name") == name), F.col("_rank"))).alias(c) for c, (name, g) in cells.items()]
    )
    return materialise(wide, "day-ranks"), place


def rank_correlations_by_day(
    rows: DataFrame, days: DataFrame, features: list[str], controls: list[str], max_days: int, column: str = "residual"
) -> DataFrame:
    """As ``rank_correlations`` where features and controls are those of the day, for complete series.

    A complete series has a residual on every day of ``days``, so its ranks of features and controls
    are those of the day table: they are taken there once, and their products among each other with
    them. Each series adds one sort of its residuals, one broadcast join with at most ``max_days``
    rows, and the products of its ranks. A series with a day missing, twice or without a residual
    raises; ``rank_correlations`` takes such ones.
    """
    days = materialise(days.select("date", *features, *controls).coalesce(1), "days")
    ranks, place = day_ranks(days, features, controls)
    sets = sorted(set(place.values()))
    variables = range(1, len(controls) + 1)
    first = {g: f"_x{k}" for k, name in reversed(list(enumerate(features))) for g in [place[name]]}

    def product(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    sums = {"_days": F.count("*")} | {f"n_{g}": F.count(first[g]) for g in sets}
    sums |= {f"o{i}_{j}_{g}": product(f"_o{i}_{g}", f"_o{j}_{g}") for g in sets for i in variables for j in variables if i <= j}
    for k, name in enumerate(features):
        sums |= {f"x{k}_{i}": product(f"_x{k}", f"_o{i}_{place[name]}") for i in variables}
        sums[f"x{k}"] = product(f"_x{k}", f"_x{k}")
    # days that count for no feature keep a row of nulls, so that a complete series shows as such
    ranks = days.select("date").join(small_side(ranks, max_days), "date", "left")
    fixed = ranks.agg(*[total.alias(label) for label, total in sums.items()]).first().asDict()

    joined = rows.select("series_id", "date", column).join(small_side(ranks, max_days), "date")
    joined = joined.withColumns({f"_m{g}": F.col(first[g]).isNotNull().cast("int") for g in sets})
    joined = joined.withColumns({f"_o0_{g}": masked_rank(column, f"_m{g}") for g in sets})
    own = {"_days": F.count(column), "_rows": F.count("*")}
    own |= {f"o0_0_{g}": product(f"_o0_{g}", f"_o0_{g}") for g in sets}
    own |= {f"o0_{i}_{g}": product(f"_o0_{g}", f"_o{i}_{g}") for g in sets for i in variables}
    own |= {f"x{k}_0": product(f"_x{k}", f"_o0_{place[name]}") for k, name in enumerate(features)}
    table = joined.groupBy("series_id").agg(*[total.alias(label) for label, total in own.items()])
    complete = (F.col("_days") == fixed["_days"]) & (F.col("_rows") == fixed["_days"])
    table = table.withColumn(
        "series_id", F.when(complete, F.col("series_id")).otherwise(F.raise_error(F.lit("a series has not every day")))
    )

    def line(k: int, name: str) -> dict[str, Column]:
        g = place[name]
        known = {"n": f"n_{g}", "xx": f"x{k}"} | {f"x{i}": f"x{k}_{i}" for i in variables}
        known |= {f"o{i}_{j}": f"o{i}_{j}_{g}" for i in variables for j in variables if i <= j}
        fields = {label: F.lit(fixed[source]) for label, source in known.items()}
        return fields | {"x0": F.col(f"x{k}_0")} | {f"o0_{i}": F.col(f"o0_{i}_{g}") for i in [0, *variables]}

    return _coefficients(table, {name: line(k, name) for k, name in enumerate(features)}, len(controls) + 1)


def partial_spearman(
    rows: DataFrame, features: list[str], controls: list[str], column: str = "residual", q: float = FDR_Q
) -> DataFrame:
    """The coefficients with p-values and the false-discovery decision within each series."""
    return correlation_tests(rank_correlations(rows, features, controls, column), len(controls), q)


def correlation_tests(table: DataFrame, n_controls: int, q: float = FDR_Q) -> DataFrame:
    """P-values of both coefficients and the false-discovery decision within each series."""
    dof = F.col("n").cast("double") - 2.0
    tested = table.withColumns(
        {
            "p_raw": correlation_p(F.col("spearman_raw"), dof),
            "p_partial": correlation_p(F.col("spearman_partial"), dof - float(n_controls)),
        }
    ).withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("p_raw", "p_partial")})
    return bh_adjust(tested, ["series_id"], "p_partial", "feature", q)
