"""Fixed values the results depend on: levels, lags, windows, thresholds and labels."""

# Calendar levels, one encoded column each.
DAY_TYPES = ["laborable", "sabado", "domingo", "festivo", "domingo festivo"]
HOLIDAY_TYPES = [
    "none",
    "Festivo nacional",
    "Festivo de la Comunidad de Madrid",
    "Festivo local de la ciudad de Madrid",
]
NO_HOLIDAY = "none"
WORKING_DAY = "laborable"
HOLIDAY_DAY_TYPES = ["festivo", "domingo festivo"]
WEEKEND_DAY_TYPES = ["sabado", "domingo", "domingo festivo"]
WEEKDAYS_ES = ["lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"]

# The feature vocabulary.
PREFIX = "feat_"
TARGET_LAGS = [1, 2, 3, 7, 14, 21, 28]
EXOG_LAGS = [1, 2, 3, 7]
EXOG_WINDOW = 7
ROLLING_WINDOWS = [7, 28]
FOURIER_EPOCH = "2023-01-01"
FOURIER_TERMS = [("weekly", 7.0, 1), ("annual", 365.25, 1), ("annual", 365.25, 2)]
FEATURE_GROUPS = [
    "fourier_weekly",
    "fourier_annual",
    "calendar",
    "lag_total",
    "rolling",
    "lag_operator",
    "weather",
]

# Splits and folds.
TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.15
FLOOR_EPSILON = 1e-9
WARMUP_DAYS = 28
N_FOLDS = 5
MIN_INITIAL_TRAIN = 200
DEGENERATE_FOLD = 1
HOLDOUT_FRACTION = 0.15
SEQUENCE_WINDOW = 28
SEED = 42

# Subgroup names, in report order, and the two left out of inference.
SUBGROUPS = [
    "laborable_ordinario",
    "laborable_puente",
    "sabado",
    "domingo",
    "festivo",
    "fin_de_semana",
    "entre_semana",
    "calendario_irregular",
    "calendario_ordinario",
    "verano_jul_ago",
    "resto_del_anio",
    "periodo_navidad",
    "periodo_semana_santa",
    "demanda_anomala",
    "demanda_regular",
]
EXCLUDED_SUBGROUPS = ["periodo_navidad", "periodo_semana_santa"]
MAD_TO_SIGMA = 1.4826
ANOMALY_LAG = 7
ANOMALY_K = 3.0
SMALL_SAMPLE = 10
MIN_N_INFERENTIAL = 20

# Resampling and multiple testing.
BLOCK_DAYS = 7
N_BOOTSTRAP = 2000
USABLE_MIN = 0.90
FDR_Q = 0.10
ROLLING_MAE_WINDOW = 28

# Residual-structure thresholds and verdict labels.
MAX_LAG = 35
NORMAL_975 = 1.959963984540054
LJUNG_BOX_LAGS = [7, 14, 28]
ACF_STRUCTURE_MIN = 0.20
ACF_WHITE_MAX = 0.10
BAND_EXCEEDANCE_WHITE_MAX = 2
SPECTRAL_PEAK_RATIO_MIN = 3.0
WEEKDAY_SPREAD_STRUCTURE_MIN = 0.30
WEEKDAY_SPREAD_WHITE_MAX = 0.10
CALENDAR_RATIO_STRUCTURE_MIN = 2.0
CALENDAR_RATIO_WHITE_MAX = 1.3
EXOG_PARTIAL_RHO_MIN = 0.15
EXOG_MIN_SIGNIFICANT = 5
# Formats of the figures beside each verdict.
MEMORY_STATISTIC = "max |ACF| lags 1-%d = %.3f (lag %d, %s de banda); %d/%d lags fuera de banda"
WEEK_STATISTIC = "ACF(7) = %.3f; pico espectral periodo-7 = %.1fx cuota media; dispersion de medias por dia = %.2f sigma"
CALENDAR_STATISTIC = "|residuo| festivo / laborable-ordinario = %.2fx"
EXOG_STATISTIC = "%d variables con |rho parcial| >= %.2f y significativas tras BH (q=%.1f)"
VERDICT_STRUCTURE = "estructura persiste"
VERDICT_WHITE = "ruido cuasi-blanco"
VERDICT_AMBIGUOUS = "estructura debil/ambigua"

# Subgroup verdict labels.
VERDICT_WIN = "gana con evidencia"
VERDICT_RANK_ONLY = "primero sin evidencia"
VERDICT_NO_WIN = "no gana"
VERDICT_NON_INFER = "no inferencial (n insuficiente)"
VERDICT_EXCLUDED = "no analizable (sin solape val-test)"

# Learning curve and parity control.
CURVE_FRACTIONS = [0.25, 0.40, 0.55, 0.70, 0.85, 1.00]
CURVE_SEEDS = [42, 1, 2]
WHOLE_SEEDS = [3, 4]
PARITY_SEEDS = [42, 1, 2, 3, 4]

# Block ablation and parity control.
ABLATION_SUBSETS = {
    "completo": FEATURE_GROUPS,
    "solo_temporal": ["lag_total", "lag_operator", "rolling"],
    "solo_exogeno": ["calendar", "fourier_weekly", "fourier_annual", "weather"],
    "sin_meteo": [g for g in FEATURE_GROUPS if g != "weather"],
    "solo_calendario": ["calendar", "fourier_weekly", "fourier_annual"],
}
ABLATION_REPORTED_ONLY = ["sin_meteo", "solo_calendario"]
BLOCK_MATERIAL_PCT = 5.0
VERDICT_MATERIAL = "aporta (>= umbral)"
VERDICT_IMMATERIAL = "no aporta (< umbral)"
VERDICT_REPORTED = "solo informativo"
VERDICT_REFERENCE = "referencia"
PARITY_HIGH_PCT = 60.0
PARITY_LOW_PCT = 25.0
VERDICT_CAPACITY = "fallo de capacidad/muestra"
VERDICT_ASYMMETRY = "asimetria informativa"
VERDICT_ARCHITECTURE = "limitacion arquitectonica"
VERDICT_PARITY_AMBIGUOUS = "mixto/ambiguo"
DEGENERATE_MIN = 0.5
IRREGULAR_WEIGHT = 3.0
MAX_OVERALL_DEGRADATION = 0.05

# Regression check between two runs.
VERIFY_RTOL = 1e-6
DRIFT_CEILING = 1e-3
REL_FLOOR = 1e-12

# Integrality of counts.
INTEGER_TOLERANCE = 1e-6

# The tuning grid of the boosted trees and the order grid of the regression.
TREE_GRID = {
    "maxDepth": [3, 4, 5],
    "maxIter": [100, 300],
    "stepSize": [0.01, 0.05, 0.1],
    "minInstancesPerNode": [3, 5, 10],
}
AR_ORDERS = [0, 1, 2]
DIFFERENCES = [0, 1]
SEASON = 7
ARX_REGRESSORS = [
    "feat_is_weekend",
    "feat_is_bridge_day",
    "feat_holiday_type_festivo_nacional",
    "feat_holiday_type_festivo_de_la_comunidad_de_madrid",
    "feat_holiday_type_festivo_local_de_la_ciudad_de_madrid",
]
