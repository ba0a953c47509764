"""Column names and groups of the daily-delay data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These names must equal the source data's and the original
# project's so results line up. Kept as plain text, in their natural order.
# ---------------------------------------------------------------------------
CAUSE_COLS = ["DLY_APT_ARR_A_1", "DLY_APT_ARR_C_1", "DLY_APT_ARR_D_1", "DLY_APT_ARR_E_1",
              "DLY_APT_ARR_G_1", "DLY_APT_ARR_I_1", "DLY_APT_ARR_M_1", "DLY_APT_ARR_N_1",
              "DLY_APT_ARR_O_1", "DLY_APT_ARR_P_1", "DLY_APT_ARR_R_1", "DLY_APT_ARR_S_1",
              "DLY_APT_ARR_T_1", "DLY_APT_ARR_V_1", "DLY_APT_ARR_W_1", "DLY_APT_ARR_NA_1"]
TOTAL_COL = "DLY_APT_ARR_1"            # all-cause delay minutes, optional
BASE_NUM_COLS = ["YEAR", "MONTH_NUM", "FLT_ARR_1", "FLT_ARR_1_DLY",
                 "FLT_ARR_1_DLY_15"]
TRAFFIC_COLS = ["ARR_TOTAL_FLIGHTS", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"]
CALENDAR_FEATURES = ["YEAR", "MONTH", "DOW", "DOM", "WOY"]
CANDIDATE_FEATURES = TRAFFIC_COLS + CAUSE_COLS + [TOTAL_COL] + CALENDAR_FEATURES
LABEL = "AVG_ARR_DELAY_MIN"
SEVERITY_EXTREME, SEVERITY_HIGH, SEVERITY_MODERATE = "EXTREME", "HIGH", "MODERATE"
ANOMALY_TOP_AVG, ANOMALY_TOP_TOTAL, ANOMALY_P95 = (
    "TOP_AVG_DELAY", "TOP_TOTAL_DELAY", "P95_OUTLIER")
SPLIT_RANDOM = "RANDOM_SPLIT_80_20"
SPLIT_TIME_PREFIX = "TIME_SPLIT_TEST_YEAR_"
METRIC_NAMES = ["RMSE", "R2", "SPLIT_MODE"]
# Forest settings of the original model.
RF_NUM_TREES, RF_MAX_DEPTH, RF_SEED = 200, 8, 42
# Split fallback: random split when the last year has fewer test days or the
# earlier years fewer training days than these.
MIN_TEST_DAYS, MIN_TRAIN_DAYS = 30, 100
TOP_N_DAYS = 30
ENTITY = "AIRPORT"
# Silver contract order (absent columns are skipped).
SILVER_ORDER = ["AIRPORT", "DATE", "YEAR", "MONTH", "DOW",
                "ARR_TOTAL_FLIGHTS", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15",
                "TOTAL_DELAY_MIN", "AVG_ARR_DELAY_MIN"] + CAUSE_COLS + [TOTAL_COL]
# Output contracts: the columns after the entity, by name and type.
PREDICTIONS = "DATE date, YEAR int, MONTH int, AVG_ARR_DELAY_MIN double, prediction double"
VALIDATION_DAILY = PREDICTIONS + ", error_min double, abs_error_min double"
FORECAST_DAILY = "DATE date, YEAR int, MONTH int, DOW int, pred_avg_arr_delay_min double"
REPORT_DAILY = "date date, year int, month int, avg_arr_delay_min double"
REPORT_CAUSES = "cause string, minutes double, share double"
REPORT_ANOMALIES = REPORT_DAILY + ", anomaly_type string, severity string"
REPORT_VALIDATION = ("year int, month int, days_count int, real_avg_delay_mean double, "
                     "pred_avg_delay_mean double, mae_mean double, rmse double")
REPORT_IMPORTANCE = "feature string, importance double, importance_pct double"
METRICS = "metric string, value double, info string"
# ---------------------------------------------------------------------------

# Causes reported in the cause table: every cause except NA (which still
# counts in the row total). The grand total column is not a cause.
REPORTED_CAUSES = [c for c in CAUSE_COLS if c != "DLY_APT_ARR_NA_1"]


def present(cols, available) -> list[str]:
    """Members of ``cols`` that exist in ``available``, in ``cols`` order."""
    have = set(available)
    return [c for c in cols if c in have]


def conform(df, contract: str, keys=(), **sources):
    """``keys`` as they are, then the contract's columns, each cast to
    its type. ``sources`` names the column a contract column is read from
    where that differs; names are matched without regard to case."""
    fields = T.StructType.fromDDL(contract).fields
    return df.select(*keys, *[df[sources.get(f.name, f.name)].cast(f.dataType).alias(f.name) for f in fields])


def require(df, cols, what: str = "input") -> None:
    """Fail at plan time when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
