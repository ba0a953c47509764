"""DuckDB SQL oracles for the registered queries.

the table binding in FIXTURES.md. Shared steps are common table expressions;
each oracle is ``WITH <the steps it needs> SELECT ...``. Means and other
order-dependent floating-point results are rounded to 6 digits, as in the
registered Spark queries.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The fixture binding's columns and parameters (FIXTURES.md).
# The cause columns present in the binding (the rest are absent):
CAUSES = ["DLY_APT_ARR_A_1", "DLY_APT_ARR_C_1", "DLY_APT_ARR_D_1",
          "DLY_APT_ARR_E_1", "DLY_APT_ARR_G_1", "DLY_APT_ARR_NA_1"]
REPORTED = [c for c in CAUSES if c != "DLY_APT_ARR_NA_1"]
TOTAL = "DLY_APT_ARR_1"
TRAFFIC = ["ARR_TOTAL_FLIGHTS", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"]
NONCAL = TRAFFIC + CAUSES + [TOTAL]
CAL = ["YEAR", "MONTH", "DOW", "DOM", "WOY"]
FEATURES = NONCAL + CAL
ENTITY = "BUILDING"
HIST = (1998, 2001)
TARGET = 2026
PAIRS = [("A", "F", "DLY_APT_ARR_A_1"), ("A", "O", "DLY_APT_ARR_C_1"),
         ("N", "F", "DLY_APT_ARR_D_1"), ("N", "O", "DLY_APT_ARR_E_1"),
         ("R", "F", "DLY_APT_ARR_G_1"), ("R", "O", "DLY_APT_ARR_NA_1")]
# ---------------------------------------------------------------------------

_j = ",\n  ".join
TIES = ["YEAR", "MONTH", "DOW", "ARR_TOTAL_FLIGHTS", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15", "TOTAL_DELAY_MIN",
        "AVG_ARR_DELAY_MIN", *CAUSES, TOTAL]


def _cause_sum(prefix: str = "") -> str:
    return " + ".join(f"coalesce({prefix}{c}, 0.0)" for c in CAUSES)


STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, deps: list[str], sql: str) -> None:
    STEPS[name] = (deps, sql)


step("bronze", [], f"""
SELECT '-' || lower(c.c_mktsegment) || ' ' AS APT_ICAO,
  strftime(o.d, '%Y-%m-%d') || CASE WHEN day(o.d) % 2 = 1 THEN 'T00:00:00.000Z' ELSE 'T00:00:00Z' END AS FLT_DATE,
  CAST(count(DISTINCT o.o_orderkey) AS VARCHAR) AS FLT_ARR_1,
  CAST(count(DISTINCT CASE WHEN l.l_quantity > 25 THEN o.o_orderkey END) AS VARCHAR) AS FLT_ARR_1_DLY,
  CAST(count(DISTINCT CASE WHEN l.l_quantity > 45 THEN o.o_orderkey END) AS VARCHAR) AS FLT_ARR_1_DLY_15,
  {_j(f"CAST(CAST(sum(CASE WHEN l.l_returnflag = '{rf}' AND l.l_linestatus = '{ls}' THEN l.l_quantity END) AS BIGINT) AS VARCHAR) AS {c}" for rf, ls, c in PAIRS)},
  CASE WHEN day(o.d) % 2 = 1 THEN CAST(CAST(sum(l.l_quantity) AS BIGINT) AS VARCHAR) END AS {TOTAL}
FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) o
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_mktsegment, o.d""")

# The supplier binding with its dirt (FIXTURES.md part 3); an empty CSV cell
# reads back as null.
BRONZE_SUPPLIERS = f"""
SELECT ' sup-' || s || ' ' AS APT_ICAO,
  CASE WHEN dirt = 3 THEN 'bad' WHEN dirt = 4 THEN NULL
       WHEN s % 10 = 3 AND year(d) BETWEEN 1998 AND 2001 THEN 'unknown'
       ELSE strftime(d, '%Y-%m-%d') || CASE WHEN day(d) % 2 = 1 THEN 'T00:00:00.000Z' ELSE 'T00:00:00Z' END END AS FLT_DATE,
  CASE WHEN dirt = 0 THEN 'n/a' WHEN dirt = 1 THEN NULL WHEN dirt = 2 THEN '0' ELSE CAST(n AS VARCHAR) END AS FLT_ARR_1,
  CAST(n_dly AS VARCHAR) AS FLT_ARR_1_DLY, CAST(n_dly15 AS VARCHAR) AS FLT_ARR_1_DLY_15,
  CAST(CAST({CAUSES[0]} + more AS BIGINT) AS VARCHAR) AS {CAUSES[0]},
  {_j(f"CAST(CAST({c} AS BIGINT) AS VARCHAR) AS {c}" for c in CAUSES[1:])},
  CASE WHEN day(d) % 2 = 1 THEN CAST(CAST(q_all + more AS BIGINT) AS VARCHAR) END AS {TOTAL}
FROM (SELECT *, unnest(CASE WHEN dirt = 5 THEN [0, 7] ELSE [0] END) AS more
  FROM (SELECT *, (s * 31 + date_diff('day', DATE '1970-01-01', d)) % 97 AS dirt
    FROM (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, count(*) AS n,
            count(*) FILTER (WHERE l_quantity > 25) AS n_dly, count(*) FILTER (WHERE l_quantity > 45) AS n_dly15,
            {_j(f"sum(CASE WHEN l_returnflag = '{rf}' AND l_linestatus = '{ls}' THEN l_quantity END) AS {c}" for rf, ls, c in PAIRS)},
            sum(l_quantity) AS q_all
          FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))))"""

step("typed", ["bronze"], f"""
SELECT regexp_replace(upper(APT_ICAO), '[^A-Z0-9]', '', 'g') AS AIRPORT, FLT_DATE,
  {_j(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ["FLT_ARR_1", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"] + CAUSES + [TOTAL])},
  coalesce(try_strptime(FLT_DATE, '%Y-%m-%dT%H:%M:%SZ'),
           try_strptime(FLT_DATE, '%Y-%m-%dT%H:%M:%S.%gZ')) AS DATE_TS
FROM bronze""")

step("typed2", ["typed"], f"""
SELECT *, {_cause_sum()} AS cause_sum, coalesce({TOTAL}, {_cause_sum()}) AS TOTAL_DELAY_MIN
FROM typed""")

step("silver", ["typed2"], f"""
SELECT AIRPORT, CAST(DATE_TS AS DATE) AS DATE, CAST(year(DATE_TS) AS INTEGER) AS YEAR,
  CAST(month(DATE_TS) AS INTEGER) AS MONTH, CAST(isodow(DATE_TS) AS INTEGER) AS DOW,
  FLT_ARR_1 AS ARR_TOTAL_FLIGHTS, FLT_ARR_1_DLY, FLT_ARR_1_DLY_15, TOTAL_DELAY_MIN,
  CASE WHEN FLT_ARR_1 > 0 AND TOTAL_DELAY_MIN IS NOT NULL THEN TOTAL_DELAY_MIN / FLT_ARR_1 END AS AVG_ARR_DELAY_MIN,
  {_j(CAUSES)}, {TOTAL}
FROM typed2 WHERE AIRPORT IS NOT NULL AND AIRPORT <> ''""")

step("th", ["silver"], """
SELECT AIRPORT, quantile_disc(AVG_ARR_DELAY_MIN, 0.95) AS p95,
  quantile_disc(AVG_ARR_DELAY_MIN, 0.99) AS p99
FROM silver GROUP BY AIRPORT""")

for _name, _measure in [("top_avg", "AVG_ARR_DELAY_MIN"), ("top_total", "TOTAL_DELAY_MIN")]:
    step(_name, ["silver"], f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY AIRPORT
    ORDER BY {_measure} DESC NULLS LAST, DATE NULLS LAST, {", ".join(c + " NULLS LAST" for c in TIES)}) AS rn
  FROM silver)
WHERE rn <= 30""")

step("outliers", ["silver", "th"], """
SELECT s.* FROM silver s JOIN th t ON s.AIRPORT = t.AIRPORT
WHERE s.AVG_ARR_DELAY_MIN >= t.p95""")

step("anoms", ["top_avg", "top_total", "outliers", "th"], """
SELECT u.*, CASE WHEN u.AVG_ARR_DELAY_MIN >= t.p99 THEN 'EXTREME'
                 WHEN u.AVG_ARR_DELAY_MIN >= t.p95 THEN 'HIGH' ELSE 'MODERATE' END AS severity
FROM (SELECT *, 'TOP_AVG_DELAY' AS anomaly_type FROM top_avg
      UNION ALL SELECT *, 'TOP_TOTAL_DELAY' FROM top_total
      UNION ALL SELECT *, 'P95_OUTLIER' FROM outliers) u
LEFT JOIN th t ON u.AIRPORT = t.AIRPORT""")

step("arows", ["anoms"], """
SELECT AIRPORT AS airport, DATE AS date, YEAR AS year, MONTH AS month,
  AVG_ARR_DELAY_MIN AS avg_arr_delay_min, anomaly_type, severity FROM anoms""")

_FEAT_SELECT = _j(
    [f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NONCAL]
    + ["CAST(YEAR AS DOUBLE) AS YEAR", "CAST(MONTH AS DOUBLE) AS MONTH",
       "CAST(dayofweek(DATE) + 1 AS DOUBLE) AS DOW", "CAST(dayofmonth(DATE) AS DOUBLE) AS DOM",
       "CAST(weekofyear(DATE) AS DOUBLE) AS WOY",
       "CAST(AVG_ARR_DELAY_MIN AS DOUBLE) AS AVG_ARR_DELAY_MIN"])
step("feat", ["silver"], f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY AIRPORT, DATE ORDER BY
    {", ".join(c + " ASC NULLS FIRST" for c in FEATURES + ["AVG_ARR_DELAY_MIN"])}) AS rn
  FROM (SELECT AIRPORT, DATE, {_FEAT_SELECT} FROM silver
        WHERE DATE IS NOT NULL AND AVG_ARR_DELAY_MIN IS NOT NULL))
WHERE rn = 1""")

step("plan", ["feat"], """
SELECT AIRPORT,
  CASE WHEN n_years >= 2 AND n_last >= 30 AND n_all - n_last >= 100
       THEN 'TIME_SPLIT_TEST_YEAR_' || CAST(CAST(last_year AS INTEGER) AS VARCHAR)
       ELSE 'RANDOM_SPLIT_80_20' END AS split_mode,
  CASE WHEN n_years >= 2 AND n_last >= 30 AND n_all - n_last >= 100
       THEN CAST(last_year AS INTEGER) END AS test_year
FROM (SELECT AIRPORT, count(*) AS n_years, max(YEAR) AS last_year,
             arg_max(n, YEAR) AS n_last, sum(n) AS n_all
      FROM (SELECT AIRPORT, YEAR, count(*) AS n FROM feat GROUP BY AIRPORT, YEAR)
      GROUP BY AIRPORT)""")

step("split", ["feat", "plan"], """
SELECT f.*, p.split_mode,
  CASE WHEN p.test_year IS NOT NULL THEN f.YEAR = p.test_year
       ELSE ((date_diff('day', DATE '1970-01-01', f.DATE) * 2654435761) % 4294967296) % 100 >= 80
  END AS is_test
FROM feat f JOIN plan p ON f.AIRPORT = p.AIRPORT""")

step("cells", ["split"], """
SELECT AIRPORT, CAST(MONTH AS INTEGER) AS m, CAST(DOW AS INTEGER) AS d,
  avg(AVG_ARR_DELAY_MIN) AS cell
FROM split WHERE NOT is_test GROUP BY AIRPORT, CAST(MONTH AS INTEGER), CAST(DOW AS INTEGER)""")

step("means", ["split"], """
SELECT AIRPORT, avg(AVG_ARR_DELAY_MIN) AS mean FROM split WHERE NOT is_test GROUP BY AIRPORT""")

step("stubp", ["split", "cells", "means"], """
SELECT s.AIRPORT, s.DATE, CAST(s.YEAR AS INTEGER) AS YEAR, CAST(s.MONTH AS INTEGER) AS MONTH,
  s.AVG_ARR_DELAY_MIN, coalesce(c.cell, m.mean) AS prediction, s.is_test
FROM split s
LEFT JOIN cells c ON c.AIRPORT = s.AIRPORT AND c.m = CAST(s.MONTH AS INTEGER) AND c.d = CAST(s.DOW AS INTEGER)
LEFT JOIN means m ON m.AIRPORT = s.AIRPORT""")

step("vd", ["silver", "stubp"], """
SELECT s.AIRPORT, s.DATE, s.YEAR, s.MONTH, s.AVG_ARR_DELAY_MIN, p.prediction,
  p.prediction - s.AVG_ARR_DELAY_MIN AS error_min,
  abs(p.prediction - s.AVG_ARR_DELAY_MIN) AS abs_error_min
FROM (SELECT *, row_number() OVER (PARTITION BY AIRPORT, DATE ORDER BY AVG_ARR_DELAY_MIN NULLS FIRST) AS rn
      FROM silver) s
JOIN stubp p ON s.AIRPORT = p.AIRPORT AND s.DATE = p.DATE WHERE s.rn = 1""")

step("vm", ["vd"], """
SELECT AIRPORT, YEAR, MONTH, count(*) AS days_count,
  round(avg(AVG_ARR_DELAY_MIN), 6) AS real_avg_delay_mean,
  round(avg(prediction), 6) AS pred_avg_delay_mean,
  round(avg(abs_error_min), 6) AS mae_mean,
  round(sqrt(avg(power(error_min, 2))), 6) AS rmse
FROM vd GROUP BY AIRPORT, YEAR, MONTH""")

step("hist", ["silver"], f"""
SELECT AIRPORT, CAST(month(DATE) AS INTEGER) AS MONTH, CAST(dayofweek(DATE) + 1 AS INTEGER) AS DOW,
  {_j(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NONCAL)}
FROM silver WHERE YEAR BETWEEN {HIST[0]} AND {HIST[1]} AND DATE IS NOT NULL""")

step("base", ["hist"], f"""
SELECT AIRPORT, MONTH, DOW, {_j(f"avg({c}) AS {c}" for c in NONCAL)}
FROM hist GROUP BY AIRPORT, MONTH, DOW""")

# Every entity of Silver, with 0 where it has no history.
step("gm", ["silver", "hist"], f"""
SELECT e.AIRPORT, {_j(f"coalesce(avg(h.{c}), 0.0) AS {c}" for c in NONCAL)}
FROM (SELECT DISTINCT AIRPORT FROM silver) e LEFT JOIN hist h ON h.AIRPORT = e.AIRPORT
GROUP BY e.AIRPORT""")

step("fut", ["silver", "base", "gm"], f"""
SELECT c.AIRPORT, c.DATE,
  {_j(f"coalesce(b.{x}, g.{x}, 0.0) AS {x}" for x in NONCAL)},
  CAST(year(c.DATE) AS INTEGER) AS YEAR, CAST(month(c.DATE) AS INTEGER) AS MONTH,
  CAST(dayofweek(c.DATE) + 1 AS INTEGER) AS DOW, CAST(dayofmonth(c.DATE) AS INTEGER) AS DOM,
  CAST(weekofyear(c.DATE) AS INTEGER) AS WOY
FROM (SELECT e.AIRPORT, CAST(g.d AS DATE) AS DATE
      FROM (SELECT DISTINCT AIRPORT FROM silver) e,
           unnest(generate_series(TIMESTAMP '{TARGET}-01-01', TIMESTAMP '{TARGET}-12-31', INTERVAL 1 DAY)) AS g(d)) c
LEFT JOIN base b ON b.AIRPORT = c.AIRPORT AND b.MONTH = CAST(month(c.DATE) AS INTEGER)
  AND b.DOW = CAST(dayofweek(c.DATE) + 1 AS INTEGER)
LEFT JOIN gm g ON g.AIRPORT = c.AIRPORT""")

step("fcs", ["fut", "cells", "means"], """
SELECT f.AIRPORT, f.DATE, f.YEAR, f.MONTH, f.DOW,
  coalesce(c.cell, m.mean) AS pred_avg_arr_delay_min
FROM fut f LEFT JOIN cells c ON c.AIRPORT = f.AIRPORT AND c.m = f.MONTH AND c.d = f.DOW
LEFT JOIN means m ON m.AIRPORT = f.AIRPORT""")

step("basic", ["silver"], """
SELECT AIRPORT AS airport, DATE AS date, YEAR AS year, MONTH AS month,
  AVG_ARR_DELAY_MIN AS avg_arr_delay_min
FROM silver WHERE DATE IS NOT NULL AND YEAR IS NOT NULL AND MONTH IS NOT NULL""")

step("mdelay", ["basic"], """
SELECT airport, year, month, round(avg(avg_arr_delay_min), 6) AS monthly_avg_delay_min
FROM basic GROUP BY airport, year, month""")


def _causes_long(cols: list[str]) -> str:
    return f"""
SELECT airport, cause, minutes,
  CASE WHEN sum(minutes) OVER (PARTITION BY airport) > 0
       THEN minutes / sum(minutes) OVER (PARTITION BY airport) ELSE 0.0 END AS share
FROM (SELECT airport, cause, coalesce(CAST(minutes AS DOUBLE), 0.0) AS minutes
      FROM (SELECT AIRPORT AS airport, {_j(f"sum({c}) AS {c}" for c in cols)}
            FROM silver GROUP BY AIRPORT)
      UNPIVOT INCLUDE NULLS (minutes FOR cause IN ({", ".join(cols)})))"""


step("causes", ["silver"], _causes_long(REPORTED))

step("crank", ["causes"], """
SELECT airport, cause, sum(minutes) AS total_minutes, round(avg(share), 6) AS avg_share
FROM causes WHERE cause IS NOT NULL GROUP BY airport, cause""")


def _profile(keys: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"""
SELECT {k}count(*) AS days_count, sum(ARR_TOTAL_FLIGHTS) AS arrivals_sum,
  round(avg(ARR_TOTAL_FLIGHTS), 6) AS arrivals_avg_per_day, sum(TOTAL_DELAY_MIN) AS delay_min_sum,
  round(avg(AVG_ARR_DELAY_MIN), 6) AS avg_delay_min_mean,
  quantile_disc(AVG_ARR_DELAY_MIN, 0.5) AS avg_delay_min_median,
  max(AVG_ARR_DELAY_MIN) AS avg_delay_min_max, AIRPORT AS airport
FROM silver GROUP BY AIRPORT{"".join(", " + c for c in keys)}"""


SILVER_COLS = ("AIRPORT, DATE, YEAR, MONTH, DOW, ARR_TOTAL_FLIGHTS, FLT_ARR_1_DLY, "
               "FLT_ARR_1_DLY_15, TOTAL_DELAY_MIN, AVG_ARR_DELAY_MIN, "
               + ", ".join(CAUSES) + ", " + TOTAL)

FINAL: dict[str, tuple[list[str], str]] = {
    "csv_bronze_scan": (["bronze"], "SELECT * FROM bronze"),
    "silver_partition_roundtrip": (["silver"], "SELECT * FROM silver"),
    "silver_daily": (["silver"], "SELECT * FROM silver"),
    "streaming_silver_ingest": (["silver"], "SELECT * FROM silver"),
    "dedup_daily_copies": (["silver"], f"""
SELECT {SILVER_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY AIRPORT, DATE ORDER BY YEAR, MONTH, DOW,
    ARR_TOTAL_FLIGHTS, FLT_ARR_1_DLY, FLT_ARR_1_DLY_15, TOTAL_DELAY_MIN, AVG_ARR_DELAY_MIN,
    {", ".join(CAUSES)}, {TOTAL}) AS rn
  FROM (SELECT * FROM silver UNION ALL SELECT * FROM silver)) WHERE rn = 1"""),
    "entity_filter_building": (["silver"], f"SELECT * FROM silver WHERE AIRPORT = '{ENTITY}'"),
    "year_range_filter": (["silver"], f"SELECT * FROM silver WHERE YEAR BETWEEN {HIST[0]} AND {HIST[1]}"),
    "gold_roundtrip": (["silver"], _profile(["YEAR", "MONTH"])),
    "eda_overall": (["silver"], _profile([])),
    "eda_yearly": (["silver"], _profile(["YEAR"])),
    "eda_monthly": (["silver"], _profile(["YEAR", "MONTH"])),
    "snapshot_previous": (["silver"], _profile(["YEAR", "MONTH"])),
    "eda_yearly_from_cells": (["silver"], f"SELECT * EXCLUDE (avg_delay_min_median) FROM ({_profile(['YEAR'])})"),
    "sketch_quantiles_rank": (["silver"], """
SELECT AIRPORT, count(*) AS n_values, true AS p50_near, true AS p95_near, true AS p99_near
FROM silver WHERE AVG_ARR_DELAY_MIN IS NOT NULL GROUP BY AIRPORT"""),
    "days_per_year_merged": (["silver"], """
SELECT AIRPORT, YEAR, count(*) FILTER (MONTH <= 8) + count(*) FILTER (MONTH >= 5) AS rows, count(DISTINCT DATE) AS unique_days
FROM silver WHERE YEAR IS NOT NULL GROUP BY AIRPORT, YEAR"""),
    "data_range_merged": (["silver"], """
SELECT AIRPORT, min(DATE) AS min_date, max(DATE) AS max_date,
  count(*) FILTER (MONTH <= 8) + count(*) FILTER (MONTH >= 5) AS days_count,
  count(DISTINCT DATE) AS unique_days, count(DISTINCT YEAR) AS years_count
FROM silver WHERE YEAR IS NOT NULL GROUP BY AIRPORT"""),
    "silver_upsert": (["silver"], """
SELECT * REPLACE (
  CASE WHEN day(DATE) % 7 = 0 THEN ARR_TOTAL_FLIGHTS * 10 ELSE ARR_TOTAL_FLIGHTS END AS ARR_TOTAL_FLIGHTS,
  CASE WHEN day(DATE) % 7 <> 0 THEN AVG_ARR_DELAY_MIN
       WHEN ARR_TOTAL_FLIGHTS * 10 > 0 AND TOTAL_DELAY_MIN IS NOT NULL THEN TOTAL_DELAY_MIN / (ARR_TOTAL_FLIGHTS * 10)
  END AS AVG_ARR_DELAY_MIN)
FROM silver"""),
    "bronze_quarantine": (["bronze"], "SELECT * FROM bronze WHERE coalesce(substr(FLT_DATE, 9, 2) <> '13', true)"),
    "bronze_rejects": (["bronze"], f"""
SELECT CASE WHEN CAST(substr(FLT_DATE, 6, 2) AS INTEGER) % 2 = 1
            THEN coalesce(APT_ICAO, '') || ',' || coalesce(FLT_DATE, '') || ',' || coalesce(FLT_ARR_1, '')
            ELSE {" || ',' || ".join(f"coalesce({c}, '')" for c in ["APT_ICAO", "FLT_DATE", "FLT_ARR_1", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15", *CAUSES, TOTAL])} || ',x'
       END AS line, true AS from_torn
FROM bronze WHERE substr(FLT_DATE, 9, 2) = '13'"""),
    "eda_weekday": (["silver"], """
SELECT DOW, count(*) AS days_count, round(avg(ARR_TOTAL_FLIGHTS), 6) AS arrivals_avg_per_day,
  round(avg(AVG_ARR_DELAY_MIN), 6) AS avg_delay_min_mean,
  quantile_disc(AVG_ARR_DELAY_MIN, 0.5) AS avg_delay_min_median, AIRPORT AS airport
FROM silver GROUP BY AIRPORT, DOW"""),
    "days_per_year_quality": (["silver"], """
SELECT AIRPORT, YEAR, count(*) AS rows, count(DISTINCT DATE) AS unique_days
FROM silver GROUP BY AIRPORT, YEAR"""),
    "data_range": (["silver"], """
SELECT AIRPORT, min(DATE) AS min_date, max(DATE) AS max_date, count(*) AS days_count,
  count(DISTINCT YEAR) AS years_count
FROM silver WHERE DATE IS NOT NULL AND YEAR IS NOT NULL AND MONTH IS NOT NULL GROUP BY AIRPORT"""),
    "distinct_years": (["silver"], """
SELECT y.AIRPORT, y.YEAR, y.days_count, y.YEAR = l.last AS is_last_year
FROM (SELECT AIRPORT, YEAR, count(*) AS days_count FROM silver WHERE YEAR IS NOT NULL
      GROUP BY AIRPORT, YEAR) y
JOIN (SELECT AIRPORT, max(YEAR) AS last FROM silver WHERE YEAR IS NOT NULL GROUP BY AIRPORT) l
  ON y.AIRPORT = l.AIRPORT"""),
    "causes_wide": (["silver"], f"""
SELECT {_j(f"sum({c}) AS {c}" for c in REPORTED)}, AIRPORT AS airport
FROM silver GROUP BY AIRPORT"""),
    "causes_long": (["causes"], "SELECT * FROM causes"),
    "causes_long_compat": (["silver"], _causes_long(REPORTED + [TOTAL])),
    "anomaly_thresholds": (["th"], "SELECT * FROM th"),
    "top_avg_delay": (["top_avg"], "SELECT * FROM top_avg"),
    "top_total_delay": (["top_total"], "SELECT * FROM top_total"),
    "p95_outliers": (["outliers"], "SELECT * FROM outliers"),
    "anomalies": (["anoms"], "SELECT * FROM anoms"),
    "anomaly_severity": (["silver", "th"], """
SELECT s.AIRPORT, s.DATE, s.AVG_ARR_DELAY_MIN, t.p95, t.p99,
  CASE WHEN s.AVG_ARR_DELAY_MIN >= t.p99 THEN 'EXTREME'
       WHEN s.AVG_ARR_DELAY_MIN >= t.p95 THEN 'HIGH' ELSE 'MODERATE' END AS severity
FROM silver s LEFT JOIN th t ON s.AIRPORT = t.AIRPORT"""),
    "report_anomalies_top": (["arows"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY airport ORDER BY avg_arr_delay_min DESC NULLS LAST,
    date NULLS LAST, anomaly_type ASC) AS rn FROM arows) WHERE rn <= 30"""),
    "report_anomalies_monthly": (["arows"], """
SELECT airport, year, month, count(*) AS anomalies_count,
  round(avg(avg_arr_delay_min), 6) AS avg_delay_on_anomaly_days,
  count(DISTINCT date) AS anomaly_days
FROM arows GROUP BY airport, year, month"""),
    "normalize_code": ([], """
SELECT p_partkey, p_brand, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS brand_code
FROM part"""),
    "safe_numeric_cast": (["bronze"], f"""
SELECT APT_ICAO, FLT_DATE,
  {_j(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ["FLT_ARR_1", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"] + CAUSES + [TOTAL])}
FROM bronze"""),
    "parse_dual_timestamp": (["bronze"], """
SELECT APT_ICAO, FLT_DATE, CAST(epoch(ts) AS BIGINT) AS epoch_s, CAST(ts AS DATE) AS DATE
FROM (SELECT APT_ICAO, FLT_DATE,
        coalesce(try_strptime(FLT_DATE, '%Y-%m-%dT%H:%M:%SZ'),
                 try_strptime(FLT_DATE, '%Y-%m-%dT%H:%M:%S.%gZ')) AS ts
      FROM bronze)"""),
    "calendar_parts_lineitem": ([], """
SELECT l_orderkey, l_linenumber, d AS DATE, CAST(year(d) AS INTEGER) AS YEAR,
  CAST(month(d) AS INTEGER) AS MONTH, CAST(isodow(d) AS INTEGER) AS DOW_ISO,
  CAST(dayofweek(d) + 1 AS INTEGER) AS DOW_SUN1, CAST(dayofmonth(d) AS INTEGER) AS DOM,
  CAST(weekofyear(d) AS INTEGER) AS WOY
FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem)"""),
    "row_sum_causes": (["typed2"], "SELECT AIRPORT AS APT_ICAO, FLT_DATE, cause_sum FROM typed2"),
    "total_delay_fallback": (["typed2"], f"""
SELECT AIRPORT AS APT_ICAO, FLT_DATE, {TOTAL}, cause_sum, TOTAL_DELAY_MIN FROM typed2"""),
    "guarded_ratio": (["typed2"], """
SELECT AIRPORT AS APT_ICAO, FLT_DATE, FLT_ARR_1 AS ARR_TOTAL_FLIGHTS, TOTAL_DELAY_MIN,
  CASE WHEN FLT_ARR_1 > 0 AND TOTAL_DELAY_MIN IS NOT NULL THEN TOTAL_DELAY_MIN / FLT_ARR_1 END
    AS AVG_ARR_DELAY_MIN
FROM typed2"""),
    "calendar_grid": (["silver"], """
SELECT c.AIRPORT, c.DATE, CAST(year(c.DATE) AS INTEGER) AS YEAR, CAST(month(c.DATE) AS INTEGER) AS MONTH,
  CAST(dayofweek(c.DATE) + 1 AS INTEGER) AS DOW, CAST(dayofmonth(c.DATE) AS INTEGER) AS DOM,
  CAST(weekofyear(c.DATE) AS INTEGER) AS WOY, s.AIRPORT IS NOT NULL AS has_data
FROM (SELECT b.AIRPORT, CAST(g.d AS DATE) AS DATE
      FROM (SELECT AIRPORT, min(DATE) AS lo, max(DATE) AS hi FROM silver
            WHERE DATE IS NOT NULL GROUP BY AIRPORT) b,
           unnest(generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY)) AS g(d)) c
LEFT JOIN (SELECT DISTINCT AIRPORT, DATE FROM silver) s ON s.AIRPORT = c.AIRPORT AND s.DATE = c.DATE"""),
    "feature_table": (["feat"], "SELECT * FROM feat"),
    "split_mode": (["plan"], "SELECT * FROM plan"),
    "time_split_counts": (["split"], """
SELECT AIRPORT, split_mode, count(*) FILTER (WHERE NOT is_test) AS train_rows,
  count(*) FILTER (WHERE is_test) AS test_rows
FROM split GROUP BY AIRPORT, split_mode"""),
    "stub_predictions_full": (["stubp"], "SELECT * EXCLUDE (is_test, prediction), round(prediction, 6) AS prediction FROM stubp"),
    "validation_daily": (["vd"], """
SELECT * EXCLUDE (prediction, error_min, abs_error_min), round(prediction, 6) AS prediction,
  round(error_min, 6) AS error_min, round(abs_error_min, 6) AS abs_error_min FROM vd"""),
    "observed_silver_counts": (["bronze", "typed", "silver"], f"""
SELECT (SELECT count(*) FROM bronze) AS rows_in,
  (SELECT CAST({' + '.join(f"coalesce(sum(CASE WHEN trim({c}) <> '' AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 1 ELSE 0 END), 0)"
                           for c in ["FLT_ARR_1", "FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"] + CAUSES + [TOTAL])} AS BIGINT)
   FROM bronze) AS casts_lost,
  (SELECT count(*) FROM typed WHERE trim(FLT_DATE) <> '' AND DATE_TS IS NULL) AS stamps_lost,
  (SELECT count(*) FROM silver) AS rows_out"""),
    "observed_validation_counts": (["silver", "stubp"], """
SELECT (SELECT count(*) FROM (SELECT DISTINCT AIRPORT, DATE FROM silver)) AS silver_rows,
  (SELECT count(*) FROM (SELECT DISTINCT AIRPORT, DATE FROM stubp)) AS pred_rows,
  (SELECT count(*) FROM (SELECT DISTINCT AIRPORT, DATE FROM silver) s
   JOIN (SELECT DISTINCT AIRPORT, DATE FROM stubp) p ON s.AIRPORT = p.AIRPORT AND s.DATE = p.DATE) AS joined_rows"""),
    "validation_bucketed": (["vd"], """
SELECT * EXCLUDE (prediction, error_min, abs_error_min), round(prediction, 6) AS prediction,
  round(error_min, 6) AS error_min, round(abs_error_min, 6) AS abs_error_min FROM vd"""),
    "random_split_sides": (["feat"], """
SELECT AIRPORT, DATE, CAST(1 AS BIGINT) AS sides, true AS share_ok FROM feat"""),
    "validation_monthly": (["vm"], "SELECT * FROM vm"),
    "report_validation_monthly": (["vm"], """
SELECT AIRPORT AS airport, YEAR AS year, MONTH AS month, CAST(days_count AS INTEGER) AS days_count,
  real_avg_delay_mean, pred_avg_delay_mean, mae_mean, rmse FROM vm"""),
    "join_coverage": (["silver", "stubp"], """
SELECT coalesce(s.AIRPORT, p.AIRPORT) AS AIRPORT, count(s.AIRPORT) AS silver_rows,
  count(p.AIRPORT) AS pred_rows,
  count(*) FILTER (WHERE s.AIRPORT IS NOT NULL AND p.AIRPORT IS NOT NULL) AS joined_rows
FROM (SELECT DISTINCT AIRPORT, DATE FROM silver) s
FULL OUTER JOIN (SELECT DISTINCT AIRPORT, DATE FROM stubp) p
  ON s.AIRPORT = p.AIRPORT AND s.DATE = p.DATE
GROUP BY coalesce(s.AIRPORT, p.AIRPORT)"""),
    "regression_metrics": (["stubp"], """
SELECT AIRPORT, count(*) AS n,
  round(sqrt(avg(power(prediction - AVG_ARR_DELAY_MIN, 2))), 6) AS rmse,
  round(1.0 - sum(power(prediction - AVG_ARR_DELAY_MIN, 2))
        / (count(*) * var_pop(AVG_ARR_DELAY_MIN)), 6) AS r2
FROM stubp WHERE is_test GROUP BY AIRPORT"""),
    "importance_pct_stub": (["feat"], f"""
SELECT feature, importance, round(importance / (SUM(importance) OVER ()) * 100, 6) AS importance_pct
FROM (SELECT feature, avg(v) AS importance
      FROM (SELECT {_j(f"abs({c}) AS {c}" for c in FEATURES)} FROM feat)
      UNPIVOT (v FOR feature IN ({", ".join(FEATURES)}))
      GROUP BY feature)"""),
    "seasonal_baseline": (["base"], "SELECT * FROM base"),
    "global_means": (["gm"], "SELECT * FROM gm"),
    "forecast_inputs": (["fut"], "SELECT * FROM fut"),
    "forecast_daily_stub": (["fcs"], """
SELECT * EXCLUDE (pred_avg_arr_delay_min), round(pred_avg_arr_delay_min, 6) AS pred_avg_arr_delay_min
FROM fcs"""),
    "forecast_monthly_stub": (["fcs"], """
SELECT AIRPORT, YEAR, MONTH, count(*) AS days_count,
  round(avg(pred_avg_arr_delay_min), 6) AS pred_monthly_mean_delay_min
FROM fcs GROUP BY AIRPORT, YEAR, MONTH"""),
    "report_days_per_year": (["basic"], """
SELECT airport, year, count(*) AS days_count FROM basic GROUP BY airport, year"""),
    "report_monthly_delay": (["mdelay"], "SELECT * FROM mdelay"),
    "report_csv_roundtrip": (["mdelay"], "SELECT * FROM mdelay"),
    "chart_series_monthly": (["mdelay"], """
SELECT airport, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month,
  monthly_avg_delay_min FROM mdelay"""),
    "report_causes_rank": (["crank"], "SELECT * FROM crank"),
    "chart_days_per_year": (["basic"], """
SELECT airport, year, count(*) AS days_count FROM basic GROUP BY airport, year"""),
    "chart_real_vs_predicted": (["vm"], """
SELECT AIRPORT AS airport, CAST(YEAR AS VARCHAR) || '-' || lpad(CAST(MONTH AS VARCHAR), 2, '0') AS year_month,
  real_avg_delay_mean, pred_avg_delay_mean FROM vm"""),
    "chart_errors_monthly": (["vm"], """
SELECT AIRPORT AS airport, CAST(YEAR AS VARCHAR) || '-' || lpad(CAST(MONTH AS VARCHAR), 2, '0') AS year_month,
  mae_mean, rmse FROM vm"""),
    "chart_forecast_monthly": (["fcs"], """
SELECT AIRPORT AS airport, CAST(YEAR AS VARCHAR) || '-' || lpad(CAST(MONTH AS VARCHAR), 2, '0') AS year_month,
  round(avg(pred_avg_arr_delay_min), 6) AS pred_monthly_mean_delay_min
FROM fcs GROUP BY AIRPORT, YEAR, MONTH"""),
    "top_total_delay_overall": (["silver"], f"""
SELECT {SILVER_COLS} FROM (
  SELECT *, row_number() OVER (ORDER BY TOTAL_DELAY_MIN DESC NULLS LAST, DATE NULLS LAST, AIRPORT NULLS LAST) AS rn
  FROM silver) WHERE rn <= 30"""),
    "anomaly_thresholds_compat_rank": (["silver"], """
SELECT AIRPORT, true AS p95_near, true AS p99_near FROM silver WHERE AVG_ARR_DELAY_MIN IS NOT NULL GROUP BY AIRPORT"""),
    "model_predictions_checked": (["stubp"], """
SELECT AIRPORT, DATE, YEAR, MONTH, AVG_ARR_DELAY_MIN, true AS agrees FROM stubp WHERE is_test"""),
    "model_predictions_full_checked": (["stubp"], """
SELECT AIRPORT, DATE, YEAR, MONTH, AVG_ARR_DELAY_MIN, true AS agrees FROM stubp"""),
    "model_metrics_checked": (["plan"], """
SELECT AIRPORT, metric, CASE WHEN metric = 'SPLIT_MODE' THEN split_mode ELSE '' END AS info, true AS agrees
FROM plan, (VALUES ('RMSE'), ('R2'), ('SPLIT_MODE')) m(metric)"""),
    "model_validation_checked": (["vd"], """
SELECT AIRPORT, YEAR, MONTH, count(*) AS days_count, true AS errors_agree, true AS month_agrees
FROM vd GROUP BY AIRPORT, YEAR, MONTH"""),
    # the split of MONTH with the least squared error, and the mean on each side
    "single_tree_predictions": (["split"], """
SELECT s.AIRPORT, s.DATE, CAST(s.YEAR AS INTEGER) AS YEAR, CAST(s.MONTH AS INTEGER) AS MONTH, s.AVG_ARR_DELAY_MIN,
  round(CASE WHEN s.MONTH <= b.cut THEN b.low ELSE b.high END, 6) AS prediction
FROM split s, (
  SELECT c.cut, avg(t.AVG_ARR_DELAY_MIN) FILTER (WHERE t.MONTH <= c.cut) AS low,
    avg(t.AVG_ARR_DELAY_MIN) FILTER (WHERE t.MONTH > c.cut) AS high,
    count(*) FILTER (WHERE t.MONTH <= c.cut) * var_pop(t.AVG_ARR_DELAY_MIN) FILTER (WHERE t.MONTH <= c.cut)
      + count(*) FILTER (WHERE t.MONTH > c.cut) * var_pop(t.AVG_ARR_DELAY_MIN) FILTER (WHERE t.MONTH > c.cut) AS sse
  FROM (SELECT * FROM split WHERE NOT is_test) t, (SELECT unnest(range(1, 12)) AS cut) c
  GROUP BY c.cut ORDER BY sse, c.cut LIMIT 1) b"""),
    "feature_importance_checked": ([], f"""
SELECT feature, true AS agrees, true AS percent_agrees
FROM (VALUES {", ".join(f"('{c}')" for c in FEATURES)}) f(feature)"""),
    "importance_reports_checked": ([], f"""
SELECT CAST(15 AS BIGINT) AS n_chart, CAST({len(FEATURES)} AS BIGINT) AS n_report, true AS top_is_first"""),
    "model_roundtrip": (["feat"], f"""
SELECT AIRPORT, DATE, true AS same, {len(FEATURES)} AS n_inputs FROM feat"""),
    "forecast_checked": (["fut"], """
SELECT AIRPORT, DATE, YEAR, MONTH, DOW, true AS agrees, true AS month_agrees FROM fut"""),
    "chart_top_causes": (["crank"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY airport ORDER BY total_minutes DESC NULLS LAST,
    cause ASC) AS rn FROM crank) WHERE rn <= 12"""),
    "gold_sql_view": (["anoms", "causes"], """
SELECT a.AIRPORT AS airport, a.anomaly_type, count(*) AS n_rows, max(c.minutes) AS top_cause_minutes
FROM anoms a JOIN (SELECT airport, max(minutes) AS minutes FROM causes GROUP BY airport) c
  ON a.AIRPORT = c.airport
GROUP BY a.AIRPORT, a.anomaly_type"""),
}


def _closure(deps: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in STEPS[n][0]:
            visit(d)
        out.append(n)

    for d in deps:
        visit(d)
    return out


def build(name: str, suppliers: bool = False) -> str:
    deps, body = FINAL[name]
    steps = _closure(deps)
    if not steps:
        return body.strip()
    sql = {n: BRONZE_SUPPLIERS if suppliers and n == "bronze" else STEPS[n][1] for n in steps}
    ctes = ",\n".join(f"{n} AS ({sql[n].strip()})" for n in steps)
    return f"WITH {ctes}\n{body.strip()}"


# The queries that also run on the supplier binding.
ON_SUPPLIERS = ("silver_partition_roundtrip", "safe_numeric_cast", "parse_dual_timestamp", "guarded_ratio",
                "calendar_grid", "eda_overall", "eda_monthly", "eda_weekday", "days_per_year_quality", "data_range",
                "causes_long", "anomaly_thresholds", "anomaly_severity", "top_avg_delay", "top_total_delay",
                "anomalies", "report_anomalies_top", "report_anomalies_monthly", "feature_table", "split_mode",
                "stub_predictions_full", "validation_daily", "join_coverage",
                "regression_metrics", "global_means", "forecast_inputs", "forecast_monthly_stub",
                "sketch_quantiles_rank", "days_per_year_merged", "data_range_merged",
                "observed_silver_counts", "observed_validation_counts", "validation_bucketed")


def oracle_sql() -> dict[str, str]:
    """SQL by query name; ``suppliers_<name>`` is <name> on that binding."""
    return {name: build(name) for name in FINAL} | {
        f"suppliers_{name}": build(name, suppliers=True) for name in ON_SUPPLIERS}
