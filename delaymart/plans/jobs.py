"""The original project's eight steps as one runnable job.

Each step writes its tables under the mart's root: ``silver/`` (by
YEAR/MONTH), ``gold/<table>`` (Parquet), ``model/`` (the fitted pipeline),
``report/<table>`` (CSV) and ``charts/<series>`` (CSV data of the figures).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators import profile, report
from delaymart.plans.mart import DelayMart
from delaymart.sinks.writers import write_report_csv

STEPS = ["etl", "eda", "anomalies", "model", "validation", "interpretation",
         "forecast", "report"]
# The layers each step owns: a named step writes them anew.
OWN = {"etl": ["bronze", "silver"],
       "eda": [f"gold:eda/{t}" for t in ("profiles", "calendar", "overall", "yearly", "monthly", "weekday",
                                         "days_per_year_quality", "data_range")] + ["gold:causes"],
       "anomalies": ["gold:thresholds", "gold:anomalies"],
       "model": ["gold:features", "gold:split", "forest", "gold:predictions", "gold:predictions_full",
                 "gold:metrics", "gold:feature_importance"],
       "validation": ["gold:validation_daily", "gold:validation_monthly"],
       "interpretation": ["gold:interpretation"],
       "forecast": ["gold:forecast_daily", "gold:forecast_monthly"],
       "report": []}


def _eda(m: DelayMart) -> dict[str, str]:
    s = m.silver()
    # A1-A3 are one pass over Silver; each table is then a slice of it.
    levels = m.gold("eda/profiles", lambda: profile.profile_levels(s))
    tables: dict[str, Callable[[], DataFrame]] = {
        "eda/overall": lambda: profile.profile_slice(levels, []),
        "eda/yearly": lambda: profile.profile_slice(levels, ["YEAR"]),
        "eda/monthly": lambda: profile.profile_slice(levels, ["YEAR", "MONTH"]),
        "eda/weekday": lambda: profile.weekday_profile(s),
        "eda/days_per_year_quality": lambda: profile.days_per_year_quality(s),
        "eda/data_range": lambda: profile.data_range(s),
    }
    out = {}
    for name, build in tables.items():
        m.gold(name, build)
        out[name] = m.path("gold", name)
    m.causes()
    out["causes"] = m.path("gold", "causes")
    return out


def _report(m: DelayMart) -> dict[str, str]:
    basic = report.silver_basic(m.silver())
    rows = report.anomaly_rows(m.anomalies())
    monthly = report.monthly_delay(basic)
    ranked = report.causes_rank(m.causes())
    interp = report.importance_report(m.interpretation())
    valm = m.forest_validation_monthly().withColumnsRenamed({"YEAR": "year", "MONTH": "month"})
    anom_monthly = report.anomalies_monthly(rows)
    tables = {
        "report/data_range": (profile.data_range(m.silver()), ["AIRPORT"], None),
        "report/days_per_year": (report.days_per_year(basic), ["airport", "year"], None),
        "report/silver_monthly_delay": (monthly, ["airport", "year", "month"], None),
        "report/causes_rank": (ranked, ["airport", F.col("total_minutes").desc()], None),
        "report/anomalies_top30": (report.anomalies_top(rows),
                                   ["airport", F.col("avg_arr_delay_min").desc()], None),
        "report/anomalies_monthly": (anom_monthly, ["airport", "year", "month"], None),
        "report/model_validation_monthly": (report.validation_report(valm),
                                            ["airport", "year", "month"], None),
        "report/model_feature_importance_pct": (interp, [F.col("importance_pct").desc()], 200),
        "charts/silver_monthly_delay": (report.chart_series(monthly, ["monthly_avg_delay_min"]),
                                        ["airport", "year_month"], None),
        "charts/causes_total_minutes": (report.chart_top(ranked, 12, "total_minutes", "cause"),
                                        ["airport", F.col("total_minutes").desc()], None),
        "charts/anomalies_count_monthly": (report.chart_series(anom_monthly, ["anomalies_count"]),
                                           ["airport", "year_month"], None),
        "charts/days_per_year": (report.days_per_year(basic), ["airport", "year"], None),
        "charts/validation_monthly": (report.chart_validation(valm), ["airport", "year_month"], None),
        "charts/forecast_monthly": (report.chart_series(
            m.forest_forecast_monthly().withColumnRenamed(S.ENTITY, "airport"),
            ["pred_monthly_mean_delay_min"], y="YEAR", m="MONTH"), ["airport", "year_month"], None),
        "charts/feature_importance_top15": (report.chart_top(interp, 15, "importance_pct",
                                                             "feature", by=()),
                                            [F.col("importance_pct").desc()], None),
    }
    out = {}
    for name, (df, order, limit) in tables.items():
        out[name] = write_report_csv(df, m.path(name), order_by=order, limit=limit)
    return out


def run_steps(m: DelayMart, steps: Sequence[str] = STEPS) -> dict[str, str]:
    """Run the named steps in order; returns table name -> written path."""
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; choose from {STEPS}")
    m.rebuild([key for step in steps for key in OWN[step]])
    out: dict[str, str] = {}
    for step in steps:
        if step == "etl":
            out["silver"] = m.silver_path()
        elif step == "eda":
            out.update(_eda(m))
        elif step == "anomalies":
            m.thresholds()
            m.anomalies()
            out["anomalies"] = m.path("gold", "anomalies")
        elif step == "model":
            out["model"] = m.forest_path()
            for name, fn in [("predictions", m.forest_predictions_test),
                             ("predictions_full", m.forest_predictions_full),
                             ("metrics", m.forest_metrics),
                             ("feature_importance", m.feature_importance)]:
                fn()
                out[name] = m.path("gold", name)
        elif step == "validation":
            m.forest_validation_monthly()
            out["validation_daily"] = m.path("gold", "validation_daily")
            out["validation_monthly"] = m.path("gold", "validation_monthly")
        elif step == "interpretation":
            m.interpretation()
            out["interpretation"] = m.path("gold", "interpretation")
        elif step == "forecast":
            m.forest_forecast_monthly()
            out["forecast_daily"] = m.path("gold", "forecast_daily")
            out["forecast_monthly"] = m.path("gold", "forecast_monthly")
        elif step == "report":
            out.update(_report(m))
    return out
