"""Queries without a SQL oracle (the forest and what depends on it, each of
which a ``*_checked`` query covers by SQL) run at sf0.001, where one entity
takes the random-split branch, and produce the expected shapes."""

import pytest

from delaymart.plans.oracle import oracle_sql
from delaymart.plans.queries import QUERIES
from tests.conftest import SF_SMALL

ROWS_ONLY = sorted(set(QUERIES) - set(oracle_sql()))


def test_rows_only_set_is_the_forest():
    assert ROWS_ONLY and all(
        n.startswith(("model_", "forecast_", "feature_importance", "importance_pct",
                      "report_feature_importance", "chart_top_features",
                      "anomaly_thresholds_compat")) for n in ROWS_ONLY)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows
    if name == "forecast_daily":
        assert len(rows) == 365 * 5
    if name == "forecast_monthly":
        assert len(rows) == 12 * 5
    if name == "model_metrics":
        info = {r.AIRPORT: r.info for r in rows if r.metric == "SPLIT_MODE"}
        assert info["BUILDING"] == "RANDOM_SPLIT_80_20"
    if name in ("importance_pct", "report_feature_importance"):
        assert sum(r.importance_pct for r in rows) == pytest.approx(100.0)
