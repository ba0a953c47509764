"""The driver contract in ``__spark_entry__``."""

import importlib


def test_entry_contract(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.columns == ["YEAR", "MONTH", "days_count", "arrivals_sum", "arrivals_avg_per_day",
                          "delay_min_sum", "avg_delay_min_mean", "avg_delay_min_median",
                          "avg_delay_min_max", "airport"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    assert all(callable(f) and f.__doc__ for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
