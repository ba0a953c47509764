"""Plan shapes that the scale design relies on (read from ``explain``)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators import anomaly, profile, validate
from delaymart.operators.features import random_sides
from delaymart.operators.observed import write_validation_observed
from delaymart.operators.silver import dedup_daily, entity_filter, year_range
from delaymart.plans.mart import DelayMart
from delaymart.sinks.writers import write_parquet
from delaymart.sources.fixtures import daily_raw
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def silver(spark):
    return DelayMart.of(spark, SF_SMALL).silver()


def _tree(p: str) -> str:
    return p.split("\n\n")[0]


def test_top_k_limits_before_the_shuffle(silver):
    p = plan(anomaly.top_days(silver, S.LABEL))
    tree = _tree(p)
    # a WindowGroupLimit sits below the Exchange, and it is the partial one
    assert tree.index("Exchange") < tree.rindex("WindowGroupLimit")
    assert re.search(r"row_number\(\), 30, Partial", p)


def test_dedup_limits_before_the_shuffle(silver):
    p = plan(dedup_daily(silver.unionByName(silver)))
    assert re.search(r"row_number\(\), 1, Partial", p)


def test_median_is_a_partial_sketch(silver):
    tree = _tree(plan(profile.delay_profile(silver, ["YEAR", "MONTH"])))
    assert tree.count("ObjectHashAggregate") == 2     # partial + final
    assert "Sort " not in tree                          # no group is sorted


def test_entity_filter_is_pushed_down(silver):
    p = plan(entity_filter(silver, S.ENTITY, ["BUILDING"]))
    assert "EqualTo(AIRPORT,BUILDING)" in p


def test_year_range_prunes_partitions(silver):
    p = plan(year_range(silver, 1998, 2001))
    assert re.search(r"PartitionFilters: \[.*YEAR.*>= 1998.*<= 2001", p)


def test_bronze_derivation_prunes_and_needs_no_expand(spark):
    p = plan(daily_raw(spark, SF_SMALL))
    assert "Expand" not in p                            # no multi-distinct rewrite
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in p


def test_bronze_derivation_partial_aggregates(spark):
    tree = _tree(plan(daily_raw(spark, SF_SMALL)))
    # lineitem per order, then per (segment, day, order), then per (segment, day)
    assert tree.count("HashAggregate") >= 5


def test_share_window_runs_on_aggregated_rows(silver):
    tree = _tree(plan(profile.causes_long(silver)))
    # the window sits above the aggregate, never over the daily rows
    assert tree.index("Window") < tree.index("HashAggregate")


def _big(spark):
    """Broadcasts off, as on inputs above the threshold."""
    return {k: "-1" for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_validation_needs_one_exchange_per_side(spark, silver):
    from delaymart.operators.validate import validation_daily
    p = silver.select("AIRPORT", "DATE", F.lit(1.0).alias("prediction"))
    with conf(spark, _big(spark)):
        assert _tree(plan(validation_daily(silver, p))).count("Exchange") == 2


def test_anomalies_read_silver_once(spark, silver):
    th = DelayMart.of(spark, SF_SMALL).thresholds()
    p = plan(anomaly.anomalies(silver, th=th))
    assert _tree(p).count("Scan parquet") == 2                # Silver and the thresholds
    assert re.search(r"row_number\(\), 30, Partial", p)


def test_forecast_inputs_aggregate_the_history_once(spark, silver):
    from delaymart.operators import features, forecast
    cols = features.feature_columns(silver)
    df = forecast.forecast_inputs(silver, cols, 1998, 2001, 2026)
    p = plan(df)
    reads = [x for x in re.findall(r"ReadSchema: (.*)", p) if "ARR_TOTAL_FLIGHTS" in x]
    assert len(reads) == 1 and _tree(p).count("Scan parquet") == 2     # the other reads the entity only


def test_no_python_udf_in_operator_plans(spark, silver):
    for df in [daily_raw(spark, SF_SMALL), anomaly.anomalies(silver),
               profile.delay_profile(silver), profile.causes_long(silver)]:
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_one_row_total_is_broadcast(spark):
    from delaymart.operators.interpret import importance_pct
    fi = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, importance double")
    p = plan(importance_pct(fi))
    assert "BroadcastNestedLoopJoin" in p or "BroadcastExchange" in p
    got = {r.feature: r.importance_pct for r in importance_pct(fi).collect()}
    assert got == {"a": 25.0, "b": 75.0}


def test_skewed_entity_top_k_is_exact(spark):
    # one entity holds most rows; the per-entity top-k stays exact
    rows = [("HOT", i, float(i)) for i in range(3000)] + [("COLD", i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "AIRPORT string, d int, v double").withColumn(
        "DATE", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")))
    df = df.withColumn(S.LABEL, F.col("v")).repartition(16)
    top = anomaly.top_days(df, S.LABEL, k=5).where("AIRPORT = 'HOT'").collect()
    assert sorted(r.v for r in top) == [2995.0, 2996.0, 2997.0, 2998.0, 2999.0]


def test_bronze_derivation_at_scale_shape(spark):
    """With broadcasts off (as for inputs far above the threshold) the joins
    are sort-merge joins, the per-order stage reuses the order-key
    partitioning (no exchange on segment/day/order), and the rows are the
    same as with broadcasts."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = daily_raw(spark, SF_SMALL)
        p = plan(df)
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p
        assert not re.search(r"hashpartitioning\(c_mktsegment#\d+, d#\d+, o_orderkey", p)
        smj = sorted(df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert smj == sorted(daily_raw(spark, SF_SMALL).collect())


def test_bronze_derivation_exact_under_skew(spark, tmp_dir):
    """Hand-made tables where one customer places a third of all orders and
    one order has hundreds of lines: with broadcasts off (sort-merge joins,
    AQE skew splitting) the Bronze rows equal DuckDB's on the same files."""
    import datetime as dt
    import random

    import duckdb

    from delaymart.plans.oracle import build

    rng = random.Random(7)
    customers = [(k, ["AUTOMOBILE", "BUILDING", "MACHINERY"][k % 3]) for k in range(1, 31)]
    orders, lines = [], []
    for ok in range(1, 601):
        ck = 1 if ok % 3 == 0 else rng.randint(2, 30)
        day = dt.datetime(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 40))
        orders.append((ok, ck, day))
        for ln in range(300 if ok == 3 else rng.randint(0, 6)):
            lines.append((ok, float(rng.randint(1, 50)), rng.choice("ANR"), rng.choice("FO")))
    for name, rows, schema in [
        ("customer", customers, "c_custkey bigint, c_mktsegment string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        ("lineitem", lines, "l_orderkey bigint, l_quantity double, l_returnflag string, l_linestatus string"),
    ]:
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_dir}/{name}.parquet")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        got = sorted(tuple(r) for r in daily_raw(spark, tmp_dir).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_dir}/{name}.parquet/*.parquet')")
    rel = con.execute(build("csv_bronze_scan"))
    want = sorted(tuple(r) for r in rel.fetchall())
    assert got == want and len(got) > 50


def test_bucketed_validation_has_no_exchange(spark):
    m = DelayMart.of(spark, SF_SMALL)
    df = validate.validation_bucketed(spark, m.bucketed_sides())
    tree = _tree(plan(df))
    assert "SortMergeJoin" in tree and "Exchange" not in tree
    assert "SelectedBucketsCount: 8 out of 8" in plan(df)
    key = [S.ENTITY, "DATE"]
    plain = m.stub_validation_daily().orderBy(*key).collect()
    assert plain and df.orderBy(*key).collect() == plain


def test_random_sides_do_not_depend_on_the_input_partitions(spark):
    rows = DelayMart.of(spark, SF_SMALL).features()
    runs = [{tuple(r) for r in random_sides(x).select(S.ENTITY, "DATE", "is_test").collect()}
            for x in (rows.coalesce(1), rows.repartition(13), rows.orderBy(F.rand(3)))]
    assert runs[0] == runs[1] == runs[2]
    other = {tuple(r) for r in random_sides(rows, seed=7).select(S.ENTITY, "DATE", "is_test").collect()}
    assert other != runs[0] and {r[:2] for r in other} == {r[:2] for r in runs[0]}


def test_observed_counts_need_no_job_of_their_own(spark, tmp_dir):
    m = DelayMart.of(spark, SF_SMALL)
    silver, preds = m.silver(), m.stub_predictions_full()
    tracker, group = spark.sparkContext.statusTracker(), "observed-validation"
    plain, seen = "plain-validation", {}
    for name, write in ((plain, lambda: write_parquet(validate.validation_daily(silver, preds), f"{tmp_dir}/a")),
                        (group, lambda: seen.update(write_validation_observed(silver, preds, f"{tmp_dir}/b")))):
        spark.sparkContext.setJobGroup(name, name)
        write()
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(group)) == len(tracker.getJobIdsForGroup(plain))
    assert spark.read.parquet(f"{tmp_dir}/b").count() == seen["joined_rows"] > 0
