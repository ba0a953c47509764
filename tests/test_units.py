"""Unit rows by hand (FIXTURES.md part 1): one check per edge case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.functions import columns as C
from delaymart.operators import anomaly, features, forecast, model, profile, validate
from delaymart.operators.silver import dedup_daily, read_silver, silver_frame, write_silver
from delaymart.sources.bronze import read_bronze_csv, write_bronze_csv

D = dt.date


def bronze_rows(spark, rows, cols=None):
    cols = cols or ["APT_ICAO", "FLT_DATE", "FLT_ARR_1", "DLY_APT_ARR_A_1", "DLY_APT_ARR_C_1",
                    "DLY_APT_ARR_1"]
    return spark.createDataFrame(rows, ",".join(f"{c} string" for c in cols))


def test_normalize_code(spark):
    df = spark.createDataFrame([(" lk-pr\t",), ("Brand#13",), (None,)], "c string")
    got = [r[0] for r in df.select(C.normalize_code("c")).collect()]
    assert got == ["LKPR", "BRAND13", None]


def test_null_code_dropped_and_entity_list(spark):
    b = bronze_rows(spark, [(None, "2024-01-01T00:00:00Z", "1", "1", "1", None),
                            ("lkpr", "2024-01-01T00:00:00Z", "1", "1", "1", None),
                            ("eddf", "2024-01-01T00:00:00Z", "1", "1", "1", None)])
    assert sorted(r.AIRPORT for r in silver_frame(b).collect()) == ["EDDF", "LKPR"]
    assert [r.AIRPORT for r in silver_frame(b, ["LKPR"]).collect()] == ["LKPR"]


@pytest.mark.parametrize("text,expect", [
    ("2024-01-01T00:00:00Z", D(2024, 1, 1)),
    ("2024-03-31T00:00:00.000Z", D(2024, 3, 31)),
    ("2024-03-31T23:30:00+02:00", D(2024, 3, 31)),
    ("2024-03-31T23:30:00+02", D(2024, 3, 31)),
    ("bad", None), (None, None), ("", None)])
def test_dual_timestamp(spark, text, expect):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(C.to_day(C.dual_timestamp("s"))).first()[0] == expect


def test_offset_is_utc(spark):
    df = spark.createDataFrame([("2024-03-31T23:30:00+02:00",)], "s string")
    assert df.select(F.unix_seconds(C.dual_timestamp("s"))).first()[0] == \
        int(dt.datetime(2024, 3, 31, 21, 30, tzinfo=dt.timezone.utc).timestamp())


def test_bad_number_is_null(spark):
    df = spark.createDataFrame([("x1",), ("",), ("12",), (None,)], "s string")
    assert [r[0] for r in df.select(C.safe_double("s")).collect()] == [None, None, 12.0, None]


def test_totals_and_ratio(spark):
    rows = [("a", "2024-01-01T00:00:00Z", "2", "3", "4", "10"),    # total given
            ("a", "2024-01-02T00:00:00Z", "2", "3", None, None),    # total null -> causes
            ("a", "2024-01-03T00:00:00Z", "0", None, None, None),   # all null -> 0, flights 0
            ("a", "2024-01-04T00:00:00Z", None, "1", "1", None)]    # null flights
    s = {r.DATE.day: r for r in silver_frame(bronze_rows(spark, rows)).collect()}
    assert s[1].TOTAL_DELAY_MIN == 10 and s[1].AVG_ARR_DELAY_MIN == 5
    assert s[2].TOTAL_DELAY_MIN == 3 and s[2].AVG_ARR_DELAY_MIN == 1.5
    assert s[3].TOTAL_DELAY_MIN == 0 and s[3].AVG_ARR_DELAY_MIN is None
    assert s[4].TOTAL_DELAY_MIN == 2 and s[4].AVG_ARR_DELAY_MIN is None


def test_total_column_absent(spark):
    cols = ["APT_ICAO", "FLT_DATE", "FLT_ARR_1", "DLY_APT_ARR_A_1", "DLY_APT_ARR_C_1"]
    b = bronze_rows(spark, [("a", "2024-01-01T00:00:00Z", "1", "3", "4")], cols)
    r = silver_frame(b).first()
    assert r.TOTAL_DELAY_MIN == 7 and S.TOTAL_COL not in silver_frame(b).columns


def test_no_cause_columns_gives_typed_null(spark):
    cols = ["APT_ICAO", "FLT_DATE", "FLT_ARR_1"]
    s = silver_frame(bronze_rows(spark, [("a", "2024-01-01T00:00:00Z", "1")], cols))
    assert dict(s.dtypes)["TOTAL_DELAY_MIN"] == "double"
    assert s.first().TOTAL_DELAY_MIN is None


def test_weekdays(spark):
    df = spark.createDataFrame([(D(2023, 12, 31),), (D(2024, 1, 1),)], "d date")
    got = df.select(C.iso_weekday("d"), C.sunday_weekday("d"), F.weekofyear("d")).collect()
    assert [tuple(r) for r in got] == [(7, 1, 52), (1, 2, 1)]


def test_even_count_median_takes_lower(spark):
    df = spark.createDataFrame([("A", D(2024, 1, i), 1, v) for i, v in enumerate([1., 3., 4., 5.], 1)],
                               "AIRPORT string, DATE date, YEAR int, AVG_ARR_DELAY_MIN double")
    df = df.withColumns({"ARR_TOTAL_FLIGHTS": F.lit(1.0), "TOTAL_DELAY_MIN": F.lit(1.0)})
    assert profile.delay_profile(df).first().avg_delay_min_median == 3.0


def _daily(spark, vals, entity="A"):
    rows = [(entity, D(2024, 1, 1) + dt.timedelta(days=i), v, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "AIRPORT string, DATE date, AVG_ARR_DELAY_MIN double, "
                                     "TOTAL_DELAY_MIN double")
    return df.withColumns({"YEAR": F.year("DATE"), "MONTH": F.month("DATE")})


def test_null_average_is_moderate_and_last(spark):
    df = _daily(spark, [None, 5.0, 7.0])
    top = anomaly.top_days(df, S.LABEL, k=3).collect()
    assert top[-1].AVG_ARR_DELAY_MIN is None or len(top) == 3
    graded = anomaly.anomalies(df, k=3).where(F.col(S.LABEL).isNull()).collect()
    assert graded and all(r.severity == "MODERATE" for r in graded)


def test_no_rows_thresholds_and_outliers(spark):
    df = _daily(spark, [None, None])
    th = anomaly.thresholds(df).first()
    assert th.p95 is None and th.p99 is None
    assert anomaly.p95_outliers(df, anomaly.thresholds(df)).count() == 0


def test_anomaly_counts(spark):
    vals = [float(i) for i in range(100)]
    df = _daily(spark, vals)
    a = anomaly.anomalies(df)
    th = anomaly.thresholds(df).first()
    n_out = sum(1 for v in vals if v >= th.p95)
    assert a.count() == 30 + 30 + n_out
    sev = {r.AVG_ARR_DELAY_MIN: r.severity for r in a.collect()}
    rank = {"MODERATE": 0, "HIGH": 1, "EXTREME": 2}
    ordered = [rank[sev[v]] for v in sorted(sev)]
    assert ordered == sorted(ordered)          # monotone in the measure


def test_causes_all_zero_and_null_column(spark):
    df = spark.createDataFrame([("A", 0.0, None), ("A", 0.0, None)],
                               "AIRPORT string, DLY_APT_ARR_A_1 double, DLY_APT_ARR_C_1 double")
    long = {r.cause: r for r in profile.causes_long(df).collect()}
    assert long["DLY_APT_ARR_C_1"].minutes == 0.0
    assert all(r.share == 0.0 for r in long.values())


def test_compat_includes_total(spark):
    df = spark.createDataFrame([("A", 1.0, 3.0)], "AIRPORT string, DLY_APT_ARR_A_1 double, DLY_APT_ARR_1 double")
    assert {r.cause for r in profile.causes_long(df, include_total=True).collect()} == \
        {"DLY_APT_ARR_A_1", "DLY_APT_ARR_1"}
    assert {r.cause for r in profile.causes_long(df).collect()} == {"DLY_APT_ARR_A_1"}


def test_duplicate_day_same_survivor(spark):
    rows = [("A", D(2024, 1, 1), 2.0), ("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 3.0)]
    df = spark.createDataFrame(rows, "AIRPORT string, DATE date, v double")
    a = dedup_daily(df).orderBy("DATE").collect()
    b = dedup_daily(df.repartition(3)).orderBy("DATE").collect()
    assert a == b and len(a) == 2 and a[0].v == 1.0


def _feat(spark, per_year):
    rows = []
    for year, n in per_year.items():
        for i in range(n):
            rows.append(("A", D(year, 1, 1) + dt.timedelta(days=i), float(year)))
    return spark.createDataFrame(rows, "AIRPORT string, DATE date, YEAR double")


@pytest.mark.parametrize("per_year,mode", [
    ({2024: 200}, S.SPLIT_RANDOM),
    ({2023: 300, 2024: 29}, S.SPLIT_RANDOM),
    ({2023: 300, 2024: 30}, "TIME_SPLIT_TEST_YEAR_2024"),
    ({2023: 99, 2024: 100}, S.SPLIT_RANDOM),
])
def test_split_modes(spark, per_year, mode):
    f = _feat(spark, per_year)
    plan = features.split_plan(f)
    assert plan.first().split_mode == mode
    counts = features.split_counts(features.assign_split(f, plan)).first()
    assert counts.train_rows + counts.test_rows == sum(per_year.values())
    if mode != S.SPLIT_RANDOM:
        assert counts.test_rows == per_year[max(per_year)]


def test_forecast_fallbacks_and_leap_year(spark):
    rows = [("A", D(2024, 1, 1), 2024, 10.0), ("A", D(2024, 1, 8), 2024, 20.0)]   # Mondays
    s = spark.createDataFrame(rows, "AIRPORT string, DATE date, YEAR int, ARR_TOTAL_FLIGHTS double")
    cols = ["ARR_TOTAL_FLIGHTS", "DLY_APT_ARR_A_1", "YEAR", "MONTH", "DOW"]
    fut = forecast.forecast_inputs(s, cols, 2024, 2024, 2028)
    assert fut.count() == 366
    r = {x.DATE: x for x in fut.collect()}
    assert r[D(2028, 1, 3)].ARR_TOTAL_FLIGHTS == 15.0   # Monday cell
    assert r[D(2028, 1, 4)].ARR_TOTAL_FLIGHTS == 15.0   # empty cell -> global mean
    assert r[D(2028, 1, 4)].DLY_APT_ARR_A_1 == 0.0       # absent in Silver -> 0
    assert dict(fut.dtypes)["YEAR"] == "int"


def test_empty_join_raises(spark):
    s = _daily(spark, [1.0, 2.0])
    p = spark.createDataFrame([("A", D(1999, 1, 1), 1.0)], "AIRPORT string, DATE date, prediction double")
    v = validate.validation_daily(s, p)
    with pytest.raises(RuntimeError):
        validate.check_join(v)
    cov = validate.join_coverage(s, p).first()
    assert (cov.silver_rows, cov.pred_rows, cov.joined_rows) == (2, 1, 0)


def test_mae_not_above_rmse(spark):
    s = _daily(spark, [1.0, 2.0, 10.0])
    p = s.select("AIRPORT", "DATE", (F.col(S.LABEL) * 1.5).alias("prediction"))
    m = validate.validation_monthly(validate.validation_daily(s, p)).first()
    assert m.mae_mean <= m.rmse + 1e-12


def test_stub_predictor_falls_back(spark):
    train = spark.createDataFrame([("A", 1, 2, 4.0), ("A", 1, 2, 6.0), ("A", 2, 3, 10.0)],
                                  "AIRPORT string, MONTH int, DOW int, AVG_ARR_DELAY_MIN double")
    stub = model.stub_fit(train)
    q = spark.createDataFrame([("A", 1, 2), ("A", 5, 5)], "AIRPORT string, MONTH int, DOW int")
    got = {(r.MONTH, r.DOW): r.prediction for r in model.stub_predict(q, stub).collect()}
    assert got[(1, 2)] == 5.0 and got[(5, 5)] == pytest.approx(20.0 / 3)


def test_bronze_csv_roundtrip_keeps_whitespace(spark, tmp_dir):
    b = bronze_rows(spark, [("-building ", "2024-01-01T00:00:00Z", "1", None, "2", None)])
    write_bronze_csv(b, tmp_dir + "/bronze")
    back = read_bronze_csv(spark, tmp_dir + "/bronze").first()
    assert back.APT_ICAO == "-building " and back.DLY_APT_ARR_A_1 is None


def test_strict_csv_rejects_reordered_header(spark, tmp_dir):
    import os
    os.makedirs(tmp_dir + "/tree/a")
    os.makedirs(tmp_dir + "/tree/b")
    with open(tmp_dir + "/tree/a/1.csv", "w") as f:
        f.write("APT_ICAO,FLT_DATE\nx,2024-01-01T00:00:00Z\n")
    with open(tmp_dir + "/tree/b/2.csv", "w") as f:
        f.write("FLT_DATE,APT_ICAO\n2024-01-02T00:00:00Z,y\n")
    with pytest.raises(Exception):
        read_bronze_csv(spark, tmp_dir + "/tree").collect()


def test_silver_partition_roundtrip(spark, tmp_dir):
    rows = [("a", "2024-01-01T00:00:00Z", "1", "1", "1", None),
            ("a", "bad", "1", "1", "1", None)]
    s = silver_frame(bronze_rows(spark, rows))
    write_silver(s, tmp_dir + "/silver")
    back = read_silver(spark, tmp_dir + "/silver")
    assert back.columns == s.columns
    got = sorted(back.collect(), key=lambda r: (r.DATE is None, r.DATE))
    assert got[0].YEAR == 2024 and got[1].DATE is None and got[1].YEAR is None


def test_required_columns_raise(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        profile.delay_profile(df)
    with pytest.raises(ValueError):
        anomaly.anomalies(df)


def test_scale_settings():
    from delaymart.session import scale_settings
    conf = scale_settings(100 * (1 << 40))            # 100 TiB
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert scale_settings(1 << 20)["spark.sql.shuffle.partitions"] == "200"


def test_dynamic_overwrite_keeps_other_months(spark, tmp_dir):
    rows = [("a", "2024-01-01T00:00:00Z", "1", "1", "1", None),
            ("a", "2024-02-01T00:00:00Z", "2", "2", "2", None)]
    s = silver_frame(bronze_rows(spark, rows))
    write_silver(s, tmp_dir + "/silver")
    jan = silver_frame(bronze_rows(spark, [("a", "2024-01-01T00:00:00Z", "5", "5", "5", None)]))
    write_silver(jan, tmp_dir + "/silver", dynamic=True)
    back = {r.MONTH: r.ARR_TOTAL_FLIGHTS for r in read_silver(spark, tmp_dir + "/silver").collect()}
    assert back == {1: 5.0, 2: 2.0}
    write_silver(jan, tmp_dir + "/silver")              # static: whole tree replaced
    assert read_silver(spark, tmp_dir + "/silver").count() == 1


def test_stream_ingest_is_incremental(spark, tmp_dir):
    from delaymart.streaming.ingest import ingest_available
    bronze = tmp_dir + "/bronze"
    write_bronze_csv(bronze_rows(spark, [("a", "2024-01-01T00:00:00Z", "1", "1", "1", None)]),
                     bronze + "/day1")
    silver, ckpt = tmp_dir + "/silver", tmp_dir + "/ckpt"
    ingest_available(spark, bronze, silver, ckpt)
    assert read_silver(spark, silver).count() == 1
    write_bronze_csv(bronze_rows(spark, [("a", "2024-01-02T00:00:00Z", "2", "2", "2", None)]),
                     bronze + "/day2")
    ingest_available(spark, bronze, silver, ckpt)          # only the new file is read
    got = sorted(r.DATE.day for r in read_silver(spark, silver).collect())
    assert got == [1, 2]


def test_mixed_layouts_union_by_name(spark, tmp_dir):
    import os
    from delaymart.sources.bronze import read_bronze_layouts
    os.makedirs(tmp_dir + "/l1")
    os.makedirs(tmp_dir + "/l2")
    with open(tmp_dir + "/l1/a.csv", "w") as f:
        f.write("APT_ICAO,FLT_DATE,FLT_ARR_1\nlkpr,2024-01-01T00:00:00Z,3\n")
    with open(tmp_dir + "/l2/b.csv", "w") as f:
        f.write("FLT_DATE,APT_ICAO,DLY_APT_ARR_1\n2024-01-02T00:00:00Z,lkpr,7\n")
    df = read_bronze_layouts(spark, [tmp_dir + "/l1", tmp_dir + "/l2"])
    got = {r.FLT_DATE[:10]: r for r in df.collect()}
    assert got["2024-01-01"].FLT_ARR_1 == "3" and got["2024-01-01"].DLY_APT_ARR_1 is None
    assert got["2024-01-02"].APT_ICAO == "lkpr" and got["2024-01-02"].DLY_APT_ARR_1 == "7"
    s = {r.DATE.day: r for r in silver_frame(df).collect()}
    assert s[2].TOTAL_DELAY_MIN == 7.0 and s[1].AVG_ARR_DELAY_MIN is None


def test_raw_year_columns_are_replaced_from_the_date(spark):
    cols = ["APT_ICAO", "FLT_DATE", "YEAR", "MONTH_NUM", "FLT_ARR_1", "DLY_APT_ARR_A_1"]
    b = bronze_rows(spark, [("lkpr", "2024-03-05T00:00:00Z", "2023", "x", "2", "4")], cols)
    r = silver_frame(b).first()
    assert (r.YEAR, r.MONTH, r.AVG_ARR_DELAY_MIN) == (2024, 3, 2.0)
    assert "MONTH_NUM" not in silver_frame(b).columns


def test_zero_importance_gives_null_percent(spark):
    from delaymart.operators.interpret import importance_pct
    fi = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, importance double")
    assert [r.importance_pct for r in importance_pct(fi).collect()] == [None, None]


def test_top_days_break_ties_by_all_columns(spark):
    rows = [(a, D(2024, 1, 1 + i % 2), 5.0, float(i)) for i, a in enumerate("ABCDEFGH")]
    df = spark.createDataFrame(rows, "AIRPORT string, DATE date, AVG_ARR_DELAY_MIN double, TOTAL_DELAY_MIN double")
    for n in (1, 3, 7):
        got = anomaly.top_days(df.repartition(n), S.LABEL, k=3, by=()).collect()
        assert {r.AIRPORT for r in got} == {"A", "C", "E"}
    twice = df.unionByName(df.withColumn("TOTAL_DELAY_MIN", F.lit(-1.0)))
    got = anomaly.top_days(twice.repartition(4), S.LABEL, k=1).collect()
    assert {r.TOTAL_DELAY_MIN for r in got} == {-1.0}


def test_validation_report_keeps_every_key(spark):
    from delaymart.operators import report
    row = ("A", "T1", 2024, 1, 3, 1.0, 1.0, 0.0, 0.0)
    v = spark.createDataFrame([row], "AIRPORT string, TERMINAL string, YEAR int, MONTH int, days_count long, "
                              "real_avg_delay_mean double, pred_avg_delay_mean double, mae_mean double, rmse double")
    assert report.validation_report(v, ["AIRPORT", "TERMINAL"]).columns[:3] == ["airport", "TERMINAL", "year"]


def test_forecast_without_year_and_without_history(spark):
    rows = [("A", D(2024, 1, 1), 10.0), ("B", D(2020, 1, 1), 30.0)]
    s = spark.createDataFrame(rows, "AIRPORT string, DATE date, ARR_TOTAL_FLIGHTS double")
    fut = forecast.forecast_inputs(s, ["ARR_TOTAL_FLIGHTS", "MONTH"], 2024, 2024, 2026).collect()
    assert {(r.AIRPORT, r.ARR_TOTAL_FLIGHTS) for r in fut} == {("A", 10.0), ("B", 0.0)} and len(fut) == 730


def test_leak_free_features_and_is_test_column(spark):
    s = _daily(spark, [1.0, 2.0])
    assert features.feature_columns(s, leak_free=True) == S.CALENDAR_FEATURES
    p = s.select("AIRPORT", "DATE", F.lit(1.5).alias("prediction"), (F.col(S.LABEL) > 1).alias("is_test"))
    v = validate.validation_daily(s, p, extra=["is_test"])
    assert v.columns[-1] == "is_test" and {r.is_test for r in v.collect()} == {True, False}


def test_profile_levels_equal_single_profiles(spark):
    df = _daily(spark, [1.0, None, 3.0]).unionByName(_daily(spark, [7.0], "B").withColumn("YEAR", F.lit(None).cast("int")))
    df = df.withColumn("ARR_TOTAL_FLIGHTS", F.lit(2.0))
    levels = profile.profile_levels(df)
    for keys in ([], ["YEAR"], ["YEAR", "MONTH"]):
        a, b = profile.profile_slice(levels, keys), profile.delay_profile(df, keys)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_silver_write_splits_a_hot_month(spark, tmp_dir):
    import glob
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("E"), F.col("id"))).alias("AIRPORT"),
        F.when(F.col("id") % 5 > 0, F.lit("2024-01-01").cast("date")).alias("DATE"),
        F.when(F.col("id") % 5 > 0, F.lit(2024)).alias("YEAR"), F.when(F.col("id") % 5 > 0, F.lit(1)).alias("MONTH"),
        F.rand(1).alias("AVG_ARR_DELAY_MIN"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        write_silver(df.repartition(8), tmp_dir + "/silver")
    finally:
        spark.conf.set(key, old)
    for month in ("YEAR=2024/MONTH=1", "YEAR=__HIVE_DEFAULT_PARTITION__/MONTH=__HIVE_DEFAULT_PARTITION__"):
        assert len(glob.glob(f"{tmp_dir}/silver/{month}/*.parquet")) > 1
    assert spark.read.parquet(tmp_dir + "/silver").count() == n
