"""Plans and results of the steps that must not grow with the files: what a task holds
before a shuffle, and what a shuffle carries."""

import datetime

from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators import anomaly, sketches
from delaymart.sources import fixtures

DAYS = ["2019-01-01", "2019-03-05", "2019-03-05", "2019-03-06", "2019-12-31", "2021-06-30", "2020-12-31", None]


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def silver(spark):
    rows = [(e, d, float(i), float(10 * i)) for e in ("A", "B", None) for i, d in enumerate(DAYS)]
    rows += [("Z", None, 1.0, 1.0), ("Y", "2020-02-29", None, None)]
    df = spark.createDataFrame(rows, "AIRPORT string, d string, AVG_ARR_DELAY_MIN double, TOTAL_DELAY_MIN double")
    d = F.to_date("d")
    return df.select("AIRPORT", d.alias("DATE"), F.year(d).alias("YEAR"), F.month(d).alias("MONTH"),
                     "TOTAL_DELAY_MIN", "AVG_ARR_DELAY_MIN")


def test_day_maps_are_or_ed_in_hash_aggregates(spark):
    days = [(e, datetime.date(y, 1, 1) + datetime.timedelta(i)) for e, y, at in (
        ("A", 2019, range(0, 365, 3)), ("A", 2020, range(366)), ("B", 2020, (0, 7, 8, 63, 64, 127, 320, 365)))
        for i in at] * 2
    df = spark.createDataFrame(days, "AIRPORT string, DATE date").withColumn("YEAR", F.year("DATE"))
    old, new = sketches.year_days(df.where("dayofyear(DATE) <= 200")), sketches.year_days(df.where("dayofyear(DATE) >= 100"))
    for maps in (sketches.year_days(df), sketches.merge_days(old, new)):
        assert "SortAggregate" not in plan(maps)[0] and "HashAggregate" in plan(maps)[0]
        want = df.groupBy("AIRPORT", "YEAR").agg(F.substring(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.dayofyear("DATE"))), 1, sketches.MAP_BYTES).alias("days"))
        key = lambda r: (r["AIRPORT"], r["YEAR"], bytes(r["days"]))
        assert sorted(map(key, maps.collect())) == sorted(map(key, want.collect()))


def test_the_grid_shuffles_maps_only(spark):
    s = silver(spark)
    grid = sketches.grid_from_days(sketches.year_days(s))
    assert "DATE" not in "".join(x for x in plan(grid)[1].splitlines() if "Exchange hash" in x)
    have = {(r[0], r[1]) for r in s.where("DATE is not null").select("AIRPORT", "DATE").collect()}
    got = {(r[0], r[1]): r[2] for r in grid.collect()}
    first, last = datetime.date(2019, 1, 1), datetime.date(2021, 6, 30)
    every = [first + datetime.timedelta(i) for i in range((last - first).days + 1)]
    assert {k: v for k, v in got.items() if k[0] in ("A", "B")} == {(e, d): (e, d) in have for e in "AB" for d in every}
    assert got[("Y", datetime.date(2020, 2, 29))] is True and not any(k[0] == "Z" for k in got)
    assert grid.count() == len(got)


def below_the_exchange(df, node):
    lines = plan(df)[1].splitlines()
    return [x for x in lines[max(i for i, x in enumerate(lines) if "Exchange hash" in x):] if node in x]


def test_days_are_limited_after_their_shuffle(spark):
    s = silver(spark)
    th = anomaly.thresholds(s).localCheckpoint()
    found = anomaly.anomalies(s, th=th, k=2, tasks=3)
    assert not below_the_exchange(found.where("AIRPORT is not null"), "Window")
    assert found.where(F.col("anomaly_type") == S.ANOMALY_TOP_AVG).groupBy("AIRPORT").count().where("count > 2").isEmpty()


def test_bronze_tasks_follow_the_lines(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 5)
    lines = spark.range(70).select(
        (F.col("id") % 20).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("1995-01-03").cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(f"{tmp_dir}/lineitem.parquet")
    assert fixtures.line_tasks(spark, lines) == 14
    rows = fixtures.supplier_raw(spark, tmp_dir)
    assert rows.rdd.getNumPartitions() == 14 and not below_the_exchange(rows, "Aggregate")
    assert fixtures.per_order_lines(spark, tmp_dir).rdd.getNumPartitions() == 14
    assert sorted((r["APT_ICAO"], r["FLT_ARR_1"]) for r in rows.collect() if r["FLT_ARR_1"]) == sorted(
        (f" sup-{i} ", "10") for i in range(7))
