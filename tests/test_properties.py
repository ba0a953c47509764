"""Properties of SURVEY section 5 (layer 3)."""

import pytest
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators import anomaly, forecast, profile
from delaymart.plans.mart import DelayMart
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def small_forest(spark):
    # Fewer trees keep the test quick; the plumbing is the same.
    return DelayMart(spark, SF_MID, num_trees=10, entity="BUILDING", history=(1998, 2001))


def test_shares_sum_to_one(spark):
    m = DelayMart.of(spark, SF_SMALL)
    for r in m.causes().groupBy("airport").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_importances_sum_to_100(small_forest):
    total = small_forest.interpretation().agg(F.sum("importance_pct")).first()[0]
    assert total == pytest.approx(100.0)


def test_forecast_has_every_day(small_forest):
    daily = small_forest.forest_forecast_daily()
    assert daily.count() == 365
    monthly = forecast.forecast_monthly(daily).collect()
    assert len(monthly) == 12 and sum(r.days_count for r in monthly) == 365


def test_saved_model_predicts_the_same(small_forest):
    rows = small_forest.model_rows()
    a = small_forest.forest_fitted().transform(rows).select("DATE", "prediction")
    b = small_forest.forest_loaded().transform(rows).select("DATE", F.col("prediction").alias("p2"))
    assert a.join(b, "DATE").where(F.col("prediction") != F.col("p2")).count() == 0


def test_metrics_rows(small_forest):
    rows = {r.metric: r for r in small_forest.forest_metrics().collect()}
    assert set(rows) == {"RMSE", "R2", "SPLIT_MODE"}
    assert rows["RMSE"].value >= 0 and rows["SPLIT_MODE"].info == "TIME_SPLIT_TEST_YEAR_2001"


def test_refit_gives_same_trees(spark, small_forest):
    from delaymart.operators import model
    train = small_forest.model_rows().where(~F.col("is_test"))
    m1 = model.fit_forest(train, small_forest.feature_cols(), num_trees=5)
    m2 = model.fit_forest(train.repartition(7), small_forest.feature_cols(), num_trees=5)
    assert m1.stages[-1].featureImportances == m2.stages[-1].featureImportances


def test_partition_count_does_not_change_results(spark):
    s = DelayMart.of(spark, SF_SMALL).silver()
    a = sorted(profile.delay_profile(s, ["YEAR", "MONTH"]).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = sorted(profile.delay_profile(s.repartition(5), ["YEAR", "MONTH"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    def rounded(rows):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    assert rounded(a) == rounded(b)


def test_anomaly_rows_equal_parts(spark):
    s = DelayMart.of(spark, SF_SMALL).silver()
    th = anomaly.thresholds(s)
    outl = anomaly.p95_outliers(s, th).groupBy("AIRPORT").count()
    days = s.groupBy("AIRPORT").count().withColumnRenamed("count", "days")
    got = anomaly.anomalies(s).groupBy("AIRPORT").count().withColumnRenamed("count", "n")
    for r in got.join(outl, "AIRPORT").join(days, "AIRPORT").collect():
        assert r.n == min(30, r.days) * 2 + r["count"]


def test_cli_over_a_raw_csv_tree(spark, tmp_dir):
    """The steps run from a raw CSV tree with a single-entity filter, as
    the original ETL did for one airport."""
    from delaymart.__main__ import main
    src = DelayMart.of(spark, SF_SMALL)
    out = main(["--bronze", src.bronze_path(), "--out", tmp_dir + "/mart",
                "--entities", "BUILDING", "--steps", "etl,eda,anomalies"])
    silver = spark.read.parquet(out["silver"])
    assert {r[0] for r in silver.select("AIRPORT").distinct().collect()} == {"BUILDING"}
    overall = spark.read.parquet(out["eda/overall"]).first()
    assert overall.airport == "BUILDING" and overall.days_count == silver.count()
    assert spark.read.parquet(out["anomalies"]).count() > 0


def csv_tree(path, days, entity="lkpr", flights=2):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{entity}-{days[0]}.csv", "w") as f:
        f.write("APT_ICAO,FLT_DATE,FLT_ARR_1,DLY_APT_ARR_A_1\n")
        f.writelines(f"{entity},2024-01-{d:02d}T00:00:00Z,{flights},{4 * d}\n" for d in days)


def test_cli_steps_in_separate_runs_reuse_matching_layers_only(spark, tmp_dir):
    """A later call reads the Silver an earlier one finished from the same
    input and parameters; anything else is written anew, and so is what a
    named step owns."""
    import glob
    import os
    from delaymart.__main__ import main
    out, tree = tmp_dir + "/mart", tmp_dir + "/tree"
    silver, marker = out + "/silver", out + "/silver/_SUCCESS"

    def run(*more):
        main(["--bronze", tree, "--out", out, "--history", "2024-2024", *more])
        return spark.read.parquet(silver), os.stat(marker).st_mtime_ns

    csv_tree(tree, range(1, 11))
    rows, first = run("--steps", "etl")
    assert rows.count() == 10
    assert run("--steps", "eda")[1] == first                      # same input: read
    rows, second = run("--steps", "etl,eda")
    assert second > first and rows.count() == 10                  # named: written anew
    csv_tree(tree, range(11, 15))
    rows, third = run("--steps", "eda")
    assert third > second and rows.count() == 14                  # another file
    assert spark.read.parquet(out + "/gold/eda/overall").first().days_count == 14
    csv_tree(tree, range(1, 4), entity="eddf")
    assert run("--steps", "eda", "--entities", "EDDF")[0].count() == 3
    assert run("--steps", "eda")[0].count() == 17                 # other entities
    for part in glob.glob(silver + "/**/*.parquet", recursive=True)[1:]:
        os.rename(part, tmp_dir + "/" + os.path.basename(part))
    os.rename(marker, tmp_dir + "/_SUCCESS")
    assert run("--steps", "eda")[0].count() == 17                 # half-written


def test_forecast_follows_its_parameters(spark, tmp_dir):
    """Target year, history and number of trees are in the manifest; an entity
    without history still gets every day."""
    from delaymart.__main__ import main
    out, tree = tmp_dir + "/mart", tmp_dir + "/tree"
    import os
    os.makedirs(tree)
    with open(tree + "/a.csv", "w") as f:
        f.write("APT_ICAO,FLT_DATE,FLT_ARR_1,DLY_APT_ARR_A_1\n")
        f.writelines(f"lkpr,{y}-{m:02d}-{d:02d}T00:00:00Z,{2 + d % 3},{d}\n"
                     for y in (2023, 2024) for m in range(1, 8) for d in range(1, 28))
        f.writelines(f"eddf,2021-01-{d:02d}T00:00:00Z,3,{d}\n" for d in range(1, 28))

    def run(*more):
        paths = main(["--bronze", tree, "--out", out, "--steps", "forecast", *more])
        daily = spark.read.parquet(paths["forecast_daily"])
        return {r.AIRPORT: (r.n, r.y) for r in daily.groupBy("AIRPORT").agg(
            F.count("*").alias("n"), F.max("YEAR").alias("y")).collect()}

    base = ["--trees", "3", "--history", "2023-2024"]
    assert run(*base, "--target-year", "2026") == {"LKPR": (365, 2026), "EDDF": (365, 2026)}
    stamp = os.stat(out + "/model/metadata/_SUCCESS").st_mtime_ns
    assert run(*base, "--target-year", "2028") == {"LKPR": (366, 2028), "EDDF": (366, 2028)}
    assert os.stat(out + "/model/metadata/_SUCCESS").st_mtime_ns == stamp     # the model fits
    assert run("--trees", "4") == {"LKPR": (365, 2026), "EDDF": (365, 2026)}
    assert os.stat(out + "/model/metadata/_SUCCESS").st_mtime_ns > stamp
    assert run("--trees", "4", "--entity", "LKPR") == {"LKPR": (365, 2026)}


def test_cli_sizes_the_shuffle_from_the_input(spark, tmp_dir, monkeypatch):
    from delaymart import __main__ as cli
    csv_tree(tmp_dir + "/tree", range(1, 4))
    monkeypatch.setattr(cli, "files_mark", lambda *a: [1, 1 << 40, 0])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = {}
    monkeypatch.setattr(cli, "run_steps", lambda m, steps: seen.update(
        n=spark.conf.get("spark.sql.shuffle.partitions")) or {})
    try:
        cli.main(["--bronze", tmp_dir + "/tree", "--out", tmp_dir + "/mart"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        for k in ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes",
                  "skewJoin.skewedPartitionThresholdInBytes"):
            spark.conf.unset(f"spark.sql.adaptive.{k}")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen["n"] == str((1 << 40) // (256 << 20))


def test_cli_forecast_loads_earlier_model(spark, tmp_dir):
    """A forecast run after a model run loads the saved pipeline (S4) instead
    of fitting again."""
    import os
    from delaymart.__main__ import main
    out = tmp_dir + "/mart"
    first = main(["--tables", SF_SMALL, "--out", out, "--trees", "5", "--steps", "etl,model"])
    meta = os.path.join(first["model"], "metadata", "_SUCCESS")
    stamp = os.path.getmtime(meta)
    second = main(["--tables", SF_SMALL, "--out", out, "--trees", "5", "--steps", "forecast"])
    assert os.path.getmtime(meta) == stamp
    assert spark.read.parquet(second["forecast_daily"]).count() == 365 * 5


def test_in_plan_metrics_equal_spark_evaluator(small_forest):
    from pyspark.ml.evaluation import RegressionEvaluator

    from delaymart.operators import model
    scored = small_forest.forest().transform(small_forest.model_rows().where(F.col("is_test")))
    ev = RegressionEvaluator(labelCol=S.LABEL, predictionCol="prediction")
    rmse, r2 = (ev.setMetricName(n).evaluate(scored) for n in ("rmse", "r2"))
    row = model.regression_metrics(scored, by=()).first()
    assert row.rmse == pytest.approx(rmse, rel=1e-9) and row.r2 == pytest.approx(r2, rel=1e-9)
