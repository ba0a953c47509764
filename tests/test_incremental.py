"""Stored sketches and day maps, upserts, versions, quarantine, the forest's nodes."""

import contextlib
import datetime as dt
import io
import os

import pytest
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators import foresttable, model, profile, sketches
from delaymart.operators.silver import read_silver, silver_frame
from delaymart.plans.mart import DelayMart
from delaymart.sinks import snapshots
from delaymart.sources.bronze import read_bronze_csv, write_bronze_csv
from delaymart.sources.quarantine import split_rejects
from delaymart.streaming.upsert import LOADED, latest_per_day, upsert_available, upsert_batch
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def silver(spark):
    return DelayMart.of(spark, SF_SMALL).silver()


def days(spark, n, entity="A", start=dt.date(2020, 1, 1)):
    rows = spark.range(n).select(F.lit(entity).alias("AIRPORT"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("DATE"),
                                 (F.col("id") * 7919 % 10007).cast("double").alias(S.LABEL))
    return rows.select("*", F.year("DATE").alias("YEAR"), F.month("DATE").alias("MONTH"),
                       F.lit(2.0).alias("ARR_TOTAL_FLIGHTS"), F.lit(3.0).alias("TOTAL_DELAY_MIN"))


# --- sketches and day maps ---------------------------------------------------

def test_merged_sketches_keep_the_stated_rank_error(spark):
    rows, k = days(spark, 9000), 100
    cells = sketches.month_sketches(rows.where("MONTH < 5"), k=k)
    cells = sketches.merge_months(cells, sketches.month_sketches(rows.where("MONTH >= 5"), k=k), k=k)
    got = sketches.thresholds_from_cells(cells, k=k).first()
    values = sorted(r[0] for r in rows.select(S.LABEL).collect())
    for q, v in ((0.95, got.p95), (0.99, got.p99)):
        rank = sum(x <= v for x in values) / len(values)
        assert abs(rank - q) <= sketches.rank_error(k)
    assert sketches.rank_error(1600) < 0.003 < sketches.rank_error(100)


def test_cells_give_the_exact_profile(silver):
    cells = sketches.month_sketches(silver)
    for keys in ([], ["YEAR"], ["YEAR", "MONTH"]):
        want = {tuple(r[c] for c in ["airport", *keys]): r for r in profile.delay_profile(silver, keys).collect()}
        for r in sketches.profile_from_cells(cells, keys).collect():
            w = want.pop(tuple(r[c] for c in ["airport", *keys]))
            for c in w.asDict():
                if c != "avg_delay_min_median":
                    assert r[c] == pytest.approx(w[c]), c
        assert not want


def test_null_values_and_empty_tables(spark):
    none = days(spark, 5).withColumn(S.LABEL, F.lit(None).cast("double"))
    cells = sketches.month_sketches(none)
    assert cells.first().sketch is None
    assert sketches.thresholds_from_cells(cells).first()[1:] == (None, None)
    both = sketches.merge_months(cells, sketches.month_sketches(days(spark, 4, "B")))
    assert {r.AIRPORT: r.p95 for r in sketches.thresholds_from_cells(both).collect()}["A"] is None
    assert sketches.month_sketches(days(spark, 0)).count() == 0
    undated = days(spark, 3).withColumns({"DATE": F.lit(None).cast("date"), "YEAR": F.lit(None).cast("int")})
    assert sketches.year_days(undated).count() == 0


def test_day_maps_or_over_loads(spark):
    rows = days(spark, 800, start=dt.date(2019, 12, 31))       # a leap year and both ends of a year
    one, two = rows.where("DATE < '2020-12-31'"), rows.where("DATE >= '2020-06-01'")
    maps = sketches.merge_days(sketches.year_days(one), sketches.year_days(two))
    assert all(len(r.days) == sketches.MAP_BYTES for r in maps.collect())
    got = {r.YEAR: (r.rows, r.unique_days) for r in sketches.days_per_year(maps).collect()}
    assert got == {2019: (1, 1), 2020: (366 + 213, 366), 2021: (365, 365), 2022: (68, 68)}
    r = sketches.range_from_days(maps).first()
    assert (r.min_date, r.max_date, r.unique_days, r.years_count) == (dt.date(2019, 12, 31), dt.date(2022, 3, 9), 800, 4)


def test_summaries_need_one_shuffle_and_no_expand(silver):
    for df in (sketches.month_sketches(silver), sketches.year_days(silver)):
        tree = plan(df).split("\n\n")[0]
        assert "Expand" not in tree and tree.count("Exchange") == 1


def test_levels_come_from_the_cells_and_not_from_silver(spark, tmp_dir, silver):
    sketches.month_sketches(silver).write.parquet(f"{tmp_dir}/cells")
    cells = spark.read.parquet(f"{tmp_dir}/cells")
    text = plan(sketches.thresholds_from_cells(cells)) + plan(sketches.profile_from_cells(cells, ["YEAR"]))
    assert "/cells" in text and "silver" not in text


# --- upsert ------------------------------------------------------------------

COLS = "APT_ICAO string, FLT_DATE string, FLT_ARR_1 string, DLY_APT_ARR_A_1 string"


def stamp(d):
    return f"{d}T00:00:00Z"


def files(root):
    return {os.path.join(a, f): os.path.getmtime(os.path.join(a, f)) for a, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_corrected_file_replaces_its_days_only(spark, tmp_dir):
    drops, silver, work = f"{tmp_dir}/drops", f"{tmp_dir}/silver", f"{tmp_dir}/work"
    first = [("AA", stamp("2020-01-05"), "10", "100"), ("AA", stamp("2020-02-05"), "10", "100"), ("BB", stamp("2020-01-05"), "1", "7"),
             ("AA", "bad", "1", "1"), ("AA", "bad", "2", "2"), ("AA", "bad", "1", "1")]
    write_bronze_csv(spark.createDataFrame(first, COLS), f"{drops}/1")
    upsert_available(spark, drops, silver, work)
    before = files(silver)
    second = [("AA", stamp("2020-01-05"), "20", "100"), ("AA", stamp("2020-01-06"), "5", "5")]
    write_bronze_csv(spark.createDataFrame(second, COLS), f"{drops}/2")
    upsert_available(spark, drops, silver, work)
    want = {("AA", "2020-01-05", 20.0, 1), ("AA", "2020-01-06", 5.0, 1), ("AA", "2020-02-05", 10.0, 0), ("BB", "2020-01-05", 1.0, 0),
            ("AA", "None", 1.0, 0), ("AA", "None", 2.0, 0)}

    def rows():
        got = [(r.AIRPORT, str(r.DATE), r.ARR_TOTAL_FLIGHTS, r.LOADED) for r in spark.read.parquet(silver).collect()]
        assert len(got) == len(set(got))
        return set(got)
    assert rows() == want
    # February and the undated rows keep their files.
    after = files(silver)
    kept = {f for f in before if "MONTH=2" in f or "HIVE_DEFAULT" in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    # A replay with its marker is skipped, one without gives the same rows.
    batch = silver_frame(read_bronze_csv(spark, f"{drops}/2"))
    assert not upsert_batch(batch, 1, silver, work)
    os.rename(f"{work}/done/1", f"{work}/undone")
    assert upsert_batch(batch, 1, silver, work) and rows() == want
    assert read_silver(spark, silver).columns[0] == "AIRPORT"


def test_latest_load_wins_and_ties_are_settled(spark):
    d = dt.date(2020, 1, 1)
    data = [("A", d, 5.0, 1), ("A", d, 9.0, 2), ("A", d, 4.0, 2), ("A", None, 1.0, 1), ("A", None, 1.0, 2), ("A", None, 3.0, 1)]
    df = spark.createDataFrame(data, f"AIRPORT string, DATE date, v double, {LOADED} long")
    got = sorted(((r.DATE, r.v, r.LOADED) for r in latest_per_day(df).collect()), key=str)
    assert got == sorted([(d, 4.0, 2), (None, 1.0, 2), (None, 3.0, 1)], key=str)
    assert "Partial" in plan(latest_per_day(df))            # limited before the shuffle
    assert latest_per_day(df.limit(0)).count() == 0


# --- versions -----------------------------------------------------------------

def test_a_write_that_dies_leaves_the_table(spark, tmp_dir):
    table = f"{tmp_dir}/t"
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, table)
    assert snapshots.write_snapshot(spark.range(5), table) == 1

    def dies(path):
        spark.range(3).write.parquet(f"{path}/half")
        raise OSError("lost")
    with pytest.raises(OSError):
        snapshots.publish(spark, table, dies)
    failing = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("x")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="x"):
        snapshots.write_snapshot(failing, table)
    with pytest.raises(RuntimeError, match="not a finished write"):
        snapshots.publish(spark, table, lambda path: None)
    assert snapshots.versions(spark, table) == [1] and snapshots.read_snapshot(spark, table).count() == 5
    reader = snapshots.read_snapshot(spark, table)
    assert snapshots.write_snapshot(spark.range(8).withColumn("p", F.col("id") % 2), table, ("p",)) == 2
    assert reader.count() == 5                              # a reader of the old version is not disturbed
    assert snapshots.read_snapshot(spark, table).count() == 8 and snapshots.read_snapshot(spark, table, 1).count() == 5


def test_one_of_two_writers_wins(spark, tmp_dir):
    table = f"{tmp_dir}/t"

    def slow(path):
        snapshots.write_snapshot(spark.range(2), table)     # another writer is faster
        spark.range(9).write.parquet(path)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, table, slow)
    assert snapshots.read_snapshot(spark, table).count() == 2


def test_prune_keeps_the_latest(spark, tmp_dir):
    table = f"{tmp_dir}/t"
    for n in (1, 2, 3):
        snapshots.write_snapshot(spark.range(n), table)
    assert snapshots.prune(spark, table, keep=2) == [1] and snapshots.versions(spark, table) == [2, 3]
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, table, 1)
    assert snapshots.write_snapshot(spark.range(7), table) == 4


# --- quarantine ---------------------------------------------------------------

def test_lines_in_are_rows_kept_plus_rejects(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in/a")
    with open(f"{tmp_dir}/in/a/1.csv", "w") as f:
        f.write('x,y,z\n1,2,3\n1,2\n1,2,3,4\n,,\n"a,b",2,3\n')
    with open(f"{tmp_dir}/in/2.csv", "w") as f:
        f.write("x,y,z\n7,8,9\n7\n")
    good, bad = split_rejects(spark, f"{tmp_dir}/in", f"{tmp_dir}/work", ["x", "y", "z"])
    assert sorted(map(tuple, good.collect()), key=str) == sorted(
        [("1", "2", "3"), (None, None, None), ("a,b", "2", "3"), ("7", "8", "9")], key=str)
    assert sorted((r.line, r.file[-5:]) for r in bad.collect()) == [("1,2", "1.csv"), ("1,2,3,4", "1.csv"), ("7", "2.csv")]


# --- the forest's nodes -------------------------------------------------------

@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    m = DelayMart.of(spark, SF_SMALL)
    rows = m.split()
    train = rows.where(~F.col("is_test"))
    fitted = [model.fit_forest(train, m.feature_cols(), num_trees=5, max_depth=4, seed=s) for s in (1, 2)]
    path = str(tmp_path_factory.mktemp("forest"))
    for i, f in enumerate(fitted):
        model.save_model(f, f"{path}/{i}")
    return rows, fitted, path, m.feature_cols()


def test_walk_equals_the_model_and_tells_another(spark, forest):
    rows, fitted, path, cols = forest
    nodes = [foresttable.node_table(spark, f"{path}/{i}", cols) for i in (0, 1)]
    scored = fitted[0].transform(rows).select(S.ENTITY, "DATE", "prediction")

    def wrong(n, depth=4):
        j = scored.join(foresttable.walk(rows, n, cols, depth), [S.ENTITY, "DATE"], "left")
        return j.where("walked is null or abs(prediction - walked) > 1e-9").count()
    assert wrong(nodes[0]) == 0 and wrong(nodes[0], depth=6) == 0
    assert wrong(nodes[1]) > 0 and wrong(nodes[0], depth=2) > 0
    shuffled = [*cols[1:], cols[0]]
    assert scored.join(foresttable.walk(rows, nodes[0], shuffled, 4), [S.ENTITY, "DATE"]).where("abs(prediction - walked) > 1e-9").count() > 0


def test_importances_from_the_nodes(spark, forest):
    _, fitted, path, cols = forest
    got = {r.feature: r.walked_importance for r in foresttable.importances(foresttable.node_table(spark, f"{path}/0", cols)).collect()}
    want = dict(zip(cols, fitted[0].stages[-1].featureImportances.toArray().tolist(), strict=True))
    assert {c: got.get(c, 0.0) for c in cols} == pytest.approx(want, abs=1e-9)
