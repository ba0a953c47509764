"""Registered queries: one per operator of SURVEY section 2.

Each takes (spark, sf_dir) and returns a DataFrame over the whole input
tables (through the layers of :class:`DelayMart`). Means and other
order-dependent floating-point results are rounded to 6 digits here, in
the registered form only, so they compare exactly with the SQL oracle;
the operators themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaymart import schema as S
from delaymart.functions import columns as C
from delaymart.operators import anomaly, features, forecast, foresttable, interpret, model, observed, profile, report, sketches, validate
from delaymart.operators.silver import dedup_daily, entity_filter, read_silver, silver_frame, typed_bronze, year_range
from delaymart.plans.mart import DelayMart
from delaymart.plans.oracle import ON_SUPPLIERS
from delaymart.sinks import snapshots
from delaymart.sinks.writers import read_report_csv, register_views, write_report_csv
from delaymart.sources.bronze import read_bronze_csv, write_bronze_csv
from delaymart.sources.calendar import calendar_parts
from delaymart.sources.quarantine import split_rejects
from delaymart.sources.tables import table
from delaymart.streaming.upsert import upsert_available, upsert_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


# Parameters of the binding (FIXTURES.md): one entity's code and the history
# years of the forecast.
ENTITY_CODE, HISTORY = "BUILDING", (1998, 2001)


_BINDING: ContextVar[str] = ContextVar("binding", default="segments")


def mart(spark: SparkSession, sf_dir: str) -> DelayMart:
    return DelayMart.of(spark, sf_dir, history=HISTORY, binding=_BINDING.get())


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


PROFILE_MEANS = ("arrivals_avg_per_day", "avg_delay_min_mean")

# --- sources and sinks ------------------------------------------------------


@query
def csv_bronze_scan(spark, sf_dir):
    """The Bronze CSV tree read back, every column text."""
    return mart(spark, sf_dir).bronze()


@query
def silver_partition_roundtrip(spark, sf_dir):
    """K1 + S2: Silver written by YEAR/MONTH and read back."""
    return mart(spark, sf_dir).silver()


@query
def gold_roundtrip(spark, sf_dir):
    """K2 + S3: a Gold table written as Parquet and read back."""
    m = mart(spark, sf_dir)
    return r6(m.gold("eda_monthly", lambda: profile.delay_profile(m.silver(), ["YEAR", "MONTH"])),
              *PROFILE_MEANS)


@query
def calendar_grid(spark, sf_dir):
    """Every day from each entity's first to last day, with calendar
    columns (Sunday=1), and whether Silver has that day (a bit of its day maps,
    so copies of a day never multiply grid rows and no grid row is shuffled)."""
    grid = sketches.grid_from_days(sketches.year_days(mart(spark, sf_dir).silver()))
    return grid.select(S.ENTITY, "DATE", *calendar_parts("DATE"), "has_data")


@query
def report_csv_roundtrip(spark, sf_dir):
    """K4: the monthly-delay report table as CSV and read back."""
    m = mart(spark, sf_dir)
    t = r6(report.monthly_delay(report.silver_basic(m.silver())), "monthly_avg_delay_min")
    path = m._once("report_csv", lambda: write_report_csv(
        t, m.path("report", "silver_monthly_delay"), order_by=["airport", "year", "month"]))
    schema = T.StructType([T.StructField("airport", T.StringType()),
                           T.StructField("year", T.IntegerType()),
                           T.StructField("month", T.IntegerType()),
                           T.StructField("monthly_avg_delay_min", T.DoubleType())])
    return read_report_csv(spark, path, schema)


@query
def chart_series_monthly(spark, sf_dir):
    """K5: monthly series with a YYYY-MM label."""
    t = report.monthly_delay(report.silver_basic(mart(spark, sf_dir).silver()))
    return r6(report.chart_series(t, ["monthly_avg_delay_min"]), "monthly_avg_delay_min")


@query
def chart_days_per_year(spark, sf_dir):
    """K5: days per year."""
    return report.days_per_year(report.silver_basic(mart(spark, sf_dir).silver()))


CHART_VALIDATION = ("real_avg_delay_mean", "pred_avg_delay_mean", "mae_mean", "rmse")


@query
def chart_real_vs_predicted(spark, sf_dir):
    """K5: monthly real against predicted means (stub predictor)."""
    v = validate.validation_monthly(mart(spark, sf_dir).stub_validation_daily())
    return r6(report.chart_validation(v), *CHART_VALIDATION).select("airport", "year_month", *CHART_VALIDATION[:2])


@query
def chart_errors_monthly(spark, sf_dir):
    """K5: monthly MAE and RMSE (stub predictor)."""
    v = validate.validation_monthly(mart(spark, sf_dir).stub_validation_daily())
    return r6(report.chart_validation(v), *CHART_VALIDATION).select("airport", "year_month", *CHART_VALIDATION[2:])


@query
def chart_forecast_monthly(spark, sf_dir):
    """K5: the monthly forecast with its padded label (stub predictor)."""
    t = forecast.forecast_monthly(mart(spark, sf_dir).stub_forecast_daily()).withColumnRenamed(S.ENTITY, "airport")
    return r6(report.chart_series(t, ["pred_monthly_mean_delay_min"], y="YEAR", m="MONTH"),
              "pred_monthly_mean_delay_min")


@query
def chart_top_causes(spark, sf_dir):
    """K5 + T4: the 12 causes with the most minutes per entity."""
    ranked = report.causes_rank(mart(spark, sf_dir).causes())
    return r6(report.chart_top(ranked, 12, "total_minutes", "cause"), "avg_share")


@query
def gold_sql_view(spark, sf_dir):
    """K6: Gold tables as SQL views, queried with SQL."""
    m = mart(spark, sf_dir)
    register_views(spark, {"gold_causes": m.causes(), "gold_anomalies": m.anomalies()})
    return spark.sql("""
        SELECT a.AIRPORT AS airport, a.anomaly_type, count(*) AS n_rows,
               max(c.minutes) AS top_cause_minutes
        FROM gold_anomalies a
        JOIN (SELECT airport, max(minutes) AS minutes FROM gold_causes GROUP BY airport) c
          ON a.AIRPORT = c.airport
        GROUP BY a.AIRPORT, a.anomaly_type""")


@query
def streaming_silver_ingest(spark, sf_dir):
    """Bronze -> Silver as an incremental stream over the CSV tree, drained
    with an available-now trigger; the result equals batch Silver."""
    from delaymart.streaming.ingest import ingest_available
    m = mart(spark, sf_dir)
    path = m._once("stream_silver", lambda: ingest_available(
        spark, m.bronze_path(), m.path("stream", "silver"), m.path("stream", "_checkpoint")))
    from delaymart.operators.silver import read_silver
    return read_silver(spark, path)


def _drop(m: DelayMart, rows: DataFrame, name: str) -> str:
    return write_bronze_csv(rows, m.path("upsert", "drops", name))


@query
def silver_upsert(spark, sf_dir):
    """K1 + D1: Silver kept by upserts of two drops of files. The second corrects
    every seventh day of the month; its batch is then replayed. One row a day stays,
    the corrected one where there is one."""
    m = mart(spark, sf_dir)

    def build():
        first = m.bronze()
        silver, work, drops = m.path("upsert", "silver"), m.path("upsert", "work"), m.path("upsert", "drops")
        _drop(m, first, "first")
        upsert_available(spark, drops, silver, work)
        day = F.substring("FLT_DATE", 9, 2).cast("int")
        second = first.where(day % 7 == 0).withColumn("FLT_ARR_1", F.concat("FLT_ARR_1", F.lit("0")))
        _drop(m, second, "second")
        upsert_available(spark, drops, silver, work)
        again = silver_frame(read_bronze_csv(spark, m.path("upsert", "drops", "second")))
        if upsert_batch(again, 1, silver, work):
            raise RuntimeError("a finished batch was merged twice")
        return silver
    return read_silver(spark, m._once("upsert_silver", build))


def _torn_tree(m: DelayMart) -> str:
    """Bronze files in which the lines of every 13th of a month are malformed: too
    short in odd months, too long in even ones."""
    b = m.bronze()
    path = m.path("torn")
    torn = F.coalesce(F.substring("FLT_DATE", 9, 2) == "13", F.lit(False))
    write_bronze_csv(b.where(~torn), f"{path}/good")
    short = F.substring("FLT_DATE", 6, 2).cast("int") % 2 == 1
    cells = [F.coalesce(F.col(c), F.lit("")) for c in b.columns]
    lines = b.where(torn).select(F.when(short, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells, F.lit("x"))).alias("value"))
    lines = lines.select(F.lit(1).alias("at"), F.pmod(F.xxhash64("value"), F.lit(8)).alias("part"), "value")
    heads = m.spark.range(8).select(F.lit(0).alias("at"), F.col("id").alias("part"), F.lit(",".join(b.columns)).alias("value"))
    (heads.unionByName(lines).repartition("part").sortWithinPartitions("part", "at")
     .select("part", "value").write.mode("overwrite").partitionBy("part").text(f"{path}/torn"))
    return path


def _quarantined(m: DelayMart) -> tuple[DataFrame, DataFrame]:
    path = m._once("torn_tree", lambda: _torn_tree(m))
    return m._once("torn_split", lambda: split_rejects(m.spark, path, m.path("quarantine")))


@query
def bronze_quarantine(spark, sf_dir):
    """S1 with quarantine: the well-formed lines of a tree with torn ones."""
    return _quarantined(mart(spark, sf_dir))[0]


@query
def bronze_rejects(spark, sf_dir):
    """S1 with quarantine: the malformed lines, each with the file it came from."""
    bad = _quarantined(mart(spark, sf_dir))[1]
    return bad.select("line", F.col("file").contains("/torn/").alias("from_torn"))


@query
def snapshot_previous(spark, sf_dir):
    """K2 published as versions: the first version of a table, read after a second
    was published and a third write died half-way."""
    m = mart(spark, sf_dir)

    def build():
        table_dir = m.path("snapshots", "eda_monthly")
        rows = r6(profile.delay_profile(m.silver(), ["YEAR", "MONTH"]), *PROFILE_MEANS)
        first = snapshots.write_snapshot(rows, table_dir)
        second = snapshots.write_snapshot(rows.where("YEAR > 1995"), table_dir)

        def dies(path: str) -> None:
            rows.limit(10).write.parquet(f"{path}/part")
            raise OSError("the writer was lost")
        try:
            snapshots.publish(spark, table_dir, dies)
        except OSError:
            pass
        if snapshots.versions(spark, table_dir)[-1] != second:
            raise RuntimeError("a write that died was published")
        return table_dir, first
    return snapshots.read_snapshot(spark, *m._once("snapshots", build))


# --- projections and predicates --------------------------------------------


@query
def normalize_code(spark, sf_dir):
    """P1 on part brands (``Brand#13`` -> ``BRAND13``)."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return p.select("p_partkey", "p_brand", C.normalize_code("p_brand").alias("brand_code"))


@query
def entity_filter_building(spark, sf_dir):
    """One entity's rows (pushed into the Parquet scan)."""
    return entity_filter(mart(spark, sf_dir).silver(), S.ENTITY, [ENTITY_CODE])


@query
def safe_numeric_cast(spark, sf_dir):
    """Numeric text to double, bad text to null."""
    b = mart(spark, sf_dir).bronze()
    num = S.present(S.BASE_NUM_COLS + S.CAUSE_COLS + [S.TOTAL_COL], b.columns)
    return b.select("APT_ICAO", "FLT_DATE", *[C.safe_double(c).alias(c) for c in num])


@query
def parse_dual_timestamp(spark, sf_dir):
    """P4 + P5: two timestamp layouts, first success wins; date and the
    instant as epoch seconds."""
    b = mart(spark, sf_dir).bronze()
    ts = C.dual_timestamp("FLT_DATE")
    return b.select("APT_ICAO", "FLT_DATE", F.unix_seconds(ts).alias("epoch_s"),
                    C.to_day(ts).alias("DATE"))


@query
def calendar_parts_lineitem(spark, sf_dir):
    """P6-P8 on every line item's ship date."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    d = F.to_date("l_shipdate")
    return li.select("l_orderkey", "l_linenumber", d.alias("DATE")).select(
        "l_orderkey", "l_linenumber", "DATE", F.year("DATE").alias("YEAR"),
        F.month("DATE").alias("MONTH"), C.iso_weekday("DATE").alias("DOW_ISO"),
        C.sunday_weekday("DATE").alias("DOW_SUN1"), F.dayofmonth("DATE").alias("DOM"),
        F.weekofyear("DATE").alias("WOY"))


def _typed(spark, sf_dir):
    t = typed_bronze(mart(spark, sf_dir).bronze())
    causes = S.present(S.CAUSE_COLS, t.columns)
    return t, causes


@query
def row_sum_causes(spark, sf_dir):
    """Sum of the cause columns, null as zero."""
    t, causes = _typed(spark, sf_dir)
    return t.select("APT_ICAO", "FLT_DATE", C.row_sum(causes).alias("cause_sum"))


@query
def total_delay_fallback(spark, sf_dir):
    """P10: the explicit total, else the cause sum."""
    t, causes = _typed(spark, sf_dir)
    return t.select("APT_ICAO", "FLT_DATE", S.TOTAL_COL, C.row_sum(causes).alias("cause_sum"),
                    C.total_with_fallback(S.TOTAL_COL, causes).alias("TOTAL_DELAY_MIN"))


@query
def guarded_ratio(spark, sf_dir):
    """Average delay only where flights > 0."""
    t, causes = _typed(spark, sf_dir)
    tot = C.total_with_fallback(S.TOTAL_COL, causes)
    return t.select("APT_ICAO", "FLT_DATE", F.col("FLT_ARR_1").alias("ARR_TOTAL_FLIGHTS"),
                    tot.alias("TOTAL_DELAY_MIN"),
                    C.guarded_ratio(tot, "FLT_ARR_1").alias(S.LABEL))


@query
def silver_daily(spark, sf_dir):
    """The Silver contract straight from the Bronze scan (unwritten)."""
    return mart(spark, sf_dir).silver_unwritten()


@query
def year_range_filter(spark, sf_dir):
    """The forecast history window; prunes YEAR partitions."""
    m = mart(spark, sf_dir)
    return year_range(m.silver(), *m.history)


@query
def feature_table(spark, sf_dir):
    """M1 + P16 + P17 + D1."""
    return mart(spark, sf_dir).features()


@query
def anomaly_severity(spark, sf_dir):
    """P18 on every day: grade against the entity's p95 / p99."""
    m = mart(spark, sf_dir)
    s, th = m.silver(), m.thresholds()
    return (s.join(th, S.ENTITY, "left")
            .select(S.ENTITY, "DATE", S.LABEL, "p95", "p99",
                    C.severity(S.LABEL, "p95", "p99").alias("severity")))


@query
def forecast_inputs(spark, sf_dir):
    """S5 + J2 + P20 + P21: model inputs for each day of the target year."""
    return mart(spark, sf_dir).forecast_inputs()


# --- joins -----------------------------------------------------------------


@query
def validation_daily(spark, sf_dir):
    """J1 + P19 with the stub predictor."""
    return r6(mart(spark, sf_dir).stub_validation_daily(), "prediction", "error_min",
              "abs_error_min")


def _counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Observed counts as a table of one row."""
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@query
def observed_silver_counts(spark, sf_dir):
    """P3 + P4 + K1: what the pass that writes Silver took in, lost and wrote."""
    m = mart(spark, sf_dir)
    return _counts(spark, observed.write_silver_observed(m.bronze(), m.path("silver_observed")))


@query
def observed_validation_counts(spark, sf_dir):
    """Q1 without a second join: days of each side and matched days, observed by the
    pass that writes the validation (stub predictor)."""
    m = mart(spark, sf_dir)
    return _counts(spark, observed.write_validation_observed(
        m.silver(), m.stub_predictions_full(), m.path("validation_observed")))


@query
def validation_bucketed(spark, sf_dir):
    """J1 + D2 + P19 on bucketed sides (stub predictor): no exchange in dedup or join."""
    root = mart(spark, sf_dir).bucketed_sides()
    return r6(validate.validation_bucketed(spark, root), "prediction", "error_min", "abs_error_min")


@query
def join_coverage(spark, sf_dir):
    """Q1: rows on both sides of the validation join and after it."""
    m = mart(spark, sf_dir)
    return validate.join_coverage(m.silver(), m.stub_predictions_full())


# --- aggregations ----------------------------------------------------------


@query
def eda_overall(spark, sf_dir):
    """A1."""
    return r6(profile.delay_profile(mart(spark, sf_dir).silver()), *PROFILE_MEANS)


@query
def eda_yearly(spark, sf_dir):
    """A2."""
    return r6(profile.delay_profile(mart(spark, sf_dir).silver(), ["YEAR"]), *PROFILE_MEANS)


@query
def eda_monthly(spark, sf_dir):
    """A3 + A8."""
    return r6(profile.delay_profile(mart(spark, sf_dir).silver(), ["YEAR", "MONTH"]),
              *PROFILE_MEANS)


@query
def eda_weekday(spark, sf_dir):
    """A4."""
    return r6(profile.weekday_profile(mart(spark, sf_dir).silver()), *PROFILE_MEANS)


@query
def days_per_year_quality(spark, sf_dir):
    """A5."""
    return profile.days_per_year_quality(mart(spark, sf_dir).silver())


@query
def data_range(spark, sf_dir):
    """A6."""
    return profile.data_range(mart(spark, sf_dir).silver())


@query
def causes_wide(spark, sf_dir):
    """A7."""
    return profile.causes_wide(mart(spark, sf_dir).silver())


@query
def causes_long(spark, sf_dir):
    """U3 + U4 (+ J3 as a window on the small long table)."""
    return mart(spark, sf_dir).causes()


@query
def causes_long_compat(spark, sf_dir):
    """U3 + U4 with the grand total listed as a cause, as originally."""
    return profile.causes_long(mart(spark, sf_dir).silver(), include_total=True)


@query
def anomaly_thresholds(spark, sf_dir):
    """A9."""
    return mart(spark, sf_dir).thresholds()


@query
def anomaly_thresholds_compat(spark, sf_dir):
    """A9 with the original's 1 % relative error (sketch accuracy 100); an
    approximation, so it has no exact oracle."""
    return anomaly.thresholds(mart(spark, sf_dir).silver(), accuracy=100)


@query
def anomaly_thresholds_compat_rank(spark, sf_dir):
    """A9 checked: each approximate threshold's true rank among the entity's n
    values lies from floor((q - 0.01) n) to ceil((q + 0.01) n), as promised."""
    s = mart(spark, sf_dir).silver()
    th = anomaly.thresholds(s, accuracy=100)
    v = s.where(F.col(S.LABEL).isNotNull()).join(th, S.ENTITY)
    n = F.count("*")

    def near(c: str, percent: int):
        below, upto = F.count(F.when(F.col(S.LABEL) < F.col(c), 1)), F.count(F.when(F.col(S.LABEL) <= F.col(c), 1))
        return (below <= F.ceil((percent + 1) * n / 100)) & (upto >= F.floor((percent - 1) * n / 100))

    return v.groupBy(S.ENTITY).agg(near("p95", 95).alias("p95_near"), near("p99", 99).alias("p99_near"))


def _near(values: DataFrame, at: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Whether each quantile's true rank among the group's values is within the
    stated error of a stored sketch."""
    e = sketches.rank_error()
    n = F.count("*")

    def near(c: str, q: float):
        below, upto = F.count(F.when(F.col(S.LABEL) < F.col(c), 1)), F.count(F.when(F.col(S.LABEL) <= F.col(c), 1))
        return (below <= F.ceil((q + e) * n)) & (upto >= F.floor((q - e) * n))

    v = values.where(F.col(S.LABEL).isNotNull()).select(*keys, S.LABEL).join(at, keys)
    return v.groupBy(*keys).agg(n.alias("n_values"), *[near(c, q).alias(f"{c}_near") for c, q in quantiles.items()])


def _month_cells(m: DelayMart) -> DataFrame:
    """The stored cells, from two loads merged."""
    first, second = F.coalesce(F.col("MONTH") <= 6, F.lit(False)), ~F.coalesce(F.col("MONTH") <= 6, F.lit(False))
    return m.gold("month_cells", lambda: sketches.merge_months(
        sketches.month_sketches(m.silver().where(first)), sketches.month_sketches(m.silver().where(second))))


@query
def eda_yearly_from_cells(spark, sf_dir):
    """A2 from the stored month cells alone: exact counts, sums and maxima (the
    sketched median is checked by ``sketch_quantiles_rank``)."""
    out = sketches.profile_from_cells(_month_cells(mart(spark, sf_dir)), ["YEAR"])
    return r6(out, *PROFILE_MEANS).drop("avg_delay_min_median")


@query
def sketch_quantiles_rank(spark, sf_dir):
    """A8 + A9 from stored sketches: median, p95 and p99 of each entity, merged from
    its month cells, have true ranks within the sketch's stated error."""
    m = mart(spark, sf_dir)
    cells = _month_cells(m)
    at = sketches.thresholds_from_cells(cells).join(
        sketches.profile_from_cells(cells).select(F.col("airport").alias(S.ENTITY), F.col("avg_delay_min_median").alias("p50")),
        S.ENTITY)
    return _near(m.silver(), at, [S.ENTITY], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def _day_maps(m: DelayMart) -> DataFrame:
    """Day maps of two loads that share the days of four months, merged."""
    s = m.silver()
    return m.gold("year_days", lambda: sketches.merge_days(
        sketches.year_days(s.where(F.col("MONTH") <= 8)), sketches.year_days(s.where(F.col("MONTH") >= 5))))


@query
def days_per_year_merged(spark, sf_dir):
    """A5 from day maps of two overlapping loads: rows of both, distinct days exact."""
    return sketches.days_per_year(_day_maps(mart(spark, sf_dir)))


@query
def data_range_merged(spark, sf_dir):
    """A6 + D3 from the merged day maps: first and last day, distinct days, years."""
    return sketches.range_from_days(_day_maps(mart(spark, sf_dir)))


@query
def seasonal_baseline(spark, sf_dir):
    """A10."""
    m = mart(spark, sf_dir)
    cols = m.feature_cols()
    return forecast.seasonal_baseline(forecast.history(m.silver(), *m.history, cols), cols)


@query
def global_means(spark, sf_dir):
    """A11."""
    m = mart(spark, sf_dir)
    cols = m.feature_cols()
    return forecast.global_means(forecast.history(m.silver(), *m.history, cols), cols, keys=m.silver())


@query
def validation_monthly(spark, sf_dir):
    """A12 (stub predictor)."""
    d = mart(spark, sf_dir).stub_validation_daily()
    return r6(validate.validation_monthly(d), "real_avg_delay_mean", "pred_avg_delay_mean",
              "mae_mean", "rmse")


@query
def report_days_per_year(spark, sf_dir):
    """A14."""
    return report.days_per_year(report.silver_basic(mart(spark, sf_dir).silver()))


@query
def report_monthly_delay(spark, sf_dir):
    """A15."""
    return r6(report.monthly_delay(report.silver_basic(mart(spark, sf_dir).silver())),
              "monthly_avg_delay_min")


@query
def report_causes_rank(spark, sf_dir):
    """A16."""
    return r6(report.causes_rank(mart(spark, sf_dir).causes()), "avg_share")


@query
def report_anomalies_monthly(spark, sf_dir):
    """A17."""
    rows = report.anomaly_rows(mart(spark, sf_dir).anomalies())
    return r6(report.anomalies_monthly(rows), "avg_delay_on_anomaly_days")


@query
def report_validation_monthly(spark, sf_dir):
    """P15 projection of the monthly validation (stub predictor)."""
    d = mart(spark, sf_dir).stub_validation_daily()
    v = validate.validation_monthly(d).withColumnsRenamed({"YEAR": "year", "MONTH": "month"})
    return r6(report.validation_report(v), "real_avg_delay_mean", "pred_avg_delay_mean",
              "mae_mean", "rmse")


# --- dedup, distinct, top-k, union -----------------------------------------


@query
def dedup_daily_copies(spark, sf_dir):
    """Silver with every day loaded twice (a re-run ingest), reduced to
    one deterministic row per (entity, day)."""
    m = mart(spark, sf_dir)
    twice = m.silver().unionByName(m.silver_unwritten())
    return dedup_daily(twice, [S.ENTITY, "DATE"])


@query
def distinct_years(spark, sf_dir):
    """D3."""
    return profile.distinct_years(mart(spark, sf_dir).silver())


@query
def top_avg_delay(spark, sf_dir):
    """T1."""
    return anomaly.top_days(mart(spark, sf_dir).silver(), S.LABEL)


@query
def top_total_delay(spark, sf_dir):
    """T2."""
    return anomaly.top_days(mart(spark, sf_dir).silver(), "TOTAL_DELAY_MIN")


@query
def top_total_delay_overall(spark, sf_dir):
    """T2 without a key: the 30 days with the largest total of all entities."""
    return anomaly.top_days(mart(spark, sf_dir).silver(), "TOTAL_DELAY_MIN", by=())


@query
def p95_outliers(spark, sf_dir):
    """U2."""
    m = mart(spark, sf_dir)
    return anomaly.p95_outliers(m.silver(), m.thresholds())


@query
def anomalies(spark, sf_dir):
    """U1 + P18: the anomaly Gold table."""
    return mart(spark, sf_dir).anomalies()


@query
def report_anomalies_top(spark, sf_dir):
    """T3."""
    return report.anomalies_top(report.anomaly_rows(mart(spark, sf_dir).anomalies()))


# --- model ------------------------------------------------------------------


@query
def split_mode(spark, sf_dir):
    """M2 + M3: split mode and test year per entity."""
    return features.split_plan(mart(spark, sf_dir).features())


@query
def random_split_sides(spark, sf_dir):
    """M3 with Spark's sampler: for each day the number of sides that hold it, and
    whether the test share is within five standard deviations of 20 %."""
    m = mart(spark, sf_dir)
    sides = features.random_sides(m.features().select(S.ENTITY, "DATE"))
    n, share = F.sum("n"), F.sum("n_test") / F.sum("n")
    per = sides.groupBy(S.ENTITY, "DATE").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test"))
    total = per.agg((F.abs(share - 0.2) <= 5 * F.sqrt(F.lit(0.2 * 0.8) / n)).alias("share_ok"))
    return per.crossJoin(F.broadcast(total)).select(S.ENTITY, "DATE", F.col("n").alias("sides"), "share_ok")


@query
def time_split_counts(spark, sf_dir):
    """M2 + M3: train / test rows per entity."""
    return features.split_counts(mart(spark, sf_dir).split())


@query
def stub_predictions_full(spark, sf_dir):
    """M7 contract with the stub predictor, every feature row."""
    return r6(mart(spark, sf_dir).stub_predictions_full(), "prediction")


@query
def regression_metrics(spark, sf_dir):
    """M8 in SQL form on the stub predictor's test rows."""
    m = mart(spark, sf_dir)
    test = model.stub_predict(m.split().where(F.col("is_test")), m.stub())
    return r6(model.regression_metrics(test), "rmse", "r2")


@query
def model_predictions(spark, sf_dir):
    """M6 + M7: forest predictions on the test rows."""
    return mart(spark, sf_dir).forest_predictions_test()


@query
def model_predictions_full(spark, sf_dir):
    """M7: forest predictions on every day."""
    return mart(spark, sf_dir).forest_predictions_full()


@query
def model_metrics(spark, sf_dir):
    """M8 + M9: RMSE, R2, split mode per entity."""
    return mart(spark, sf_dir).forest_metrics()


def _nodes(m: DelayMart) -> DataFrame:
    """The saved forest's nodes, written once."""
    return m.gold("forest_nodes", lambda: foresttable.node_table(m.spark, m.forest_path(), m.feature_cols()))


def _agrees(m: DelayMart, scored: DataFrame, inputs: DataFrame, col: str) -> DataFrame:
    """Whether ``col`` is the mean of the leaves that the row's inputs reach in the
    node table; a row without a walk does not agree."""
    walked = foresttable.walk(inputs, _nodes(m), m.feature_cols(), m.max_depth)
    same = F.coalesce(F.abs(F.col(col) - F.col("walked")) < 1e-9, F.lit(False))
    return scored.join(walked, [S.ENTITY, "DATE"], "left").withColumn("agrees", same).drop("walked")


@query
def model_predictions_checked(spark, sf_dir):
    """M7 checked: every test prediction equals the walk through the saved forest's
    node table."""
    m = mart(spark, sf_dir)
    rows = m.model_rows().where(F.col("is_test"))
    return _agrees(m, m.forest_predictions_test(), rows, "prediction").drop("prediction")


@query
def model_predictions_full_checked(spark, sf_dir):
    """M7 checked on every day of every entity."""
    m = mart(spark, sf_dir)
    return _agrees(m, m.forest_predictions_full(), m.model_rows(), "prediction").drop("prediction")


@query
def model_metrics_checked(spark, sf_dir):
    """M8 + M9 checked: each metric row against one recomputed from the
    written predictions by its plain definition."""
    m = mart(spark, sf_dir)
    p = m.forest_predictions_test()
    mean = p.groupBy(S.ENTITY).agg(F.avg(S.LABEL).alias("mean"))
    sse, sst = F.pow(F.col("prediction") - F.col(S.LABEL), 2.0), F.pow(F.col(S.LABEL) - F.col("mean"), 2.0)
    again = p.join(mean, S.ENTITY).groupBy(S.ENTITY).agg(
        F.sqrt(F.sum(sse) / F.count("*")).alias("RMSE"), (1 - F.sum(sse) / F.sum(sst)).alias("R2"))
    rows = m.forest_metrics().join(again, S.ENTITY)
    want = F.when(F.col("metric") == "RMSE", F.col("RMSE")).when(F.col("metric") == "R2", F.col("R2")).otherwise(0.0)
    return rows.select(S.ENTITY, "metric", "info", (F.abs(F.col("value") - want) < 1e-6).alias("agrees"))


@query
def model_validation_checked(spark, sf_dir):
    """J1 + P19 + A12 checked on the forest: every day's error identities, and
    each month's table against the daily one."""
    m = mart(spark, sf_dir)
    d, v = m.forest_validation_daily(), m.forest_validation_monthly()
    err = F.col("prediction") - F.col(S.LABEL)
    same = (F.abs(F.col("error_min") - err) < 1e-9) & (F.abs(F.col("abs_error_min") - F.abs(err)) < 1e-9)
    keys = [S.ENTITY, "YEAR", "MONTH"]
    again = d.groupBy(*keys).agg(
        F.count("*").alias("days"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rms"),
        F.bool_and(same).alias("errors_agree"))
    return v.join(again, keys).select(
        *keys, "days_count", "errors_agree", ((F.col("days_count") == F.col("days"))
                                               & (F.abs(F.col("mae_mean") - F.col("mae")) < 1e-9)
                                               & (F.abs(F.col("rmse") - F.col("rms")) < 1e-9)).alias("month_agrees"))


@query
def single_tree_predictions(spark, sf_dir):
    """M4-M7 made exact: the same pipeline code with one tree of depth 1 on
    MONTH, no bootstrap; its best split and side means are plain SQL."""
    m = mart(spark, sf_dir)
    rows = m.model_rows()
    tree = model.fit_forest(rows.where(~F.col("is_test")), ["MONTH"], num_trees=1, max_depth=1,
                            bootstrap=False, subset="all")
    return r6(model.prediction_table(tree.transform(rows)), "prediction")


@query
def model_validation_daily(spark, sf_dir):
    """J1 + P19 on the forest's predictions for every day (raises if the
    join is empty)."""
    return mart(spark, sf_dir).forest_validation_daily()


@query
def model_validation_monthly(spark, sf_dir):
    """A12 on the forest's predictions."""
    return mart(spark, sf_dir).forest_validation_monthly()


@query
def feature_importance(spark, sf_dir):
    """M10."""
    return mart(spark, sf_dir).feature_importance()


@query
def feature_importance_checked(spark, sf_dir):
    """M10 + M11 checked: each feature's importance equals the one summed from the
    gains in the node table, and its percentage that times 100."""
    m = mart(spark, sf_dir)
    again = foresttable.importances(_nodes(m))
    rows = m.interpretation().join(again, "feature", "left")
    want = F.coalesce("walked_importance", F.lit(0.0))
    return rows.select("feature", (F.abs(F.col("importance") - want) < 1e-9).alias("agrees"),
                       (F.abs(F.col("importance_pct") - 100 * want) < 1e-6).alias("percent_agrees"))


@query
def importance_pct(spark, sf_dir):
    """M11 on the forest's importances."""
    return mart(spark, sf_dir).interpretation()


@query
def importance_pct_stub(spark, sf_dir):
    """M11 + A18 on a stub importance table: mean absolute value of each
    feature over the feature rows."""
    m = mart(spark, sf_dir)
    f = m.features()
    cols = m.feature_cols()
    fi = (f.select(*[F.abs(F.col(c)).alias(c) for c in cols])
          .unpivot([], cols, "feature", "v")
          .groupBy("feature").agg(F.avg("v").alias("importance")))
    return r6(interpret.importance_pct(fi), "importance_pct")


@query
def model_roundtrip(spark, sf_dir):
    """K3 + S4: the saved and reloaded pipeline predicts what the fitted one
    did, with the input columns read from the loaded model."""
    m = mart(spark, sf_dir)
    fitted, loaded = m.forest_fitted(), m.forest_loaded()
    rows = m.model_rows()
    a = fitted.transform(rows).select(S.ENTITY, "DATE", F.col("prediction").alias("fitted"))
    b = loaded.transform(rows).select(S.ENTITY, "DATE", F.col("prediction").alias("loaded"))
    n_inputs = len(model.model_input_cols(loaded))
    return a.join(b, [S.ENTITY, "DATE"]).select(
        S.ENTITY, "DATE", (F.col("fitted") == F.col("loaded")).alias("same"), F.lit(n_inputs).alias("n_inputs"))


@query
def forecast_daily(spark, sf_dir):
    """M12 with the forest."""
    return mart(spark, sf_dir).forest_forecast_daily()


@query
def forecast_monthly(spark, sf_dir):
    """A13 with the forest."""
    return mart(spark, sf_dir).forest_forecast_monthly()


@query
def forecast_checked(spark, sf_dir):
    """M12 + A13 checked on the forest: every entity and day of the year, equal to the
    walk of its inputs through the node table, and its month's table against the days."""
    m = mart(spark, sf_dir)
    d = _agrees(m, m.forest_forecast_daily(), m.forecast_inputs(m.feature_cols()), "pred_avg_arr_delay_min")
    keys = [S.ENTITY, "YEAR", "MONTH"]
    again = d.groupBy(*keys).agg(F.avg("pred_avg_arr_delay_min").alias("mean"), F.count("*").alias("days"))
    v = m.forest_forecast_monthly().join(again, keys).select(
        *keys, ((F.abs(F.col("pred_monthly_mean_delay_min") - F.col("mean")) < 1e-9)
                & (F.col("days_count") == F.col("days"))).alias("month_agrees"))
    return d.join(v, keys).select(S.ENTITY, "DATE", "YEAR", "MONTH", "DOW", "agrees", "month_agrees")


@query
def forecast_daily_stub(spark, sf_dir):
    """M12 with the stub predictor."""
    return r6(mart(spark, sf_dir).stub_forecast_daily(), "pred_avg_arr_delay_min")


@query
def forecast_monthly_stub(spark, sf_dir):
    """A13 with the stub predictor."""
    return r6(forecast.forecast_monthly(mart(spark, sf_dir).stub_forecast_daily()),
              "pred_monthly_mean_delay_min")


@query
def report_feature_importance(spark, sf_dir):
    """Top 200 importances by percent (forest)."""
    return report.importance_report(mart(spark, sf_dir).interpretation())


@query
def importance_reports_checked(spark, sf_dir):
    """T3 + T4 checked on the forest: the report holds every feature once in
    descending order of percent, and the chart its first 15."""
    i = mart(spark, sf_dir).interpretation()
    top = report.chart_top(report.importance_report(i), 15, "importance_pct", "feature", by=())
    low = top.agg(F.min("importance_pct").alias("low"), F.count("*").alias("n"))
    rows = report.importance_report(i).crossJoin(F.broadcast(low))
    above = F.count(F.when(F.col("importance_pct") > F.col("low"), 1))
    return rows.groupBy("n").agg(F.count("*").alias("n_report"), (above < 15).alias("top_is_first")).select(
        F.col("n").alias("n_chart"), "n_report", "top_is_first")


@query
def chart_top_features(spark, sf_dir):
    """T4: top 15 features for the chart (forest)."""
    fi = report.importance_report(mart(spark, sf_dir).interpretation())
    return report.chart_top(fi, 15, "importance_pct", "feature", by=())


# --- the same operators on the dirty binding that grows with the data ---------

def _on_suppliers(fn: Query) -> Query:
    def run(spark, sf_dir):
        token = _BINDING.set("suppliers")
        try:
            return fn(spark, sf_dir)
        finally:
            _BINDING.reset(token)
    run.__doc__ = f"{fn.__doc__} On the supplier binding."
    run.__name__ = f"suppliers_{fn.__name__}"
    return run


for _name in ON_SUPPLIERS:
    query(_on_suppliers(QUERIES[_name]))
