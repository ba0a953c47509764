"""Bronze -> Silver.

The whole cleaning step is a single projection over the CSV scan: no
shuffle, one narrow stage. Writing clusters rows by YEAR, MONTH and splits
large months over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.functions import columns as C


def typed_bronze(bronze: DataFrame) -> DataFrame:
    """P1 + P3 + P4/P5: normalized code, numeric columns cast if present,
    parsed timestamp and date; other columns pass through."""
    numeric = set(S.present(S.BASE_NUM_COLS + S.CAUSE_COLS + [S.TOTAL_COL],
                            bronze.columns))
    out = []
    for c in bronze.columns:
        if c == "APT_ICAO":
            out.append(C.normalize_code("APT_ICAO").alias("APT_ICAO"))
        elif c in numeric:
            out.append(C.safe_double(c).alias(c))
        else:
            out.append(F.col(c))
    if "FLT_DATE" in bronze.columns:
        out.append(C.dual_timestamp("FLT_DATE").alias("DATE_TS"))
    return bronze.select(*out)


def silver_frame(bronze: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """P1-P12 as one select: Bronze text rows to the Silver daily contract.

    ``entities`` keeps only those codes (the single-airport filter is
    ``entities=["EDDF"]``); by default every non-empty code is kept, so one
    run serves all entities.
    """
    S.require(bronze, ["APT_ICAO", "FLT_DATE"], "Bronze")
    t = typed_bronze(bronze)
    causes = [c for c in S.present(S.CAUSE_COLS, t.columns)]
    total = S.TOTAL_COL if S.TOTAL_COL in t.columns else None
    d = F.to_date("DATE_TS")
    total_delay = C.total_with_fallback(total, causes)
    flights = F.col("FLT_ARR_1") if "FLT_ARR_1" in t.columns else F.lit(None).cast("double")
    named = {
        "AIRPORT": F.col("APT_ICAO"),
        "DATE": d,
        "YEAR": F.year(d),
        "MONTH": F.month(d),
        "DOW": C.iso_weekday(d),
        "ARR_TOTAL_FLIGHTS": flights,
        "TOTAL_DELAY_MIN": total_delay,
        "AVG_ARR_DELAY_MIN": C.guarded_ratio(total_delay, flights),
    }
    for c in ["FLT_ARR_1_DLY", "FLT_ARR_1_DLY_15"] + causes + ([total] if total else []):
        if c in t.columns:
            named[c] = F.col(c)
    t = entity_filter(t, "APT_ICAO", entities)
    return t.select(*[named[c].alias(c) for c in S.SILVER_ORDER if c in named])


def entity_filter(df: DataFrame, col: str = S.ENTITY,
                  entities: Sequence[str] | None = None) -> DataFrame:
    """Keep the listed codes (nulls drop); with no list keep non-empty
    codes. A plain comparison, so Parquet scans get it as a pushed filter."""
    if entities:
        return df.where(F.col(col).isin(list(entities)))
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def year_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive YEAR range; on Silver it prunes YEAR partitions."""
    return df.where(F.col("YEAR").between(start, end))


def dedup_daily(df: DataFrame, keys: Sequence[str] = (S.ENTITY, "DATE"),
                order: Sequence[str] | None = None) -> DataFrame:
    """One row per key with a deterministic survivor: the first row
    under a total order over the remaining columns (nulls first).

    ``row_number() <= 1`` is planned with a partial WindowGroupLimit before
    the exchange, so a key with a huge number of copies sends at most one row
    per map task into the shuffle."""
    keys = list(keys)
    order = list(order) if order is not None else [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_silver(df: DataFrame, path: str, dynamic: bool = False,
                 max_records_per_file: int = 5_000_000) -> str:
    """K1: Parquet partitioned by YEAR, MONTH.

    Static overwrite (default) replaces the whole tree; ``dynamic=True``
    replaces only the partitions present in ``df``. The rebalance hint
    clusters rows on (YEAR, MONTH) and lets AQE merge small months and split
    large ones at the advisory partition size, so neither a hot month nor the
    rows without a date meet in one task. Rows are then sorted by entity and
    date inside each task, so the AIRPORT/DATE min-max stats prune row groups."""
    w = (df.hint("rebalance", F.col("YEAR"), F.col("MONTH"))
           .sortWithinPartitions("YEAR", "MONTH", S.ENTITY, "DATE")
           .write.mode("overwrite")
           .option("maxRecordsPerFile", max_records_per_file))
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("YEAR", "MONTH").parquet(path)
    return path


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """Partitioned Parquet scan; columns back in contract order (the
    partition columns come last from discovery)."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in S.SILVER_ORDER if c in df.columns])
