"""Incremental upsert of Silver from a stream of Bronze files (K1 + D1).

Each micro-batch brings files that may correct days loaded before. The batch is
cleaned as in the batch path, reduced to one row per (entity, day), and merged
into the Silver tree: of all rows of a day the one with the latest load wins, so a
corrected file replaces what it corrects and a repeated file changes nothing.

* Only the YEAR/MONTH partitions that the batch touches are read and rewritten
  (dynamic partition overwrite of rows staged outside the tree); all others keep
  their files. The partition list is a semi-join key with a pruning filter of at
  most one value per touched month, not a list of rows.
* Rows carry ``LOADED`` (the batch id) in Silver, so a row's origin is known and
  the order of loads is part of the data, not of file times.
* Batch ids make it idempotent: a finished batch leaves a marker, written last. A
  replayed batch with a marker is skipped; one without is simply done again, which
  gives the same rows (a tie in ``LOADED`` is settled by the rows' own values).

Rows without a date cannot be corrected by day; all distinct ones are kept, in the
partition of undated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.operators.silver import silver_frame
from delaymart.operators.anomaly import top_k
from delaymart.sinks import manifest
from delaymart.streaming.ingest import bronze_stream

LOADED = "LOADED"
KEYS = (S.ENTITY, "DATE")


def latest_per_day(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """D1 with an order of loads: per (entity, day) the row of the latest load, of
    equal loads the first in the order of its values; undated rows once each.
    ``row_number() <= 1`` limits each task's rows before the shuffle."""
    values = [c for c in rows.columns if c not in (*keys, LOADED)]
    order = [F.col(LOADED).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in values]]
    # An undated row is its own key, by its values.
    own = F.when(F.col("DATE").isNull(), F.struct(*[F.col(c) for c in values]))
    return top_k(rows.withColumn("_own", own), 1, order, [*keys, "_own"]).drop("_own")


def _touched(batch: DataFrame) -> list[tuple[int | None, int | None]]:
    """The (YEAR, MONTH) partitions of a batch: bounded by the calendar."""
    return [(r[0], r[1]) for r in batch.select("YEAR", "MONTH").distinct().collect()]


def _in_months(months: Sequence[tuple[int | None, int | None]]):
    """A filter on the partition columns alone, which prunes the scan."""
    years: dict[int, list[int]] = {}
    for y, m in months:
        if y is not None:
            years.setdefault(y, []).append(m)
    out = F.lit(False)
    for y, ms in years.items():
        out = out | ((F.col("YEAR") == y) & F.col("MONTH").isin(ms))
    if any(y is None for y, _ in months):
        out = out | F.col("YEAR").isNull()
    return out


def upsert_batch(batch: DataFrame, batch_id: int, silver_dir: str, work_dir: str) -> bool:
    """Merge one batch of Silver rows; whether it was new."""
    spark = batch.sparkSession
    marker = f"{work_dir}/done/{batch_id}"
    if manifest.exists(spark, f"{marker}/_SUCCESS"):
        return False
    staged = f"{work_dir}/staged/{batch_id}"
    new = f"{staged}/new"
    # The batch is written once: it decides the partitions and is then merged.
    latest_per_day(batch.withColumn(LOADED, F.lit(batch_id).cast("long"))).write.mode("overwrite").parquet(new)
    rows = spark.read.parquet(new)
    months = _touched(rows)
    if months:
        if manifest.exists(spark, silver_dir):
            old = spark.read.schema(rows.schema).parquet(silver_dir).where(_in_months(months))
            # A batch that is done again must not meet its own rows twice.
            rows = rows.unionByName(old.where(F.col(LOADED) < batch_id).select(*rows.columns))
            rows = latest_per_day(rows)
        merged = f"{staged}/merged"
        rows.write.mode("overwrite").parquet(merged)
        (spark.read.parquet(merged).hint("rebalance", F.col("YEAR"), F.col("MONTH"))
         .sortWithinPartitions("YEAR", "MONTH", *KEYS)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("YEAR", "MONTH").parquet(silver_dir))
    spark.createDataFrame([(int(batch_id), len(months))], "batch long, months int").coalesce(1) \
        .write.mode("overwrite").parquet(marker)
    return True


def upsert_stream(spark: SparkSession, bronze_dir: str, silver_dir: str, work_dir: str,
                  files_per_batch: int | None = None, trigger: dict | None = None):
    """Start the stream; by default it drains what is there and stops."""
    rows = silver_frame(bronze_stream(spark, bronze_dir, files_per_batch))
    return (rows.writeStream
            .option("checkpointLocation", f"{work_dir}/checkpoint")
            .foreachBatch(lambda df, n: upsert_batch(df, n, silver_dir, work_dir) and None)
            .trigger(**(trigger or {"availableNow": True})).start())


def upsert_available(spark: SparkSession, bronze_dir: str, silver_dir: str, work_dir: str,
                     files_per_batch: int | None = None) -> str:
    """Merge the files present now, wait for it, return the Silver folder."""
    q = upsert_stream(spark, bronze_dir, silver_dir, work_dir, files_per_batch)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return silver_dir
