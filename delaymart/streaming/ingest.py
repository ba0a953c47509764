"""Incremental Bronze -> Silver with Structured Streaming.

New CSV files landing in the Bronze folder are picked up by a file-source
stream, cleaned with the same projection as the batch path, and appended to
the partitioned Silver table; the checkpoint records which files are done, so
a restarted job (or a lost executor) resumes without reading a file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from delaymart.operators.silver import silver_frame
from delaymart.sources.bronze import bronze_header


def bronze_stream(spark: SparkSession, bronze_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """File-source stream over the Bronze CSV tree (text columns)."""
    cols = bronze_header(spark, bronze_dir)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    return (spark.readStream.schema(schema).options(**limit)
            .option("header", True)
            .option("recursiveFileLookup", True)
            .option("enforceSchema", False)
            .csv(bronze_dir))


def silver_stream(spark: SparkSession, bronze_dir: str, silver_dir: str, checkpoint: str,
                  trigger: dict | None = None):
    """Start the stream; by default drains what is there and stops."""
    sdf = silver_frame(bronze_stream(spark, bronze_dir))
    w = (sdf.writeStream.format("parquet")
         .option("path", silver_dir)
         .option("checkpointLocation", checkpoint)
         .partitionBy("YEAR", "MONTH")
         .outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def ingest_available(spark: SparkSession, bronze_dir: str, silver_dir: str,
                     checkpoint: str) -> str:
    """Run the stream over the files present now, wait for it, return the
    Silver folder."""
    q = silver_stream(spark, bronze_dir, silver_dir, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return silver_dir
