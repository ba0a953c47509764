"""Record quarantine for the Bronze scan.

A line of a CSV file that does not have the header's number of fields (short, long
or torn in the middle of a quoted field) is not padded with nulls and let through:
it goes to a rejects table with its text and its file, and all other lines go on.
Nothing is lost and nothing is counted twice: lines in = rows kept + rejects.

The reader is Spark's permissive CSV reader with a corrupt-record column; one scan
is written once and then split, so the files are parsed a single time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaymart.sources.bronze import bronze_header

CORRUPT, FILE = "_corrupt_record", "_file"


def read_with_rejects(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every line of the tree: the columns as text, ``_corrupt_record`` (the line, if
    it is malformed) and ``_file``. Headers are checked against the first one."""
    cols = list(columns) if columns else bronze_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*cols, CORRUPT]])
    return (spark.read.schema(schema)
            .option("header", True).option("recursiveFileLookup", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", False)
            .csv(path).select("*", F.col("_metadata.file_path").alias(FILE)))


def split_rejects(spark: SparkSession, path: str, work_dir: str,
                  columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): the good rows have the header's columns; a reject has
    ``file`` and ``line``. The parsed lines are written under ``work_dir``, cut into
    the two parts by partition, so each part is read without the other."""
    rows = read_with_rejects(spark, path, columns)
    out = f"{work_dir}/lines"
    rows.withColumn("rejected", F.col(CORRUPT).isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(out)
    lines = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("rejected", T.BooleanType())])).parquet(out)
    good = lines.where("not rejected").drop(CORRUPT, FILE, "rejected")
    bad = lines.where("rejected").select(F.col(FILE).alias("file"), F.col(CORRUPT).alias("line"))
    return good, bad
