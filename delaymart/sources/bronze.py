"""The raw Bronze CSV tree, and its writer for derived Bronze rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_bronze_csv(df: DataFrame, path: str) -> str:
    """Write text rows as a header CSV tree. Whitespace is kept as is (the
    writer trims by default, which would change raw codes)."""
    (df.write.mode("overwrite")
       .option("header", True)
       .option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


def bronze_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads one line, no data pass)."""
    return (spark.read.option("header", True)
            .option("recursiveFileLookup", True).csv(path).columns)


def read_bronze_csv(spark: SparkSession, path: str, strict: bool = True,
                    columns: list[str] | None = None) -> DataFrame:
    """Recursive CSV scan with header; every column is text.

    ``strict`` (default) checks each file's header against the first one
    (``enforceSchema=false``): a file whose columns are in another order
    fails the read instead of being read by position into wrong columns.
    """
    cols = columns or bronze_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    return (spark.read.schema(schema)
            .option("header", True)
            .option("recursiveFileLookup", True)
            .option("enforceSchema", not strict)
            .csv(path))


def read_bronze_layouts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """S1 for a tree whose files come in more than one column layout: each
    folder holds one layout and is read strictly with its own header; the
    parts are unioned by column name, absent columns as null."""
    parts = [read_bronze_csv(spark, f) for f in folders]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
