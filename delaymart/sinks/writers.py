"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str) -> str:
    """K2: plain Parquet, full overwrite."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_report_csv(df: DataFrame, path: str, order_by: Sequence[str | Column] | None = None,
                     limit: int | None = None) -> str:
    """K4: a report table as header CSV, optionally ordered and cut to
    ``limit`` rows. A limited table is bounded, so it is written as one
    file; an unlimited one keeps Spark's range partitioning, whose part
    files are in order, so no single task has to hold the whole table."""
    d = df
    if order_by:
        d = d.orderBy(*order_by)
    if limit is not None:
        d = d.limit(limit).coalesce(1)
    d.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """K6: every table as a temporary view for SQL users."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)
