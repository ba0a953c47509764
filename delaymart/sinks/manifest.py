"""Manifests: what a written layer was made from.

A layer's manifest is a one-line JSON file in a folder beside it. It names the
input's files (by a mark over their paths, sizes and times) and the parameters
the layer follows from, so a later run can tell whether a finished layer is the
one it would write itself.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def files_mark(spark: SparkSession, path: str) -> list[int]:
    """Number, bytes and a checksum over (path, size, time) of all files below
    ``path``; only their listing is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length", F.unix_micros("modificationTime").alias("t")))
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"),
                    F.coalesce(F.bit_xor(F.xxhash64("path", "length", "t")), F.lit(0)).alias("h")).first()
    return [row.n, row.b, row.h]


def read(spark: SparkSession, path: str) -> dict | None:
    at = _beside(path)
    if not exists(spark, f"{at}/_SUCCESS"):
        return None
    lines = [r.value for r in spark.read.text(at).collect()]
    return json.loads(lines[0]) if lines else None


def write(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what, sort_keys=True),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(_beside(path))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, _beside(path))
    fs.delete(p, True)
