"""Versioned tables with an atomic publish.

A table is a folder with one sub-folder per version and a pointer file:

    table/v-<number>-<token>/...        the rows, as Parquet
    table/_current/<number>             one line: the version's folder name

A write goes to a fresh version folder. Only when it is complete is its pointer
put in place, by renaming a finished file onto a name that must not exist yet;
that single step publishes the version. Readers take the pointer with the largest
number. So a reader never meets a half-written table, a write that dies leaves the
table as it was, and of two writers that race for one number exactly one succeeds
(the other raises ``Conflict`` and may try again on the new state).

Earlier versions stay readable (``read_version``) until ``prune`` drops them.

The rename of one small file must be atomic and must refuse an existing target,
as on HDFS and local disks. On object stores without that, use a store-side
commit protocol instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_current"


class Conflict(RuntimeError):
    """Another writer published this version number first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def versions(spark: SparkSession, table: str) -> list[int]:
    """The published version numbers, oldest first."""
    fs, p = _fs(spark, f"{table}/{POINTERS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def _folder(spark: SparkSession, table: str, version: int) -> str:
    fs, p = _fs(spark, f"{table}/{POINTERS}/{version}")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def location(spark: SparkSession, table: str, version: int | None = None) -> str:
    """The folder of a version (default: the current one)."""
    known = versions(spark, table)
    if version is None:
        if not known:
            raise FileNotFoundError(f"{table} has no published version")
        version = known[-1]
    elif version not in known:
        raise FileNotFoundError(f"{table} has no version {version}")
    return f"{table}/{_folder(spark, table, version)}"


def _point(spark: SparkSession, table: str, version: int, folder: str) -> None:
    fs, target = _fs(spark, f"{table}/{POINTERS}/{version}")
    fs.mkdirs(target.getParent())
    draft = _path(spark, table, POINTERS, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    # Local file systems replace the target of a rename: take the name first.
    try:
        fs.create(_path(spark, table, POINTERS, f"_lock-{version}"), False).close()
    except Exception as e:
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {table} was taken") from e
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {table} was published by another writer")


def publish(spark: SparkSession, table: str, write: Callable[[str], object]) -> int:
    """Let ``write(folder)`` write a fresh version and publish it; its number. If
    ``write`` fails, nothing is published and the current version stays."""
    base = versions(spark, table)
    version = base[-1] + 1 if base else 1
    folder = f"v-{version}-{uuid.uuid4().hex[:12]}"
    path = f"{table}/{folder}"
    write(path)
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        raise RuntimeError(f"{path} is not a finished write")
    _point(spark, table, version, folder)
    return version


def write_snapshot(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> int:
    """K2 (K1 with ``partition_by``) as a new version of ``table``."""
    return publish(df.sparkSession, table, lambda path: df.write.partitionBy(*partition_by).parquet(path))


def read_snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """A version's rows (default: the current one)."""
    return spark.read.parquet(location(spark, table, version))


def prune(spark: SparkSession, table: str, keep: int = 2) -> list[int]:
    """Drop all but the ``keep`` latest versions; the numbers dropped. A version's
    pointer goes before its rows, so no reader is sent to a folder being deleted."""
    old = versions(spark, table)[:-keep] if keep > 0 else []
    for version in old:
        folder = _folder(spark, table, version)
        fs, pointer = _fs(spark, f"{table}/{POINTERS}/{version}")
        fs.delete(pointer, False)
        fs.delete(_path(spark, table, folder), True)
    return old
