"""Bucketed, sorted tables, for sides that are deduplicated and joined on the same
keys again and again (SURVEY 2.4 J1, 2.6 D2).

The shuffle on the keys is paid once, when the table is written. Dedups and joins on
those keys then run inside each bucket, with no exchange on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 256 << 20


def bucket_count(table_bytes: int, bucket_bytes: int = BUCKET_BYTES, least: int = 8) -> int:
    """Buckets of about ``bucket_bytes``; both sides of a join take one count, that of
    the larger side."""
    return max(least, -(-table_bytes // bucket_bytes))


def table_name(path: str) -> str:
    """The session catalog's name of the bucketed table at ``path``."""
    return "delaymart_" + hashlib.sha256(path.encode()).hexdigest()[:20]


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """``df`` as ``buckets`` buckets by ``keys``, sorted by them, at ``path``. Rows are
    dealt by the hash that the buckets use, so each task writes one file. Reduce
    repeated keys first (``dedup_daily``): all rows of a key share a bucket."""
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys)
       .write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table_name(path)))
    return path


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed table that this session wrote at ``path``."""
    return spark.table(table_name(path))
