import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = ["id", "row", "n", "fp", "size", "key", "rank", "copies", "kept", "shard", "slot", "p_bad", "u", "v", "w",
         "h1", "first", "keep_id", "component_id", "host", "digest", "a", "b"]


@pytest.fixture()
def rows(spark):
    """Documents (id, text[, source]) as a table, with columns whose names the
    operators use themselves, over several partitions."""
    def make(data, parts=3):
        full = [(*r, "s")[:3] for r in data]
        df = spark.createDataFrame(full, "doc_id long, text string, source string").repartition(parts)
        return df.select("*", *[F.lit(-5).alias(c) for c in CLASH])
    return make


def table_path(name):
    path = f"{SF}/{name}.parquet"
    return path if os.path.isfile(path) else f"{path}/*.parquet"
