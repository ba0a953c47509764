"""Feature importance as a percentage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def importance_pct(fi: DataFrame) -> DataFrame:
    """Each importance as percent of the total. The total is a one-row
    aggregate joined back in the plan (a broadcast of exactly one row)
    instead of a value collected to the driver. A total of 0 (constant
    label) gives null percentages."""
    total = fi.agg(F.sum("importance").alias("_total"))
    return (fi.crossJoin(F.broadcast(total))
            .withColumn("importance_pct", F.try_divide("importance", "_total") * 100)
            .drop("_total"))
