"""Calendar rows, one per day, generated inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymart.functions.columns import iso_weekday


def calendar_parts(d: str = "DATE", weekday: str = "sunday") -> list[Column]:
    """YEAR, MONTH, DOW, DOM, WOY of a date column. ``weekday='sunday'``
    gives Sunday=1 (model and forecast), ``'iso'`` gives Monday=1."""
    dow = F.dayofweek(d) if weekday == "sunday" else iso_weekday(d)
    return [F.year(d).alias("YEAR"), F.month(d).alias("MONTH"),
            dow.alias("DOW"), F.dayofmonth(d).alias("DOM"),
            F.weekofyear(d).alias("WOY")]


def explode_days(keys: DataFrame, start: Column, end: Column,
                 by: list[str]) -> DataFrame:
    """Every day in [start, end] for each row of ``keys`` (one row per key).

    The generator runs on the executors, one key row at a time, so the output
    grows with the number of keys and never passes through the driver."""
    return keys.select(*by, F.explode(F.sequence(start, end, F.expr("interval 1 day")))
                       .alias("DATE"))


def span_days(daily: DataFrame, by: list[str], d: str = "DATE") -> DataFrame:
    """Each day between the first and last date of every key in ``daily``."""
    bounds = daily.where(F.col(d).isNotNull()).groupBy(*by).agg(
        F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    days = explode_days(bounds, F.col("_lo"), F.col("_hi"), by)
    return days.select(*by, "DATE", *calendar_parts("DATE"))
