"""Forecast of a future year.

Seasonal baseline: the mean of every non-calendar model input per entity,
MONTH and weekday over a history window; days of the target year take the
baseline of their cell, else the entity's overall mean, else 0. All of it is
one plan: one aggregate of the history, joined to 84 cells per entity, which
then become the days of the year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.sources.calendar import calendar_parts


def non_calendar(input_cols: Sequence[str]) -> list[str]:
    return [c for c in input_cols if c not in set(S.CALENDAR_FEATURES)]


def history(silver: DataFrame, start: int, end: int, input_cols: Sequence[str],
            by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """History rows in [start, end] with the model's weekday (Sunday=1) and
    every non-calendar input present in Silver as double, null as 0. YEAR is
    taken from DATE where Silver lacks it (P6)."""
    S.require(silver, list(by) + ["DATE"], "Silver")
    cols = [c for c in non_calendar(input_cols) if c in silver.columns]
    year = F.col("YEAR") if "YEAR" in silver.columns else F.year("DATE")
    h = silver.where(year.between(start, end) & F.col("DATE").isNotNull())
    return h.select(*by, F.month("DATE").alias("MONTH"), F.dayofweek("DATE").alias("DOW"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def cell_sums(hist: DataFrame, input_cols: Sequence[str], by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Days and the sum of each input per (entity, MONTH, DOW): at most 84
    rows per entity, from which both the cell and the entity means follow."""
    cols = [c for c in non_calendar(input_cols) if c in hist.columns]
    return hist.groupBy(*by, "MONTH", "DOW").agg(F.count("*").alias("_days"), *[F.sum(c).alias(c) for c in cols])


def _cell_means(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    cols = [c for c in sums.columns if c not in (*by, "MONTH", "DOW", "_days")]
    return sums.select(*by, "MONTH", "DOW", *[(F.col(c) / F.col("_days")).alias(c) for c in cols])


def seasonal_baseline(hist: DataFrame, input_cols: Sequence[str],
                      by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A10: mean of each input per (entity, MONTH, DOW)."""
    return _cell_means(cell_sums(hist, input_cols, by), by)


def _overall_means(sums: DataFrame, keys: DataFrame, input_cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    cols = non_calendar(input_cols)
    have = [c for c in cols if c in sums.columns]
    means = sums.groupBy(*by).agg(F.sum("_days").alias("_days"), *[F.sum(c).alias(c) for c in have])
    out = keys.select(*by).distinct().join(means, list(by), "left")
    return out.select(*by, *[F.coalesce(F.try_divide(c, "_days") if c in have else F.lit(None).cast("double"),
                                        F.lit(0.0)).alias(c) for c in cols])


def global_means(hist: DataFrame, input_cols: Sequence[str], by: Sequence[str] = (S.ENTITY,),
                 keys: DataFrame | None = None) -> DataFrame:
    """Mean of each input per entity; null means, inputs absent from
    Silver and entities (of ``keys``) without history are 0."""
    return _overall_means(cell_sums(hist, input_cols, by), hist if keys is None else keys, input_cols, by)


def forecast_inputs(silver: DataFrame, input_cols: Sequence[str], start: int, end: int,
                    year: int, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """S5 + J2 + P20 + P21: one row per entity of Silver and day of ``year``
    with every model input: calendar columns as int, the rest as double (cell
    mean, else the entity's mean, else 0).

    The history is read and shuffled once: its cells are joined to every
    entity's 84 cells, the entity's mean is a window over those, and each cell
    then becomes its days (every month has every weekday)."""
    sums = cell_sums(history(silver, start, end, input_cols, by), input_cols, by)
    cells = (silver.select(*by).distinct()
             .select(*by, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("MONTH"))
             .select(*by, "MONTH", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("DOW"))
             .join(sums, [*by, "MONTH", "DOW"], "left"))
    whole = Window.partitionBy(*by)
    values = [c for c in non_calendar(input_cols)]
    filled = cells.select(*by, "MONTH", "DOW", *[
        F.coalesce(F.col(c) / F.col("_days"), F.try_divide(F.sum(c).over(whole), F.sum("_days").over(whole)),
                   F.lit(0.0)).alias(c) if c in sums.columns else F.lit(0.0).alias(c) for c in values])
    first = F.make_date(F.lit(year), F.col("MONTH"), F.lit(1))
    days = F.filter(F.sequence(first, F.last_day(first)), lambda d: F.dayofweek(d) == F.col("DOW"))
    fut = filled.select(*by, *values, F.explode(days).alias("DATE")).select(
        *by, "DATE", *values, *calendar_parts("DATE"))
    names = [*input_cols, *[c for c in ("YEAR", "MONTH", "DOW") if c not in input_cols]]
    return fut.select(*by, "DATE", *[F.col(c).cast("int" if c in S.CALENDAR_FEATURES else "double").alias(c)
                                     for c in names])


def forecast_daily(scored: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """M12 output contract."""
    return S.conform(scored, S.FORECAST_DAILY, by, pred_avg_arr_delay_min="prediction")


def forecast_monthly(daily: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Days and mean forecast per month."""
    return daily.groupBy(*by, "YEAR", "MONTH").agg(
        F.count("*").alias("days_count"),
        F.avg("pred_avg_arr_delay_min").alias("pred_monthly_mean_delay_min"))
