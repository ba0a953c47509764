"""Silver -> Gold profile.

Every aggregate is keyed by the entity first (``by``), so one pass serves
all airports; with a single entity the rows equal the single-airport
results. All of them plan as partial + final hash/object aggregation: a hot
entity is reduced map-side before the shuffle, and the median is a
mergeable sketch (``percentile_approx``), not a sort of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart import schema as S

MEDIAN_ACCURACY = 10000


def _finish(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Move the entity key(s) to the end, named ``airport`` like the Gold
    contract (SURVEY 1.3)."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    if by == [S.ENTITY]:
        return df.select(*rest, F.col(S.ENTITY).alias("airport"))
    return df.select(*rest, *by)


def delay_profile(silver: DataFrame, keys: Sequence[str] = (),
                  by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A1 (no keys), A2 (YEAR), A3 (YEAR, MONTH): day count, sum and mean of
    flights, sum of delay minutes, mean / median / max of the daily average.
    The mean is the unweighted mean of daily ratios, as in the original."""
    S.require(silver, ["ARR_TOTAL_FLIGHTS", "TOTAL_DELAY_MIN", S.LABEL], "Silver")
    return _finish(silver.groupBy(*by, *keys).agg(*_measures()), by)


def profile_levels(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A1, A2 and A3 from one pass over Silver (grouping sets): the measures
    of each level, ``level`` being the number of calendar keys."""
    S.require(silver, ["ARR_TOTAL_FLIGHTS", "TOTAL_DELAY_MIN", S.LABEL], "Silver")
    keys = [F.col(c) for c in by]
    sets = [keys, [*keys, F.col("YEAR")], [*keys, F.col("YEAR"), F.col("MONTH")]]
    level = 2 - F.grouping("YEAR") - F.grouping("MONTH")
    return silver.groupingSets(sets, *by, "YEAR", "MONTH").agg(*_measures(), level.alias("level"))


def profile_slice(levels: DataFrame, keys: Sequence[str], by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """One level of :func:`profile_levels`, as :func:`delay_profile` gives it."""
    rest = [c for c in levels.columns if c not in ("YEAR", "MONTH", "level", *by)]
    return _finish(levels.where(F.col("level") == len(keys)).select(*by, *keys, *rest), by)


def _measures() -> list[Column]:
    return [
        F.count("*").alias("days_count"),
        F.sum("ARR_TOTAL_FLIGHTS").alias("arrivals_sum"),
        F.avg("ARR_TOTAL_FLIGHTS").alias("arrivals_avg_per_day"),
        F.sum("TOTAL_DELAY_MIN").alias("delay_min_sum"),
        F.avg(S.LABEL).alias("avg_delay_min_mean"),
        F.percentile_approx(S.LABEL, 0.5, MEDIAN_ACCURACY).alias("avg_delay_min_median"),
        F.max(S.LABEL).alias("avg_delay_min_max"),
    ]


def weekday_profile(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A4: by ISO weekday, reduced measures."""
    out = silver.groupBy(*by, "DOW").agg(
        F.count("*").alias("days_count"),
        F.avg("ARR_TOTAL_FLIGHTS").alias("arrivals_avg_per_day"),
        F.avg(S.LABEL).alias("avg_delay_min_mean"),
        F.percentile_approx(S.LABEL, 0.5, MEDIAN_ACCURACY).alias("avg_delay_min_median"),
    )
    return _finish(out, by)


def days_per_year_quality(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A5: rows vs distinct days per year; rows > unique_days flags copies."""
    return silver.groupBy(*by, "YEAR").agg(
        F.count("*").alias("rows"),
        F.countDistinct("DATE").alias("unique_days"))


def data_range(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """First and last day, day count and year count (rows with a date,
    year and month, as in the report)."""
    s = silver.where(F.col("DATE").isNotNull() & F.col("YEAR").isNotNull()
                     & F.col("MONTH").isNotNull())
    return s.groupBy(*by).agg(
        F.min("DATE").alias("min_date"), F.max("DATE").alias("max_date"),
        F.count("*").alias("days_count"),
        F.countDistinct("YEAR").alias("years_count"))


def distinct_years(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """D3: the distinct years per entity, flagging the last one (the test
    year of the time split). The last-year window runs on the aggregated
    table (one row per entity and year), so its groups stay small."""
    years = silver.where(F.col("YEAR").isNotNull()).groupBy(*by, "YEAR").agg(
        F.count("*").alias("days_count"))
    last = F.max("YEAR").over(Window.partitionBy(*by))
    return years.select(*by, "YEAR", "days_count", (F.col("YEAR") == last).alias("is_last_year"))


def cause_columns(silver: DataFrame, include_total: bool = False) -> list[str]:
    """Cause columns present in Silver. ``include_total=True`` reproduces the
    original name test, which also picked up the grand total column."""
    cols = S.present(S.REPORTED_CAUSES, silver.columns)
    if include_total and S.TOTAL_COL in silver.columns:
        cols.append(S.TOTAL_COL)
    return cols


def causes_wide(silver: DataFrame, by: Sequence[str] = (S.ENTITY,),
                include_total: bool = False) -> DataFrame:
    """One row per entity with the sum of every cause column."""
    cols = cause_columns(silver, include_total)
    if not cols:
        raise ValueError("Silver has no cause columns")
    out = silver.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    return _finish(out, by)


def causes_long(silver: DataFrame, by: Sequence[str] = (S.ENTITY,),
                include_total: bool = False) -> DataFrame:
    """U3 + U4: wide sums to (airport, cause, minutes) with null minutes as
    0, plus each cause's share of the entity's total (0 when the total is 0).

    The share's denominator is a window over the entity on the already
    aggregated long table: at most 17 rows per entity, so the window's
    group is bounded whatever the input size."""
    wide = causes_wide(silver, by, include_total)
    ids = [c for c in wide.columns if not c.startswith("DLY_APT_ARR_")]
    cols = [c for c in wide.columns if c.startswith("DLY_APT_ARR_")]
    long = wide.unpivot(ids, cols, "cause", "minutes").select(
        *ids, "cause", F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)).alias("minutes"))
    total = F.sum("minutes").over(Window.partitionBy(*ids))
    return long.select(*ids, "cause", "minutes",
                       F.when(total > 0, F.col("minutes") / total)
                       .otherwise(F.lit(0.0)).alias("share"))
