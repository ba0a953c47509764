"""Stored, mergeable summaries of Silver.

Silver is read once into two small Gold tables:

* per (entity, YEAR, MONTH): exact counts, sums and maxima, and a KLL quantile
  sketch of the daily average. Any coarser profile, its median and the p95 / p99
  thresholds come from merging those rows: the sketches merge, the counts add.
* per (entity, YEAR): the exact set of days, as the bits of a 46-byte map (bit =
  day of year - 1) together with the number of rows. Maps of several loads are
  or-ed, so distinct days stay exact however often a day was loaded, without a
  distinct aggregation (no Expand, one shuffle).

A new load only summarises its own rows; ``merge_*`` joins its tables to the old
ones without reading Silver again.

Error: a KLL sketch with parameter k returns a value whose rank is within about
``rank_error(k)`` of the asked one with 99 % confidence for each quantile; merging
does not add to it. Up to k values or so a sketch keeps them all and is exact.
Rows without a date have a cell of their own with null YEAR and MONTH, so overall
figures have them; they are no day of the maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymart import schema as S

SKETCH_K = 1600
DAYS, MAP_BYTES = 366, 46
WORDS = 6       # 64-bit words of a map; the first byte is a word's highest


def rank_error(k: int = SKETCH_K) -> float:
    """The rank error (as a share of the number of values) of one quantile of a KLL
    sketch, at 99 % confidence: the published fit 2.296 / k^0.9021."""
    return 2.296 / k ** 0.9021


def month_sketches(silver: DataFrame, by: Sequence[str] = (S.ENTITY,), k: int = SKETCH_K) -> DataFrame:
    """One row per (entity, YEAR, MONTH): what profiles and thresholds merge from.
    ``n_values`` counts the values in the sketch (null averages are not in it); the
    sketch is null where there is none."""
    S.require(silver, [*by, "YEAR", "MONTH", "ARR_TOTAL_FLIGHTS", "TOTAL_DELAY_MIN", S.LABEL], "Silver")
    sums = {"arrivals": "ARR_TOTAL_FLIGHTS", "delay": "TOTAL_DELAY_MIN", "avg": S.LABEL}
    out = silver.groupBy(*by, "YEAR", "MONTH").agg(
        F.count("*").alias("days_count"),
        *[F.sum(c).alias(f"{n}_sum") for n, c in sums.items()],
        F.count("ARR_TOTAL_FLIGHTS").alias("arrivals_n"), F.count(S.LABEL).alias("n_values"),
        F.max(S.LABEL).alias("avg_max"),
        F.kll_sketch_agg_double(S.LABEL, k).alias("sketch"))
    return out.withColumn("sketch", F.when(F.col("n_values") > 0, F.col("sketch")))


def _merged(cells: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("days_count", "arrivals_sum", "delay_sum", "avg_sum", "arrivals_n", "n_values")],
        F.max("avg_max").alias("avg_max"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def _quantile(q: float) -> Column:
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))


def merge_months(old: DataFrame, new: DataFrame, by: Sequence[str] = (S.ENTITY,), k: int = SKETCH_K) -> DataFrame:
    """The cells of two disjoint loads as one table."""
    out = _merged(old.unionByName(new), [*by, "YEAR", "MONTH"], k)
    return out.withColumn("sketch", F.when(F.col("n_values") > 0, F.col("sketch")))


def profile_from_cells(cells: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = (S.ENTITY,),
                       k: int = SKETCH_K) -> DataFrame:
    """A1 (no keys), A2 (YEAR) or A3 (YEAR, MONTH) from the stored cells alone: the
    columns of ``profile.delay_profile``, the median within the sketch's error."""
    m = _merged(cells, [*by, *keys], k)
    return m.select(
        *keys, "days_count", "arrivals_sum", F.try_divide("arrivals_sum", "arrivals_n").alias("arrivals_avg_per_day"),
        F.col("delay_sum").alias("delay_min_sum"), F.try_divide("avg_sum", "n_values").alias("avg_delay_min_mean"),
        _quantile(0.5).alias("avg_delay_min_median"), F.col("avg_max").alias("avg_delay_min_max"),
        *[F.col(c).alias("airport" if c == S.ENTITY else c) for c in by])


def thresholds_from_cells(cells: DataFrame, by: Sequence[str] = (S.ENTITY,), k: int = SKETCH_K) -> DataFrame:
    """p95 and p99 per entity, merged from the stored cells."""
    return _merged(cells, by, k).select(*by, _quantile(0.95).alias("p95"), _quantile(0.99).alias("p99"))


def year_days(silver: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """One row per (entity, YEAR) of the dated rows: ``rows`` and the ``days`` map."""
    S.require(silver, [*by, "DATE", "YEAR"], "Silver")
    dated = silver.where(F.col("DATE").isNotNull() & F.col("YEAR").isNotNull())
    at = F.dayofyear("DATE") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), 56 - F.floor(at % 64 / 8).cast("int") * 8 + at % 8)
    words = [F.when(F.floor(at / 64) == w, bit) for w in range(WORDS)]
    return _with_map(dated.groupBy(*by, "YEAR").agg(
        F.count("*").alias("rows"), *[F.bit_or(word).alias(f"_w{w}") for w, word in enumerate(words)]), by)


def _with_map(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """The map from its or-ed words. Spark's bitmap aggregates hold and send 4096
    bytes a group, of which a year needs 46; words are or-ed in hash aggregates."""
    text = F.concat(*[F.lpad(F.hex(F.coalesce(f"_w{w}", F.lit(0).cast("long"))), 16, "0") for w in range(WORDS)])
    return words.select(*by, "YEAR", "rows", F.substring(F.unhex(text), 1, MAP_BYTES).alias("days"))


def merge_days(old: DataFrame, new: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """The maps of two loads, which may hold the same days, as one table."""
    part = [F.rpad(F.hex(F.substring("days", 8 * w + 1, 8)), 16, "0") for w in range(WORDS)]
    words = [F.conv(p, 16, -10).cast("long") for p in part]
    return _with_map(old.unionByName(new).groupBy(*by, "YEAR").agg(
        F.sum("rows").alias("rows"), *[F.bit_or(word).alias(f"_w{w}") for w, word in enumerate(words)]), by)


def days_per_year(maps: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A5 from the maps: rows and exact distinct days of each year."""
    return maps.select(*by, "YEAR", "rows", F.bitmap_count("days").alias("unique_days"))


def _bit(day: Column) -> Column:
    """Whether the map has the day of the year (1-based)."""
    byte = F.conv(F.hex(F.substring(F.col("days"), (F.floor((day - 1) / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.floor(byte.cast("long") / F.pow(F.lit(2.0), (day - 1) % 8)) % 2 == 1


def grid_from_days(maps: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """S5 from the maps: each day from an entity's first to its last, and whether the
    map has it. Only maps are shuffled; the days are generated in place, last."""
    keys = list(by)
    span = range_from_days(maps, by).select(*keys, "min_date", "max_date")
    years = span.select(*keys, "min_date", "max_date", F.explode(F.sequence(F.year("min_date"), F.year("max_date"))).alias("YEAR"))
    years = years.join(maps.select(*keys, "YEAR", "days"), [*keys, "YEAR"], "left")
    first, last = F.make_date("YEAR", F.lit(1), F.lit(1)), F.make_date("YEAR", F.lit(12), F.lit(31))
    days = F.sequence(F.greatest("min_date", first), F.least("max_date", last), F.expr("interval 1 day"))
    return years.select(*keys, "days", F.explode(days).alias("DATE")).select(
        *keys, "DATE", F.coalesce(_bit(F.dayofyear("DATE")), F.lit(False)).alias("has_data"))


def range_from_days(maps: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """A6 and D3 from the maps: first and last day, distinct days, rows, years. Only
    the bits of a map are looked at, 366 a row."""
    present = F.filter(F.sequence(F.lit(1), F.lit(DAYS)), _bit)
    rows = maps.select(*by, "YEAR", "rows", F.bitmap_count("days").alias("n"), present.alias("at"))
    start = F.make_date("YEAR", F.lit(1), F.lit(1))
    rows = rows.select(*by, "YEAR", "rows", "n", F.date_add(start, F.array_min("at") - 1).alias("lo"),
                       F.date_add(start, F.array_max("at") - 1).alias("hi"))
    return rows.groupBy(*by).agg(
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"), F.sum("rows").alias("days_count"),
        F.sum("n").alias("unique_days"), F.count("*").alias("years_count"))
