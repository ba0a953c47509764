"""Feature table and train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.functions.columns import split_bucket
from delaymart.operators.silver import dedup_daily


def with_model_calendar(df: DataFrame) -> DataFrame:
    """P6 + P8: YEAR / MONTH from DATE if absent; DOW as Spark's weekday
    (Sunday=1, the model's convention), DOM, ISO WOY."""
    extra = {}
    if "YEAR" not in df.columns:
        extra["YEAR"] = F.year("DATE")
    if "MONTH" not in df.columns:
        extra["MONTH"] = F.month("DATE")
    extra.update({"DOW": F.dayofweek("DATE"), "DOM": F.dayofmonth("DATE"),
                  "WOY": F.weekofyear("DATE")})
    return df.withColumns(extra)


def feature_columns(silver: DataFrame, leak_free: bool = False) -> list[str]:
    """The candidate features that this Silver has (calendar ones always).
    ``leak_free`` leaves out what the label is computed from: the flights and
    every delay column (the original keeps them, so that is the default)."""
    avail = set(silver.columns) | set(S.CALENDAR_FEATURES)
    names = S.CALENDAR_FEATURES if leak_free else S.CANDIDATE_FEATURES
    return [c for c in names if c in avail]


def feature_table(silver: DataFrame, by: Sequence[str] = (S.ENTITY,), leak_free: bool = False) -> DataFrame:
    """M1: entity, DATE, features as double with null as 0 (P16), the label
    as double; rows with a null date or label dropped (P17); one row per
    (entity, DATE) (D1)."""
    S.require(silver, list(by) + ["DATE", S.LABEL], "Silver")
    cols = feature_columns(silver, leak_free)
    df = with_model_calendar(silver)
    df = df.select(*by, "DATE",
                   *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
                   F.col(S.LABEL).cast("double").alias(S.LABEL))
    df = df.where(F.col("DATE").isNotNull() & F.col(S.LABEL).isNotNull())
    return dedup_daily(df, list(by) + ["DATE"])


def split_plan(feat: DataFrame, by: Sequence[str] = (S.ENTITY,),
               min_test: int = S.MIN_TEST_DAYS, min_train: int = S.MIN_TRAIN_DAYS) -> DataFrame:
    """M2 + M3: per entity, the last year is the test year when there are at
    least two years, ``min_test`` test days and ``min_train`` training days;
    otherwise the stable 80/20 hash split. One small row per entity."""
    per_year = feat.groupBy(*by, "YEAR").agg(F.count("*").alias("n"))
    st = per_year.groupBy(*by).agg(
        F.count("*").alias("n_years"), F.max("YEAR").alias("last_year"),
        F.max_by("n", "YEAR").alias("n_last"), F.sum("n").alias("n_all"))
    time_mode = ((F.col("n_years") >= 2) & (F.col("n_last") >= min_test)
                 & ((F.col("n_all") - F.col("n_last")) >= min_train))
    test_year = F.col("last_year").cast("int")
    return st.select(
        *by,
        F.when(time_mode, F.concat(F.lit(S.SPLIT_TIME_PREFIX), test_year.cast("string")))
         .otherwise(F.lit(S.SPLIT_RANDOM)).alias("split_mode"),
        F.when(time_mode, test_year).alias("test_year"))


def assign_split(feat: DataFrame, plan: DataFrame,
                 by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Adds ``is_test``: the test year under a time split, else bucket >= 80."""
    j = feat.join(plan, list(by))
    is_test = F.when(F.col("test_year").isNotNull(), F.col("YEAR") == F.col("test_year")) \
               .otherwise(split_bucket("DATE") >= 80)
    return j.withColumn("is_test", is_test).drop("test_year")


def random_sides(rows: DataFrame, keys: Sequence[str] = (S.ENTITY, "DATE"), test_share: float = 0.2,
                 seed: int = S.RF_SEED, partitions: int = 8) -> DataFrame:
    """M3 with Spark's own sampler: every row in one of two sides, ``is_test``.

    The sampler draws by partition number and row order, so the rows are first placed
    by their keys' hash over ``partitions`` tasks and sorted there by keys and then by
    all other columns. The sides depend on rows, seed and ``partitions``, not on how
    the input was partitioned."""
    rest = [c for c in rows.columns if c not in keys]
    placed = rows.repartition(partitions, *keys).sortWithinPartitions(*keys, *rest)
    train, test = placed.randomSplit([1 - test_share, test_share], seed)
    return (train.withColumn("is_test", F.lit(False))
            .unionByName(test.withColumn("is_test", F.lit(True))))


def split_counts(split: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Train and test row counts per entity with the chosen mode."""
    return split.groupBy(*by, "split_mode").agg(
        F.count(F.when(~F.col("is_test"), 1)).alias("train_rows"),
        F.count(F.when(F.col("is_test"), 1)).alias("test_rows"))
