"""Anomalous days.

Thresholds are per-entity quantile sketches (partial aggregation, no group
ever sorted whole). They meet the daily rows through an equi-join on the
entity: one row per entity on the small side, so AQE broadcasts it when the
measured size is under the threshold and sort-merges otherwise. Top-k per
entity is ``row_number() <= k``; Spark plans a partial WindowGroupLimit
before the shuffle, so each map task sends at most k rows per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.functions.columns import severity

THRESHOLD_ACCURACY = 10000      # near exact; 100 matches a 0.01 relative error


def thresholds(silver: DataFrame, by: Sequence[str] = (S.ENTITY,),
               accuracy: int = THRESHOLD_ACCURACY, col: str = S.LABEL) -> DataFrame:
    """p95 and p99 of the daily average per entity (null when the entity
    has no non-null value: then nothing is an outlier, all is MODERATE)."""
    q = F.percentile_approx(col, [0.95, 0.99], accuracy)
    return (silver.groupBy(*by).agg(q.alias("_q"))
            .select(*by, F.col("_q")[0].alias("p95"), F.col("_q")[1].alias("p99")))


def top_k(df: DataFrame, k: int, order: Sequence[Column],
          by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """First ``k`` rows per group under ``order`` (a total order: callers
    add tie-breakers). With no group key this is a global top-k, which Spark
    plans as TakeOrderedAndProject (per-partition top-k, then a merge)."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _day_order(measure: str, columns: Sequence[str]) -> list[Column]:
    # Nulls last; ties by date, then entity, then every other column, so the
    # cut at k is reproducible even with duplicate days.
    ties = ["DATE", *[c for c in columns if c == S.ENTITY]]
    ties += [c for c in columns if c not in (measure, *ties)]
    return [F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]


def top_days(silver: DataFrame, measure: str, k: int = S.TOP_N_DAYS,
             by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """The k days with the largest ``measure`` per entity (with no
    ``by``: of all)."""
    return top_k(silver, k, _day_order(measure, silver.columns), by)


def p95_outliers(silver: DataFrame, th: DataFrame,
                 by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Days at or above the entity's p95."""
    return (silver.join(th.select(*by, "p95"), list(by))
            .where(F.col(S.LABEL) >= F.col("p95")).drop("p95"))


def anomalies(silver: DataFrame, by: Sequence[str] = (S.ENTITY,),
              k: int = S.TOP_N_DAYS, accuracy: int = THRESHOLD_ACCURACY,
              th: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """U1 + P18: top-k by average, top-k by total, and p95 outliers, kept
    as separate rows (a day can appear once per reason), each graded by the
    entity's p95 / p99.

    Silver is read once; with ``tasks`` its days are first placed by entity over so
    many tasks (else the limit goes before the shuffle): there each day becomes one row per reason it may count
    for, and one ``row_number() <= k`` per (entity, reason) keeps the top days. An
    outlier's reason is kept whole: a row id in its partition key makes each such row
    the first of its own. A placed task sorts its entities' days, not a split of the files."""
    S.require(silver, ["DATE", "TOTAL_DELAY_MIN", S.LABEL], "Silver")
    cols = silver.columns
    th = th if th is not None else thresholds(silver, by, accuracy)
    placed = silver.repartition(tasks, *by) if tasks and by else silver
    graded = (placed.join(th, list(by), "left")
              .withColumn("severity", severity(S.LABEL, "p95", "p99")))

    def reason(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("anomaly_type"), value.cast("double").alias("value"))

    reasons = F.array_compact(F.array(
        reason(S.ANOMALY_TOP_AVG, F.col(S.LABEL)), reason(S.ANOMALY_TOP_TOTAL, F.col("TOTAL_DELAY_MIN")),
        F.when(F.col(S.LABEL) >= F.col("p95"), reason(S.ANOMALY_P95, F.col(S.LABEL)))))
    rows = graded.select(*cols, "severity", F.explode(reasons).alias("_why")).select(*cols, "severity", "_why.*")
    rows = rows.withColumn("_own", F.when(F.col("anomaly_type") == S.ANOMALY_P95, F.monotonically_increasing_id()))
    top = top_k(rows, k, _day_order("value", ["value", *cols]), [*by, "anomaly_type", "_own"])
    return top.select(*cols, "anomaly_type", "severity")
