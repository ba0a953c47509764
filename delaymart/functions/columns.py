"""Column expressions.

All are plain ``Column`` builders on ``pyspark.sql.functions``: they stay in
whole-stage codegen and compose into a single ``select``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from delaymart import schema as S

# Two accepted timestamp layouts, tried in order (first success wins):
# seconds, or seconds with milliseconds; either may end in Z or an offset.
TS_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[XXX][X]",
              "yyyy-MM-dd'T'HH:mm:ss.SSS[XXX][X]"]


def normalize_code(c) -> Column:
    """Upper case, keep only A-Z and 0-9."""
    return F.regexp_replace(F.upper(_col(c)), "[^A-Z0-9]", "")


def safe_double(c) -> Column:
    """Text (or any type) to double; bad or empty text becomes null
    instead of failing the job under ANSI mode."""
    return _col(c).try_cast("double")


def dual_timestamp(c) -> Column:
    """Parse with the first format that succeeds; unparsable -> null."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in TS_FORMATS])


def to_day(c) -> Column:
    """P5: timestamp / text / date to date (session time zone, UTC)."""
    return F.to_date(_col(c))


def iso_weekday(d) -> Column:
    """ISO weekday, Monday=1 .. Sunday=7."""
    return F.weekday(_col(d)) + 1


def sunday_weekday(d) -> Column:
    """Spark weekday, Sunday=1 .. Saturday=7."""
    return F.dayofweek(_col(d))


def row_sum(cols) -> Column:
    """Sum across columns with null as zero; typed null if no columns."""
    cols = list(cols)
    if not cols:
        return F.lit(None).cast("double")
    return reduce(lambda a, b: a + b,
                  [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def total_with_fallback(total_col: str | None, cause_cols) -> Column:
    """P10: the explicit total when present and not null, else the row sum."""
    s = row_sum(cause_cols)
    return F.coalesce(_col(total_col), s) if total_col else s


def guarded_ratio(num, den) -> Column:
    """Num / den only when den > 0 and num is not null, else null."""
    num, den = _col(num), _col(den)
    return F.when((den > 0) & num.isNotNull(), num / den)


def rmse(error) -> Column:
    """Root of the mean squared error, as an aggregate."""
    return F.sqrt(F.avg(_col(error) * _col(error)))


def severity(value, p95, p99) -> Column:
    """EXTREME at or above p99, HIGH at or above p95, else MODERATE
    (a null value or null thresholds give MODERATE)."""
    value, p95, p99 = _col(value), _col(p95), _col(p99)
    return (F.when(value >= p99, F.lit(S.SEVERITY_EXTREME))
            .when(value >= p95, F.lit(S.SEVERITY_HIGH))
            .otherwise(F.lit(S.SEVERITY_MODERATE)))


def year_month_label(y, m) -> Column:
    """K5: ``YYYY-MM`` chart label."""
    return F.concat_ws("-", _col(y).cast("string"),
                       F.lpad(_col(m).cast("string"), 2, "0"))


def split_bucket(d) -> Column:
    """M3: stable 0..99 bucket of a date (multiplicative hash of the day
    number), so the 80/20 fallback split does not depend on partitioning."""
    return F.pmod(F.unix_date(_col(d)).cast("bigint") * F.lit(2654435761),
                  F.lit(4294967296)) % 100


def _col(c) -> Column:
    if c is None:
        return F.lit(None)
    return F.col(c) if isinstance(c, str) else c
