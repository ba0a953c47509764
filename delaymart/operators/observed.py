"""Quality counts gathered by the pass that writes.

The counts ride along as observed metrics of the write's own plan: no second scan,
join or job. They tell what a load lost, for logs and alarms. Rows counted before a
shuffle are counted again if a lost executor makes Spark repeat a map task, so a count
that must be exact after such a loss is to be taken from the written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from delaymart import schema as S
from delaymart.functions import columns as C
from delaymart.operators.silver import silver_frame, write_silver
from delaymart.operators.validate import join_sides, pred_side, silver_side
from delaymart.sinks.writers import write_parquet


def _lost(text: str, value: Column) -> Column:
    """Cells with text whose value is null."""
    return F.count(F.when((F.trim(text) != "") & value.isNull(), 1))


def write_silver_observed(bronze: DataFrame, path: str, entities: Sequence[str] | None = None) -> dict[str, int]:
    """K1 with counts: Bronze cleaned and written as Silver at ``path``. Returns
    ``rows_in``, ``casts_lost`` (numeric cells with text that is no number, over all
    numeric columns), ``stamps_lost`` (stamps in neither layout) and ``rows_out``."""
    numeric = S.present(S.BASE_NUM_COLS + S.CAUSE_COLS + [S.TOTAL_COL], bronze.columns)
    before, after = Observation("bronze"), Observation("silver")
    casts = reduce(add, [_lost(c, C.safe_double(c)) for c in numeric], F.lit(0))
    seen = bronze.observe(before, F.count(F.lit(1)).alias("rows_in"), casts.cast("long").alias("casts_lost"),
                          _lost("FLT_DATE", C.dual_timestamp("FLT_DATE")).alias("stamps_lost"))
    write_silver(silver_frame(seen, entities).observe(after, F.count(F.lit(1)).alias("rows_out")), path)
    return before.get | after.get


def write_validation_observed(silver: DataFrame, preds: DataFrame, path: str,
                              by: Sequence[str] = (S.ENTITY,)) -> dict[str, int]:
    """J1 + Q1 in one pass: the daily validation written at ``path``. Returns the days
    on each side (``silver_rows``, ``pred_rows``) and matched (``joined_rows``)."""
    n = F.count(F.lit(1))
    left, right, both = Observation("silver days"), Observation("predicted days"), Observation("matched days")
    s = silver_side(silver, by).observe(left, n.alias("silver_rows"))
    p = pred_side(preds, by).observe(right, n.alias("pred_rows"))
    write_parquet(join_sides(s, p, by).observe(both, n.alias("joined_rows")), path)
    return left.get | right.get | both.get
