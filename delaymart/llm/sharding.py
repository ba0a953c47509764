"""Sharding by sampled splitters.

Keys are sampled with a chance in proportion to the row's size; the quantiles
of the sample are boundaries that cut the key order into many ranges of
near-equal size, and rows are partitioned by range. A range that turns out
overfull (a hot key) is subdivided: keys are drawn again within it and its own
quantiles become further boundaries, as long as that helps. The order is by
key, then by a row number that the written input fixes, so even copies of one
key are divided.

Sizes per range then give every range its exact place in the whole order, a
running sum within the range gives every row its place, and the shard is that
place cut into ``n_shards`` equal parts by bytes. So the result does not
depend on the sample, only the balance of the work does. Rows with equal keys
are neighbours: they share a shard unless a shard border falls among them.

The driver holds the sample's boundaries and the ranges' totals: at most
``ranges`` rows, which grow to ``MAX_RANGES`` and no further (ranges then hold
more rows, sorted with spill).

Defined cases: a null text has size 0 (16 in the query's measure); null keys
come first; rows with equal keys are ordered by row number; sizes that are null
or negative count as 0, and if all are 0 every row counts as 1; an empty table
gives no rows; other columns are carried through (names that start with ``__``
are kept for the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import cut, with_row_id

SAMPLE_PER_RANGE = 64
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000
OVERFULL = 2.0
MAX_SPLITS = 4


def text_key(text: Column) -> Column:
    """A well-mixed sort key that equal texts share: 60 bits of the md5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _splitters(rows: DataFrame, key: Column, chance: Column, step: int) -> list:
    """Every ``step``-th key of a sample drawn with ``chance``."""
    u = F.pmod(F.xxhash64("__row", F.lit(17)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    drawn = rows.where(u < chance).select(key.alias("k")).orderBy("k").collect()
    return [r["k"] for r in drawn[step - 1::step]]


def _range_of(key: Column, splitters: list, key_type) -> Column:
    """How many splitters are at or below the key: a binary search."""
    if not splitters:
        return F.lit(0)
    arr = F.array(*[_literal(s, key_type) for s in splitters])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def go(pos, step):
        to = pos + step
        return F.when((to <= len(splitters)) & (F.get(arr, to - 1) <= key), to).otherwise(pos)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go)


def _literal(row, key_type) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                      for v, f in zip(row, key_type.fields, strict=True)])


def shard(df: DataFrame, n_shards: int, keys: list[str], size_col: str,
          sample_per_range: int = SAMPLE_PER_RANGE, ranges: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, near-equal sums of
    ``size_col``) and ``slot`` (gapless from 0 in each shard, in key order)."""
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    rows = cut(with_row_id(df.withColumn("__size", size)), "shard-input")
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("b")).first()
    n, total = head["n"], head["b"]
    if total == 0:
        rows, total = rows.withColumn("__size", F.lit(1).cast("long")), n
    if ranges is None:
        ranges = min(MAX_RANGES, max(8 * n_shards, n // ROWS_PER_RANGE))
    key = F.struct(*[F.col(k) for k in keys], F.col("__row"))
    key_type = rows.select(key.alias("k")).schema["k"].dataType
    slim = rows.select(*dict.fromkeys([*keys, "__row", "__size"]))
    want = ranges * sample_per_range
    splitters = _splitters(slim, key, F.col("__size") * (want / max(total, 1)), sample_per_range)
    for split in range(MAX_SPLITS + 1):
        range_of = _range_of(key, splitters, key_type)
        sums = (slim.groupBy(range_of.alias("__range"))
                .agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
        full = {r["__range"]: r for r in sums
                if r["rows"] > 1 and r["bytes"] > OVERFULL * total / ranges}
        if not full or split == MAX_SPLITS:
            break
        finer = _splitters(slim.where(range_of.isin(*full)), key,
                           F.col("__size") * (want * 4 ** (split + 1) / total), sample_per_range)
        merged = sorted({tuple(s) for s in [*splitters, *finer]},
                        key=lambda t: [(v is not None, v) for v in t])
        if len(merged) == len(splitters) or len(merged) > 4 * MAX_RANGES:
            break
        splitters = merged
    starts, b, c = [], 0, 0
    for r in sorted(sums, key=lambda r: r["__range"]):
        starts.append((r["__range"], b, c))
        b, c = b + r["bytes"], c + r["rows"]
    spark = df.sparkSession
    places = F.broadcast(spark.createDataFrame(starts, "__range int, __bytes0 long, __rows0 long"))

    def placed(part: DataFrame) -> DataFrame:
        part = part.withColumn("__range", range_of).join(places, "__range")
        order = Window.partitionBy("__range").orderBy(key)
        upto = F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        middle = F.col("__bytes0") + upto - F.col("__size") / 2
        part = part.withColumn("shard", F.least(F.floor(middle * n_shards / max(total, 1)),
                                                F.lit(n_shards - 1)).cast("int"))
        return part.withColumn("__at", F.col("__rows0") + F.row_number().over(order) - 1)

    first = placed(slim).groupBy("shard").agg(F.min("__at").alias("__first"))
    out = placed(rows).join(F.broadcast(first), "shard")
    own = ["__size", "__row", "__range", "__bytes0", "__rows0", "__at", "__first"]
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    return out.withColumn("slot", F.col("__at") - F.col("__first")).drop(*own).select(*cols, "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write sharded rows as one folder per shard."""
    df.write.partitionBy("shard").parquet(path)
