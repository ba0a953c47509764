"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` times all sizes by weight; a target stops at ``max_copies``
times its source's size and the excess is shared again by weight among the
rest. That fixed point is water-filling: with sources ordered by cap / weight,
a source is capped if its cap / weight is at most the level that the budget
left gives to it and the sources after it.

Copies: with rate r = target / size, each document is taken floor(r) whole
times. For the rest f = r - floor(r), documents are ranked by their random odds
u / (1 - u) divided by their inclusion odds f / (1 - f), times a document
weight where one is given (Pareto order sampling), and taken in that order
until the words left are used up: a sample of fixed size in words. A document
too large for what is left is passed over; then the order is run through again
for what is left, among documents that still fit, until none does.

Scale: all work is on (row, id, source, size, rank) rows. The order is cut into
slices of about ``SLICE`` rows per source and summed there first (partial
aggregation), so that only the slice in which a source's budget runs out is ever
sorted: a source with a third of all rows needs no task for itself. What is
selected is described by one small row per source and round.

Reruns agree: the random numbers are hashes of the id, or of a written row number
where the id is null; rows with the same id share their rank, and their row numbers
order them. Defined cases: null text has size 0 and is never taken; null source is a
source of its own; rows with a null or the same id are taken one by one; a source of
size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import cut, with_row_id

WEIGHTS = (5, 2, 1)
SLICE, LEAST_SLICES = 4096, 4096


def split_words(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text: spaces are made one kind, and
    a word starts where one ends and something else follows."""
    one = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(one, " ", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.size(split_words(text)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """(0, 1) from the md5 of the id's text and a seed: 52 bits, the same in
    any engine."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, share: float = 1.5, max_copies: int = 2,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) and any further columns from (source,
    source_size, ...): one row per source, so the unpartitioned windows here run
    over that many rows."""
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    src = sizes.withColumn("w", w.cast("double"))
    src = src.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    src = src.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(here_on))
    src = src.withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("o"), "level"))).over(every)
    return src.select("source", "source_size",
                      F.when(F.col("capped"), F.col("cap"))
                      .otherwise(F.col("w") * free["level"]).alias("target"), *more)


def _chosen(n: int) -> Column:
    """Whether one of the first n rounds took the row."""
    out = F.lit(False)
    for k in range(n):
        out = out | ((F.col("size") <= F.col(f"left{k}"))
                     & F.coalesce(F.struct(F.col("rank"), F.col("tie")) <= F.col(f"last{k}"), F.lit(False)))
    return out


def _round(rows: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """Add round k's budget (``left``) and last taken (rank, tie) to the plan."""
    cand = rows.join(plan, F.col("source").eqNullSafe(F.col("source_")))
    cand = cand.where((F.col("size") > 0) & (F.col("size") <= F.col(f"left{k}")) & ~_chosen(k))
    slot = F.floor(F.col("rank") * F.col("slices")).cast("long")
    sums = cand.groupBy("source_", slot.alias("slot")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source_").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0)))
    edge = (sums.join(plan.select(F.col("source_").alias("p"), F.col(f"left{k}").alias("room")),
                      F.col("source_").eqNullSafe(F.col("p")))
            .where(F.col("before") <= F.col("room"))
            .groupBy("source_").agg(F.max(F.struct("slot", "before")).alias("e"))
            .select(F.col("source_").alias("edge_source"), "e.*"))
    fine = (cand.join(edge, F.col("source_").eqNullSafe(F.col("edge_source")) & (slot == F.col("slot")))
            .select("source_", "rank", "tie", "size", "before", F.col(f"left{k}").alias("room")))
    order = Window.partitionBy("source_").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0)
    fine = (fine.withColumn("upto", F.col("before") + F.sum("size").over(order))
            .where(F.col("upto") <= F.col("room"))
            .groupBy("source_").agg(F.max(F.struct("rank", "tie", "upto")).alias("end")))
    ends = (edge.join(fine, F.col("edge_source").eqNullSafe(F.col("source_")), "left")
            .select("edge_source", "end", "slot", "before"))
    last = F.when(F.col("end").isNotNull(), F.struct(F.col("end.rank").alias("rank"),
                                                     F.col("end.tie").alias("tie"))).otherwise(
        F.struct((F.col("slot") / F.col("slices")).alias("rank"), F.lit(None).cast("long").alias("tie")))
    out = plan.join(ends, F.col("source_").eqNullSafe(F.col("edge_source")), "left")
    used = F.coalesce(F.col("end.upto"), F.col("before").cast("double"), F.lit(0.0))
    return cut(out.select(*plan.columns,
                          F.when(F.col("edge_source").isNotNull(), last).alias(f"last{k}"),
                          (F.col(f"left{k}") - used).alias(f"left{k + 1}")), "mix-round")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        size: Column | None = None, share: float = 1.5, max_copies: int = 2,
        weights: tuple[int, ...] = WEIGHTS, weight: Column | None = None,
        seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies,
    taken (= copies * size). ``weight`` multiplies a document's inclusion odds.
    ``row_col``: a column of unique longs, carried along; else one is made."""
    size = word_count(F.col("text")) if size is None else size
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                     size.cast("long").alias("size"), weight.alias("weight"),
                     *([F.col(row_col).cast("long").alias("tie")] if row_col else []))
    rows = rows if row_col else with_row_id(rows, "tie")
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("tie").cast("string")))
    rows = cut(rows.withColumn("u", uniform(name, seed)), "mix-sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(per, share, max_copies, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    # A power of two, so that a slice's first rank is exact.
    slices = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / SLICE, F.lit(float(LEAST_SLICES))))))
    plan = cut(plan.select(F.col("source").alias("source_"), "source_size", "target",
                           whole.alias("whole"), (rate - whole).alias("f"), slices.alias("slices"),
                           (F.col("target") - whole * F.col("source_size")).alias("left0")), "mix-targets")
    odds = F.col("f") / (F.lit(1.0) - F.col("f")) * F.col("weight")
    q = F.col("u") / (F.lit(1.0) - F.col("u")) / odds
    ranked = rows.join(plan.select("source_", "f"), F.col("source").eqNullSafe(F.col("source_"))).select(
        "id", "source", "size", "tie",
        F.when(odds > 0, q / (F.lit(1.0) + q)).otherwise(F.lit(1.0)).alias("rank"))
    ranked = cut(ranked, "mix-ranks")
    rounds = 0
    while True:     # what is left of a budget falls fast: a round ends at a document above it
        plan = _round(ranked, plan, rounds)
        rounds += 1
        if plan.where(F.col(f"left{rounds}") < F.col(f"left{rounds - 1}")).isEmpty():
            break
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("source_")))
    copies = F.col("whole") + F.when((F.col("size") > 0) & _chosen(rounds), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size",
                      "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"),
                      *([F.col("tie").alias(row_col)] if row_col else []),
                      ).withColumn("taken", F.col("copies") * F.col("size"))
