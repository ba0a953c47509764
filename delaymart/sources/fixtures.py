"""Binding of the given tables to the Bronze daily layout (FIXTURES.md part 2).

One Bronze row per (market segment, order day), all columns text, as the raw
CSV would have them. This is the heavy job of the library at scale: it reads
``lineitem`` and ``orders`` whole. The plan:

1. ``lineitem`` is shuffled once on ``l_orderkey``, as narrow rows, and
   reduced to one row per order there;
2. ``orders`` meets ``customer`` on the customer key: AQE turns this into a
   broadcast join only when the measured customer side is under the
   broadcast threshold, else a sort-merge join whose hot keys AQE splits;
3. the per-order rows join on the order key, over as many tasks as the lines. At
   scale that is a sort-merge join whose output is already partitioned by the
   order key, so the per-order step of the day aggregate adds no exchange (when
   the per-order side is under the broadcast threshold, as on small inputs, it
   is broadcast instead and that step shuffles the joined rows once);
4. the day aggregate runs partial-then-final, so a segment holding a third
   of all orders is still summed map-side before the shuffle.

The tasks of the shuffles on keys follow from the number of lines
(``LINES_PER_TASK``, counted from the Parquet footers), so a task's hash tables
and sorts stay the same size however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart.sources.tables import table

# ---------------------------------------------------------------------------
# Fixed values of the binding (FIXTURES.md): (return flag, line status) pairs
# whose quantity sums stand for the cause columns.
CAUSE_BINDING = [("A", "F", "DLY_APT_ARR_A_1"), ("A", "O", "DLY_APT_ARR_C_1"),
                 ("N", "F", "DLY_APT_ARR_D_1"), ("N", "O", "DLY_APT_ARR_E_1"),
                 ("R", "F", "DLY_APT_ARR_G_1"), ("R", "O", "DLY_APT_ARR_NA_1")]
DELAYED_QTY, DELAYED15_QTY = 25, 45
# ---------------------------------------------------------------------------
LINES_PER_TASK = 500_000


def line_tasks(spark: SparkSession, lines: DataFrame) -> int:
    """Tasks of a shuffle of ``lines`` (a plain scan): at most ``LINES_PER_TASK`` each."""
    return max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_TASK))


def per_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity",
               "l_returnflag", "l_linestatus")
    li = li.repartition(line_tasks(spark, li), "l_orderkey")
    q = F.col("l_quantity")
    sums = [F.sum(F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), q))
            .alias(name) for rf, ls, name in CAUSE_BINDING]
    return li.groupBy("l_orderkey").agg(
        *sums, F.sum(q).alias("q_all"), F.max(q).alias("q_max"))


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze text rows derived from orders, customer and lineitem."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    lines = per_order_lines(spark, sf_dir)
    o = (orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
         .select("o_orderkey", "c_mktsegment",
                 F.to_date("o_orderdate").alias("d")))
    o = o.repartition(line_tasks(spark, table(spark, sf_dir, "lineitem")), "o_orderkey")
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    cause_names = [c for _, _, c in CAUSE_BINDING]
    # Stage 1: one row per (segment, day, order). Equal to counting distinct
    # order keys later, and exact even if an order key were repeated.
    per_order = j.groupBy("c_mktsegment", "d", "o_orderkey").agg(
        *[F.sum(c).alias(c) for c in cause_names],
        F.sum("q_all").alias("q_all"), F.max("q_max").alias("q_max"))
    # Stage 2: one row per (segment, day).
    day = per_order.groupBy("c_mktsegment", "d").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("q_max") > DELAYED_QTY, 1)).alias("n_dly"),
        F.count(F.when(F.col("q_max") > DELAYED15_QTY, 1)).alias("n_dly15"),
        *[F.sum(c).alias(c) for c in cause_names],
        F.sum("q_all").alias("q_all"))
    odd = (F.dayofmonth("d") % 2) == 1
    as_text = lambda c: F.col(c).cast("bigint").cast("string")  # whole numbers
    return day.select(
        F.concat(F.lit("-"), F.lower("c_mktsegment"), F.lit(" ")).alias("APT_ICAO"),
        F.concat(F.date_format("d", "yyyy-MM-dd"),
                 F.when(odd, F.lit("T00:00:00.000Z")).otherwise(F.lit("T00:00:00Z"))
                 ).alias("FLT_DATE"),
        as_text("n").alias("FLT_ARR_1"),
        as_text("n_dly").alias("FLT_ARR_1_DLY"),
        as_text("n_dly15").alias("FLT_ARR_1_DLY_15"),
        *[as_text(c).alias(c) for c in cause_names],
        F.when(odd, as_text("q_all")).alias("DLY_APT_ARR_1"),
    )


def supplier_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze text rows per (supplier, ship day): the entity count grows with
    the data, and the rows are as dirty as raw files get (FIXTURES.md part 3):
    bad and empty numbers, no flights, bad and empty stamps, days loaded twice
    with different measures, entities without a readable day in some years.
    One scan and one shuffle of ``lineitem``, as narrow rows: a supplier has few
    lines a day, so summing before the shuffle would hold a group for almost every
    line of a split and send wider rows."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    q, names = F.col("l_quantity"), [c for _, _, c in CAUSE_BINDING]
    placed = (li.withColumn("d", F.to_date("l_shipdate")).drop("l_shipdate")
              .repartition(line_tasks(spark, li), "l_suppkey", "d"))
    day = placed.groupBy("l_suppkey", "d").agg(
        F.count("*").alias("n"), F.count(F.when(q > DELAYED_QTY, 1)).alias("n_dly"),
        F.count(F.when(q > DELAYED15_QTY, 1)).alias("n_dly15"),
        *[F.sum(F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), q)).alias(name)
          for rf, ls, name in CAUSE_BINDING],
        F.sum(q).alias("q_all"))
    dirt = (F.col("l_suppkey") * 31 + F.unix_date("d")) % 97
    twice = F.when(F.col("dirt") == 5, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    rows = day.withColumn("dirt", dirt).withColumn("more", F.explode(twice))
    odd = (F.dayofmonth("d") % 2) == 1
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("bigint").cast("string")
    stamp = (F.when(F.col("dirt") == 3, F.lit("bad")).when(F.col("dirt") == 4, F.lit(""))
             .when((F.col("l_suppkey") % 10 == 3) & F.year("d").between(1998, 2001), F.lit("unknown"))
             .otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"),
                                 F.when(odd, F.lit("T00:00:00.000Z")).otherwise(F.lit("T00:00:00Z")))))
    flights = (F.when(F.col("dirt") == 0, F.lit("n/a")).when(F.col("dirt") == 1, F.lit(""))
               .when(F.col("dirt") == 2, F.lit("0")).otherwise(text("n")))
    return rows.select(
        F.concat(F.lit(" sup-"), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("APT_ICAO"),
        stamp.alias("FLT_DATE"), flights.alias("FLT_ARR_1"),
        text("n_dly").alias("FLT_ARR_1_DLY"), text("n_dly15").alias("FLT_ARR_1_DLY_15"),
        text(F.col(names[0]) + F.col("more")).alias(names[0]), *[text(c).alias(c) for c in names[1:]],
        F.when(odd, text(F.col("q_all") + F.col("more"))).alias("DLY_APT_ARR_1"))


BINDINGS = {"segments": daily_raw, "suppliers": supplier_raw}
