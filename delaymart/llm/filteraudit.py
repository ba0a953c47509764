"""Filter interaction audit by a Gray-code walk over all sets of filters.

Every row fails some of the filters. Rows are counted by the set of filters they
fail (the mask), so each part of the table is at most 2^k cells, summed in each
task before anything is shuffled. A walk then visits all 2^k sets of active
filters, toggling one filter at a time: each cell keeps the number of active
filters it fails, and the running survivors change by the cells whose number
leaves or reaches zero. The survivors of all sets are stored, and every step of
every order of the filters is a difference of two of them.

Defined cases: a null condition is no failure; a null part is the empty string;
null texts are empty; a row with a null id is nobody's copy and has no labels, but
other rows can be copies of it only through a smaller id; repeated ids with the same
text are not copies of each other; labels are or-ed where an id has several; an
empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import cut, small
from delaymart.llm.mixing import split_words


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions on one text: A short, B repetitive, C capitals, D symbols."""
    found = split_words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(found) < 50,
            "B": 100 * F.size(F.array_distinct(found)) < 65 * F.size(found),
            "C": 100 * capitals > 5 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def with_copies(rows: DataFrame, name: str, id_col: str, key_col: str) -> DataFrame:
    """Add whether a row's key occurs with a smaller id. ``rows`` is a written table."""
    groups = (rows.groupBy(F.col(key_col).alias("__key")).agg(F.min(id_col).alias("__least"), F.count(F.lit(1)).alias("__n"))
              .where("__n > 1").select("__key", "__least"))
    groups = cut(groups, "copies")
    joined = rows.join(small(groups, groups.count(), 64), F.col(key_col) == F.col("__key"), "left")
    later = F.coalesce(F.col(id_col) > F.col("__least"), F.lit(False))
    return joined.withColumn(name, later).drop("__key", "__least")


def walk(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors (measures) of each of the 2^k sets of active filters, from the
    cells' masks and counts (cells x measures)."""
    active = np.zeros(len(masks), np.int64)
    alive = counts.sum(axis=0)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0] = alive
    on = 0
    for step in range(1, 1 << k):
        bit = (step & -step).bit_length() - 1
        on ^= 1 << bit
        fails = (masks >> bit) & 1 == 1
        if on >> bit & 1:
            alive = alive - counts[fails & (active == 0)].sum(axis=0)
            active[fails] += 1
        else:
            active[fails] -= 1
            alive = alive + counts[fails & (active == 0)].sum(axis=0)
        states[on] = alive
    return states


def steps(states: np.ndarray, names: str) -> Iterator[tuple]:
    """For every order of the filters and every step: (order, step, kept, removed,
    redundant, only this one, each further measure's loss, removed over all orders)."""
    k = len(names)
    every = (1 << k) - 1
    rows, total = [], [0] * k
    for order in permutations(range(k)):
        on = 0
        for step, f in enumerate(order, 1):
            lost = states[on] - states[on | 1 << f]
            on |= 1 << f
            total[f] += int(lost[0])
            failing = int(states[0, 0] - states[1 << f, 0])
            alone = int(states[every ^ 1 << f, 0] - states[every, 0])
            rows.append((f, "".join(names[i] for i in order), step, int(states[on, 0]), int(lost[0]),
                         failing - int(lost[0]), alone, *map(int, lost[1:])))
    for f, *row in rows:
        yield (*row, total[f])


def filter_audit(df: DataFrame, part: Column, failures: dict[str, Column], losses: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters (one letter each, at most eight) and step:
    part, filter_order, step, kept, removed, redundant, unique_fails, one count per
    loss (rows removed here for which its condition holds), shapley."""
    names = "".join(failures)
    if len(names) != len(failures) or len(names) > 8:
        raise ValueError("filters are named by single letters, eight at most")
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    rows = df.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"),
                     *[F.when(c, 1).otherwise(0).alias(n) for n, c in losses.items()])
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in losses])
    measures, k = ["n", *losses], len(names)
    numbers = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]

    def run(cell: pa.Table) -> pa.Table:
        counts = np.stack([cell[n].to_numpy() for n in measures], axis=1).astype(np.int64)
        out = list(zip(*steps(walk(cell["mask"].to_numpy(), counts, k), names), strict=True))
        label = pa.array([cell["part"][0].as_py()] * len(out[0]), pa.string())
        return pa.Table.from_arrays([label, pa.array(out[0]), pa.array(out[1], pa.int32()),
                                     *[pa.array(c, pa.int64()) for c in out[2:]]],
                                    names=["part", "filter_order", "step", *numbers])

    return cells.groupBy("part").applyInArrow(
        run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in numbers))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five text filters, E being copies, per source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", *[c.alias(n) for n, c in text_failures(text).items()],
                       F.unhex(F.sha2(text, 256)).alias("key"))
    rows = with_copies(cut(rows, "failures"), "E", "doc_id", "key")
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return filter_audit(rows, F.col("source"), {n: F.col(n) for n in "ABCDE"},
                        {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
