"""The Gray-code walk against applying the filters to the rows one by one."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from delaymart.llm.filteraudit import audit_documents, filter_audit, walk

WORDS = " ".join(f"word{i}" for i in range(60))
DATA = [(1, WORDS, "a"), (2, WORDS, "b"), (3, WORDS, None), (4, None, "a"), (5, "", "a"), (6, "AB # c", "b"),
        (7, "same " * 60, "a"), (7, "same " * 60, "a"), (None, WORDS, "a"), (8, WORDS + " $ " + "X" * 60, ""),
        (9, "Word\x0bword\x0cword\rword\nword\tword " * 20, "b"), (10, "Ä" * 40 + "A" * 3, "c"), (11, "w " * 30_000, "c")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1), (6, None, None)]


def fails(i, text, data):
    text = text or ""
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text) if x]
    copies = [j for j, t, _ in data if (t or "") == text and j is not None]
    return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and min(copies) < i}


def brute(data, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, t, s in data:
        parts.setdefault(s or "", []).append((i, fails(i, t, data)))
    out, total = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(rows), []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, order, step] = (
                    len(left), len(here), sum(r[1][f] for r in gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0] in good for r in here), sum(r[0] in toxic for r in here))
                gone += here
                total[part, f] = total.get((part, f), 0) + len(here)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_filtering_row_by_row(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit_documents(rows(DATA), labels.withColumn("source", F.lit("x"))).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute(DATA, LABELS)
    assert len(got) == 600 * 4      # null and empty source are one part


def test_empty_table(spark, rows):
    assert audit_documents(rows([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_walk_equals_counting_each_set():
    rng = np.random.default_rng(5)
    masks, counts = np.arange(32), rng.integers(0, 100, (32, 3))
    states = walk(masks, counts, 5)
    for on in range(32):
        assert states[on].tolist() == counts[masks & on == 0].sum(axis=0).tolist()


def test_other_filters_and_null_conditions(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 7, None).otherwise(F.col("id")).alias("v"))
    got = filter_audit(df, F.lit(None).cast("string"), {"x": F.col("v") > 5, "y": F.col("v") % 2 == 0}, {}).collect()
    by = {(r["filter_order"], r["step"]): r for r in got}
    assert len(got) == 4 and by["xy", 1]["removed"] == 2 and by["xy", 2]["kept"] == 5
    assert by["xy", 2]["redundant"] == 1 and by["yx", 2]["unique_fails"] == 1 and by["xy", 1]["shapley"] == 3
