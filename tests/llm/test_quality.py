"""Quality: held-out accuracy on the given labels, EM on drawn votes, edges."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from delaymart.llm import quality
from delaymart.llm.common import cut
from tests.llm.conftest import CLASH

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 4 != 0").unionByName(spark.createDataFrame(
        [(None, 0, 1), (1, None, None), (99_999_999, 1, 1)], "doc_id long, quality int, toxic int").select(
            *[F.col(c).cast(labels.schema[c].dataType).alias(c) for c in labels.columns]))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (None, "A plain line of text. And one more."),
                                 (0, "twice"), (-4, "AAAA!! BBBB!! " * 20_000)], "doc_id long, text string")
    odd = odd.unionByName(odd.where("doc_id = 0"))
    got = quality.classify(docs.where("doc_id != 0").unionByName(odd), train).collect()
    assert len(got) == docs.count() - 1 + 7
    by = {r["doc_id"]: r for r in got}
    assert all(not by[i]["kept"] and by[i]["p_bad"] == 1 for i in (-1, -2, -3)) and not by[-4]["kept"]
    held = labels.where("doc_id % 4 = 0 and doc_id != 0").collect()
    clean = [by[r["doc_id"]]["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    junk = [by[r["doc_id"]]["kept"] for r in held if r["quality"] == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1


def test_all_columns_stay_and_tables_may_be_empty(spark, rows):
    data = [(i, f"One sentence of words number {i}. Another sentence here.") for i in range(40)]
    data += [(100 + i, "### $$$ %%% &&& " * 10) for i in range(10)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(rows(data), none).collect()
    assert {r["doc_id"] for r in kept} >= set(range(40)) and kept[0]["p_bad"] == -5
    assert set(kept[0].asDict()) == {"doc_id", "text", "source", *CLASH}
    assert quality.classify(rows([]), none).collect() == []


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    n = len(quality.LABELLERS)
    kind = rng.choice(n, 20_000, p=np.append(0.8, np.full(n - 1, 0.2 / (n - 1))))
    votes = np.full((len(kind), n), quality.GOOD)
    for k in range(n - 1):
        chance = np.where(kind == k + 1, 0.85, 0.02)
        votes[:, k] = np.where(rng.random(len(kind)) < chance, quality.BAD, quality.GOOD)
    votes[:, -1] = np.where(rng.random(len(kind)) < 0.3, (kind > 0) ^ (rng.random(len(kind)) < 0.05), quality.NONE)
    u, at, count = np.unique(votes @ 3 ** np.arange(n), return_inverse=True, return_counts=True)
    post, says = quality.expectation_maximisation(u, count)
    # what the true accuracies would decide
    true = np.full((n, n), 0.02)
    true[np.arange(n - 1), np.arange(1, n)] = 0.85
    true[-1] = 0.95
    true[-1, 0] = 0.05
    share = np.append(0.8, np.full(n - 1, 0.2 / (n - 1)))
    ll = (votes == quality.BAD) @ np.log(true) + (votes == quality.GOOD) @ np.log(1 - true) + np.log(share)
    best = np.exp(ll)[:, 1:].sum(axis=1) > np.exp(ll)[:, 0]
    assert ((post[at] > 0.5) == (kind > 0)).mean() > (best == (kind > 0)).mean() - 0.02
    assert abs(says[0, 1] - 0.85) < 0.1 and says[0, 0] < 0.05
    assert says[-1, 0] < 0.1


def test_shares_by_definition():
    text = "The cat### sat sat. NOW!! | | a b c d a b c d"
    raw = text.encode()
    got = quality.shares(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    ws = text.lower().split()
    runs = [tuple(ws[i:i + 4]) for i in range(len(ws) - 3)]
    letters = [c for c in text if c.isalpha()]
    want = [len(ws), 1 / 15, sum(c.isupper() for c in letters) / len(letters), 1 / 15,
            sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / 15, 1 - len(set(runs)) / len(runs), 2 / 15, 2 / 15,
            len(set(ws)) / 15]
    want[0] = 15
    assert np.allclose(got, want)


def test_the_fits_do_not_unfold_the_samples_in_the_driver(spark):
    """Peak of the driver's Python memory for some 15 MB of sampled features."""
    rng = np.random.default_rng(4)
    names = np.array([f"{a:x}word{a}" for a in range(100, 40_100)])
    data = [(i, " ".join(names[rng.integers(0, len(names), 450)]) + ".") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("toxic"))
    cut(docs, "warm").count()
    tracemalloc.start()
    try:
        quality.QualityModel(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6, peak
