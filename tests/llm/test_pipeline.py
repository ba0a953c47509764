"""The pipeline against brute force, stage by stage, and its edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from delaymart.llm import mixing
from delaymart.llm.common import cut
from tests.llm.test_decontam import score
from tests.llm.test_neardup import brute as near_brute

SF = "/root/testdata/sf0.001"
PUNCT = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cut(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_run(spark, staged):
    for df in staged[:-1]:
        assert df.columns == staged[0].columns
    assert staged[-1].columns == [*staged[0].columns, "shard", "slot"]
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, staged[-1].collect()), key=str)


def test_quality_keeps_labelled_good_documents(spark, staged):
    kept = {r["doc_id"] for r in staged[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r["doc_id"] in kept for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.2


def test_near_dedup_equals_all_pairs(staged):
    data = [(r["doc_id"], r["text"]) for r in staged[1].collect()]
    want = {d for d, _, _, kept in near_brute(data, 80) if kept}
    assert {r["doc_id"] for r in staged[2].collect()} == want


def test_decontamination_equals_full_alignment(spark, staged):
    items = [re.findall(r"\S+", r["text"].lower().translate(PUNCT))
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in staged[3].collect()}
    for r in staged[2].collect():
        words = re.findall(r"\S+", r["text"].lower().translate(PUNCT))
        seen = {tuple(words[i:i + 4]) for i in range(len(words))}
        near = [it for it in items if any(tuple(it[i:i + 4]) in seen for i in range(len(it) - 3))]
        bad = any(score(it, words[:600]) >= len(it) or " ".join(it) in " ".join(words) for it in near)
        assert (r["doc_id"] in left) == (not bad)


def test_mix_and_shards(staged):
    sizes = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in staged[3].collect()}
    mixed = [r["doc_id"] for r in staged[4].collect()]
    target = {r["source"]: r["target"] for r in mixing.mix(staged[3]).select("source", "target").distinct().collect()}
    for s, t in target.items():
        mine = [n for src, n in sizes.values() if src == s]
        taken = sum(sizes[d][1] for d in mixed if sizes[d][0] == s)
        assert abs(taken - t) <= max(mine)
    rows = staged[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(mixed)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    size = [sum(len((r["text"] or "").encode()) + 16 for r in by.get(k, [])) for k in range(cp.N_SHARDS)]
    assert max(abs(x - sum(size) / 40) for x in size) <= max(len(r["text"].encode()) for r in rows) + 17
    assert all(sorted(r["slot"] for r in mine) == list(range(len(mine))) for mine in by.values())


def test_edges(spark):
    good = "A plain sentence of several words. Another plain sentence follows it here, as one would expect."
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good, "en", "b", 1), (3, None, None, None, None),
            (None, good + " With an end of its own that differs a lot from others.", "en", None, 5),
            (5, "", "en", "a", 0), (6, " ".join(f"Word{i} goes on." for i in range(9000)), "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.select("*", *[F.lit(-5).alias(c) for c in ("copies", "kept", "id", "shard", "p_bad", "size", "u")])
    for start in (extra, extra.limit(0)):
        df = start
        for _, stage in cp.STAGES:
            df = cut(stage(spark, df, SF), "edge")
        got = df.collect()
        assert {r["copies"] for r in got} <= {-5}
        assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    kept = [r["doc_id"] for r in cp.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 5, 6, None], key=str)


def test_rows_of_null_or_repeated_ids_are_judged_one_by_one(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    rows = [(1, a), (None, a + " end"), (None, b), (7, c), (7, d), (7, c.upper()), (3, d + " end"), (None, e),
            (None, e.upper()), (None, ""), (None, ""), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = cp.near_dedup(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept), key=str) == sorted(
        [(1, a), (None, b), (7, c), (3, d + " end"), (None, e), (None, ""), (None, ""), (9, "")], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, item), (None, b), (7, c), (7, item)], "doc_id long, text string")
    assert sorted(map(tuple, cp.decontaminate(spark, docs, SF).collect()), key=str) == [(7, c), (None, b)]


def test_rows_of_one_id_are_mixed_on_their_own(spark, rows):
    import corpus_pipeline
    data = [(1, "w " * 10, "c"), (1, "w " * 4000, "c"), (1, "", "c"), (None, "w " * 10, "c"), (None, None, "c"), (2, "v " * 300, "c")]
    df = rows(data)
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    sizes = sorted(len((r["text"] or "").split()) for r in got)
    assert 0 not in sizes and all(sizes.count(n) <= 4 for n in sizes) and sizes.count(4000) <= 2 and sizes.count(300) <= 2
    assert abs(sum(sizes) - 1.5 * 4320) <= 4000 and set(got[0].asDict()) == set(df.columns)
