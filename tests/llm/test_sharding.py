"""Sharding: near-equal bytes, gapless slots, hot keys and ties."""

from pyspark.sql import functions as F

from delaymart.llm.sharding import shard, text_key


def run(df, n, size):
    return shard(df.withColumn("bytes", size).withColumn("text_key", text_key(F.col("text"))), n,
                 ["text_key", "doc_id"], "bytes", sample_per_range=8).collect()


def check(got, n_rows, n, largest):
    assert len(got) == n_rows
    total = sum(max(r["bytes"] or 0, 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n))
    for mine in by.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    if total > n * largest:
        for k in range(n):
            assert abs(sum(r["bytes"] for r in by.get(k, [])) - total / n) <= largest + 1


def test_hot_key_long_texts_nulls_and_repeats(rows):
    data = [(i, f"text {i} " * (i % 7)) for i in range(300)] + [(1000 + i, "hot copy") for i in range(200)]
    data += [(2000, None), (None, None), (2001, ""), (5, "text 5 " * 5), (9000, "long " * 400)]
    data += [(7777, "same row")] * 50
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    got = run(rows(data), 5, size)
    check(got, len(data), 5, 2016)
    assert got[0]["w"] == -5 and got[0]["key"] == -5
    hot = sorted({r["shard"] for r in got if r["text"] == "hot copy"})
    assert hot == list(range(hot[0], hot[-1] + 1))


def test_no_sizes_and_more_shards_than_rows(rows):
    got = run(rows([(1, "a"), (2, "b"), (3, None)]), 8, F.lit(None).cast("long"))
    assert len(got) == 3 and all(r["slot"] == 0 for r in got)


def test_empty_table(rows):
    assert run(rows([]), 4, F.lit(1).cast("long")) == []
