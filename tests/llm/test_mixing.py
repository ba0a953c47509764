"""Mixing: targets by repeated resharing, words near targets, reruns agree."""

import random

from delaymart.llm.mixing import mix

rnd = random.Random(3)
DATA = [(i, " ".join(["w"] * rnd.randint(0, 60)), s) for i, s in enumerate(
    ["a"] * 120 + ["b"] * 60 + ["c"] * 30 + [None] * 20 + ["z"] * 10)]
DATA += [(500, None, "a"), (501, " \t\n", "b"), (502, "one", "empty"), (503, None, "void"), (None, "x y z", "a"),
         (7, DATA[7][1], "a")]


def shared(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * level >= most * sizes[s]]
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_targets_and_words_taken(rows):
    got = mix(rows(DATA)).collect()
    assert len(got) == len(DATA)
    sizes = {}
    for _, t, s in DATA:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shared(sizes)
    for s, n in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {n}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 12, s
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    again = mix(rows(DATA, parts=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_without_ids_are_taken_one_by_one(rows):
    """Target 34000 words; null ids as some and as all of a source's rows, and one id."""
    for ids in ([None] * 1000 + list(range(300)), [None] * 1300, [7] * 1300):
        data = [(i, "w " * 20, "c") for i in ids]
        got = mix(rows(data), share=34_000 / 26_000).collect()
        assert len(got) == 1300 and abs(sum(r["taken"] for r in got) - 34_000) < 20


def test_a_budget_is_filled_until_nothing_fits(rows):
    """Long documents early in the order leave room for short ones, round by round."""
    data = [(i, "w " * n, "a") for i, n in enumerate([400, 390, 380, 200, 190, 90, 80, 40, 20, 10, 5, 3, 2, 1, 1, 1] * 3)]
    got = mix(rows(data), share=0.47).collect()
    left = got[0]["target"] - sum(r["taken"] for r in got)
    assert 0 <= left < min(r["size"] for r in got if not r["copies"])


def test_rows_carry_their_number(rows):
    from pyspark.sql import functions as F
    df = rows([(1, "w " * 10, "a"), (1, "w " * 4000, "a"), (1, None, "a"), (None, "w", "a")]).withColumn(
        "at", F.monotonically_increasing_id())
    got = mix(df, row_col="at").collect()
    assert len({r["at"] for r in got}) == 4 and [r["copies"] for r in got if not r["size"]] == [0]


def test_weights_raise_the_odds(rows):
    from pyspark.sql import functions as F
    data = [(i, "w w w w", "a") for i in range(400)]
    got = mix(rows(data), share=0.5, weight=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).collect()
    taken = [sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert taken[0] > 1.5 * taken[1]


def test_empty_table(rows):
    assert mix(rows([])).collect() == []
