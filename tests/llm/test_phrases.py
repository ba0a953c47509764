"""Phrase mining against counting every phrase of every length by itself."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from delaymart.llm import phrases
from delaymart.llm.phrases import collocations, graph, paths, phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(data, width):
    f = Counter()
    for text, lang in data:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            for k in range(1, width + 1):
                f.update(("und" if lang is None else lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def brute(data, width=4, least=30, best=2000):
    f = counts_of(data, width)
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i:i + k])
                inside[q] = max(inside[q], a)
    out = {}
    for p, a in found.items():
        if p in inside and 100 * inside[p] >= 80 * a:
            continue
        w = p[1:]
        cuts = [(2_000_000 * a // (f[(p[0], *w[:k])] + f[(p[0], *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(w).encode(), f[(p[0], *w[:k])], f[(p[0], *w[k:])]))
    n = Counter()
    for p, c in f.items():
        n[p[0]] += c if len(p) == 2 else 0
    return sorted((lang, r, ph.decode(), -a, l_, r_, n[lang], -s) for lang, rows in out.items()
                  for r, (s, a, ph, l_, r_) in enumerate(sorted(rows)[:best], 1))


def make(n, seed, words=12):
    rng = random.Random(seed)
    vocab = [f"W{i}é" if i % 3 else f"w{i}" for i in range(words)]
    fixed = ["the long boiler plate line that is found in every text", "a a a a a a", "Short one"]
    out = []
    for i in range(n):
        t = " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".\n", " \t", "!?"]) for _ in range(rng.randrange(40)))
        out.append((t + ". " + rng.choice(fixed), rng.choice(["en", "de", None, ""])))
    return [*out, (None, "en"), ("", None), (" .,; ", "de"), ("x " * 5000, "en"), (out[0][0], "xx")]


def table(spark, data, parts=5):
    df = spark.createDataFrame(data, "text string, lang string").repartition(parts)
    return df.select("*", *[F.lit(-7).alias(c) for c in ("f", "c", "m", "phrase", "node", "done", "n", "rank", "doc_id")])


@pytest.mark.parametrize(("width", "least", "passes"), [(4, 5, 1), (4, 30, 3), (3, 4, 2), (5, 6, 2)])
def test_equals_counting_every_phrase(spark, width, least, passes):
    data = make(150, width)
    got = sorted(map(tuple, collocations(table(spark, data), width=width, least=least, best=50, passes=passes).collect()))
    assert got == brute(data, width, least, 50) and len(got) > 5


def test_counts_follow_from_the_longest_phrases(spark):
    data = make(80, 9)
    got = {(r["lang"], *r["phrase"].split(" ")): r["f"] for r in phrase_counts(table(spark, data), least=3).collect()}
    assert got == {p: c for p, c in counts_of(data, 4).items() if len(p) == 2 or c >= 3}


def test_edges_are_summed_before_one_shuffle(spark):
    plan = []
    phrases_cut = phrases.cut

    def see(df, name):
        if name == "phrases":
            plan.append(df._jdf.queryExecution().executedPlan().toString())
        return phrases_cut(df, name)
    phrases.cut = see
    try:
        phrase_counts(table(spark, make(5, 1)), passes=1)
    finally:
        phrases.cut = phrases_cut
    # One exchange serves edges and nodes, one the pairs, one the words.
    assert plan[0].count("Exchange hashpartitioning") == 3, plan[0]


def test_unary_paths(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta"
    data = [(line, "en")] * 40 + [("x y gamma delta epsilon z", "en")] * 35 + [("u v w x2 u", "de")] * 31
    edges = graph(phrase_counts(table(spark, data), least=30).where("m > 1"))
    got = {}
    for r in paths(edges).orderBy("place").collect():
        got.setdefault((r["lang"], r["path"]), []).append((r["place"], r["phrase"], r["f"]))
    w = line.split()
    # gamma delta epsilon branches, so the line's path is broken there.
    assert got["en", "delta epsilon zeta"] == [(0, " ".join(w[3:7]), 40), (1, " ".join(w[4:8]), 40)]
    assert got["en", "alpha beta gamma"] == [(0, " ".join(w[0:4]), 40)]
    assert got["de", "u v w"] == [(0, "u v w x2", 31), (1, "v w x2 u", 31)]
    assert ("en", "gamma delta epsilon") not in got


def test_long_paths_and_rings(spark):
    line = " ".join(f"t{i}" for i in range(200))
    ring = ["a b c d e a b c d e a b c d e a", None]
    got = paths(graph(phrase_counts(table(spark, [(line, "en")] * 31 + [tuple(ring)] * 30), least=30).where("m > 1"))).collect()
    assert sorted(r["place"] for r in got if r["lang"] == "en") == list(range(197))


def test_empty_table(spark):
    assert collocations(table(spark, [])).collect() == []
