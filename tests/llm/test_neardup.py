"""Near-duplicates against all pairs on a small fixture; sketch properties."""

import random
import re

import numpy as np

from delaymart.llm import neardup

rnd = random.Random(11)
VOCAB = [f"word{i}" for i in range(400)]


def text(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def edited(ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = f"new{rnd.randrange(10**6)}"
    return ws


def make():
    data, base = [], text(300)
    for i in range(12):  # a cluster of copies of one text, edited more and more
        data.append((100 + i, " ".join(edited(base, i))))
    chain = text(250)
    for i in range(8):  # a chain: each is near the next, the ends are not near
        data.append((200 + i, " ".join(chain[i * 6:i * 6 + 200])))
    for i in range(60):  # a crowd that shares half of its words
        data.append((300 + i, " ".join(base[:120] + text(110))))
    data += [(400, "a b c"), (401, "A  b\tc"), (402, "a b"), (403, None), (404, ""), (405, " \n"), (406, "a b c d e"),
             (407, "a b c d e f"), (100, data[0][1]), (None, data[0][1]), (None, "only null id here in this one"),
             (500, " ".join(text(20_000)))]
    return data


def brute(data, percent):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(data)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(d, len(s), best.get(find(i)) if s else d, d == (best.get(find(i)) if s else d))
            for i, ((d, _), s) in enumerate(zip(data, sets, strict=True))]


def check(df, data, percent, rows):
    got = [tuple(r) for r in neardup.near_duplicates(df, percent=percent, rows=rows).collect()]
    assert sorted(got, key=str) == sorted(brute(data, percent), key=str)


def test_components_equal_all_pairs(rows):
    data = make()
    check(rows(data), data, 85, 9)


def test_a_crowd_that_shares_a_passage(rows):
    base = text(60)
    data = [(i, " ".join(base + text(16))) for i in range(40)]
    data += [(100 + i, " ".join(edited(data[i][1].split(), 1))) for i in (3, 17)]
    check(rows(data), data, 80, 7)


def test_empty_table(rows):
    assert neardup.near_duplicates(rows([])).collect() == []


def test_registers_merge_and_likelihood_estimates():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:])
    both = np.unique(np.concatenate([a, b]))
    at = np.cumsum([0, len(a), len(b), len(both)])
    regs = neardup.registers(np.concatenate([a, b, both]), at)
    assert (neardup.merge(regs[0], regs[1]) == regs[2]).all()
    est = neardup.likelihood_jaccard(regs[:1], regs[1:2], np.array([2000]), np.array([2500]))[0]
    assert abs(est - 0.5) < 0.15


def test_pivots_in_turns_lose_no_link(rows, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_OF_SMALL", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    data = make()
    check(rows(data), data, 85, 4)


def test_turns_grow_as_far_as_their_pairs_allow(rows, monkeypatch):
    """Texts that share 56 of 68 shingles: none is linked, each has to meet all others."""
    base = text(60)
    data = [(i, " ".join(base + [f"own{i}x{j}" for j in range(12)])) for i in range(12)]
    monkeypatch.setattr(neardup, "PAIRS_OF_SMALL", 1)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    turns = []
    pivots = neardup.NearDuplicates._pivots

    def see(active, several, *many):
        turns.append(many)
        return pivots(active, several, *many)
    monkeypatch.setattr(neardup.NearDuplicates, "_pivots", staticmethod(see))
    check(rows(data), data, 80, 4)
    assert turns[0] == (1,) and max(turns)[0] >= 4 and len(turns) < 11, turns


def test_links_are_judged_in_one_job(spark):
    from delaymart.llm import components
    star = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a long, b long")
    assert components._state(star) == (3, True)
    for more in ((2, 6), (4, 3)):
        assert components._state(star.unionByName(spark.createDataFrame([more], star.schema))) == (4, False)
    assert components._state(star.where("a > 9")) == (0, True)


def test_prefixes_hold_a_shared_shingle_of_every_linked_pair(spark):
    rng = random.Random(3)
    sets = [set(rng.sample(range(60), 40)) for _ in range(80)]
    sets += [set(rng.sample(sorted(s), 37)) | {100 + i} for i, s in enumerate(sets[:40])]
    search = neardup.NearDuplicates(None, percent=70)
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "cid long, n long, set array<long>")
    keys = {}
    for r in search.prefixes(df.select("cid"), df).collect():
        keys.setdefault(r["cid"], set()).add(r["key"])
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 70 * len(a | sets[j]):
                linked += 1
                assert keys[i] & keys[j]
    assert linked >= 40 and sum(map(len, keys.values())) < sum(map(len, sets)) / 2


def test_thousands_of_unlinked_members_of_one_bucket(spark, monkeypatch):
    """Texts that share half their words and a bucket: no member meets all others."""
    base = text(60)
    data = [(i, " ".join(base + [f"own{i}x{j}" for j in range(50)])) for i in range(5000)]
    data += [(10_000 + i, data[i][1] + " end") for i in range(0, 5000, 500)]
    met = []
    estimates = neardup.NearDuplicates.estimates

    def see(self, pairs, classes):
        met.append(pairs.count())
        return estimates(self, pairs, classes)
    monkeypatch.setattr(neardup.NearDuplicates, "estimates", see)
    # Bands of one register put all of them into common buckets.
    monkeypatch.setattr(neardup, "REGISTERS", 180)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, percent=80, rows=4).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in data}
    assert sum(met) < 20 * len(data), met


def test_small_buckets_are_settled_without_prefixes(rows, monkeypatch):
    """Groups of three that share buckets but are not all linked: their pairs meet at once."""
    data = []
    for i in range(0, 60, 3):
        ws = text(70)
        data += [(i, " ".join(ws)), (i + 1, " ".join(ws[:66] + text(8))), (i + 2, " ".join(ws[:58] + text(12)))]
    counted = []
    prefixes = neardup.NearDuplicates.prefixes

    def see(self, cids, sets):
        counted.append(cids.count())
        return prefixes(self, cids, sets)
    monkeypatch.setattr(neardup.NearDuplicates, "prefixes", see)
    check(rows(data), data, 80, 4)
    assert not counted, counted
