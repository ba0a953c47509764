"""Exact dedup against grouping by the texts themselves."""

import hashlib

import numpy as np

from delaymart.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = [(1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, "ÄÖ äö"), (6, "Äö äö"), (7, "x" * 200_000),
        (8, "x" * 199_999 + "y"), (9, "X" * 200_000), (None, "same text"), (11, "lone"), (11, "lone"), (12, "a\x00"),
        (13, "a")]


def brute(data):
    groups = {}
    for i, t in data:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return groups


def check(got, data):
    groups = brute(data)
    assert len(got) == len(data)
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        mine = [r for r in got if r["sha256"] == digest]
        assert sorted((r["doc_id"] for r in mine), key=str) == sorted(ids, key=str)
        assert {r["keep_id"] for r in mine} == {max(known)}
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [max(known)]


def test_groups_equal_brute_force(rows):
    check(exact.exact_dedup(rows(DATA), digest=True).collect(), DATA)


def test_huge_texts_are_hashed_as_chunk_rows(rows):
    check(exact.exact_dedup(rows(DATA), digest=True, huge_bytes=1000).collect(), DATA)


def test_colliding_fingerprints_are_told_apart(rows):
    data = [(i, f"t{i:03d}") for i in range(60)] + [(100, "t001")]
    check(exact.exact_dedup(rows(data), digest=True, primes=(7, 5)).collect(), data)


def test_empty_table(rows):
    assert exact.exact_dedup(rows([])).collect() == []


def test_chunk_hashes_combine_by_shifting():
    buf = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    hasher = exact.Hasher(1, exact.PRIMES)
    whole = [int(r[0]) for r in hasher.residues(buf, np.array([0, len(buf)]))]
    for at in (1, 8192, 12_345):
        a = hasher.residues(buf[:at], np.array([0, at]))
        b = hasher.residues(buf[at:], np.array([0, len(buf) - at]))
        assert whole == [(int(x[0]) + pow(q, at, p) * int(y[0])) % p
                         for x, y, (q, p) in zip(a, b, hasher.points, strict=True)]
    x, p = hasher.points[0]
    assert whole[0] == sum(int(v) * pow(x, i, p) for i, v in enumerate(buf[:50_000])) % p
