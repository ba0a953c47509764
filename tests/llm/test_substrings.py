"""Substring dedup: every long repeat found, others left, shifts harmless."""

import random

import numpy as np

from delaymart.llm import substrings
from delaymart.llm.common import words

rnd = random.Random(8)


def text(n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(n))


def test_chunks_cover_all_words_and_resist_insertions():
    a = text(3000)
    b = a[:500] + " inserted words here " + a[500:]
    raw = [x.encode() for x in (a, "", b, "one")]
    offs = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    row, nth, n, lo, hi, digest = substrings.chunk(buf, offs)
    first = words(buf, offs)[2]
    assert [int(n[row == r].sum()) for r in range(4)] == np.diff(first).tolist()
    assert n.max() <= substrings.WINDOW and (nth[row == 3] == 0).all()
    lost = set(digest[row == 0].tolist()) - set(digest[row == 2].tolist())
    assert len(lost) <= 5


def test_every_repeat_of_over_fifty_words_is_found(rows):
    passages = [text(51 + i) for i in range(20)]
    data, want = [], set()
    for i, p in enumerate(passages):
        for k in range(2 + i % 3):
            data.append((100 * (i + 1) + k, f"{text(30)}\n{p.upper() if k else p}\n{text(40)}"))
            want.add(data[-1][0])
    data += [(i, text(80)) for i in range(10)] + [(20, None), (21, ""), (22, "short")]
    data += [(30, text(40) + " a short repeat of eight words in here " + text(40)),
             (31, text(40) + " a short repeat of eight words in here " + text(40))]
    got = substrings.repeated_spans(rows(data)).collect()
    assert {r["doc_id"] for r in got} == want
    for r in got:
        body = dict(data)[r["doc_id"]].encode()[r["from_byte"]:r["to_byte"]].decode()
        assert len(body.split()) == r["n_words"]
        assert body.lower() in passages[r["doc_id"] // 100 - 1]
        assert (r["later_words"] == 0) == (r["doc_id"] == r["first_id"])


def test_repeated_rows_null_ids_and_empty_table(rows):
    t = text(60)
    got = substrings.repeated_spans(rows([(5, t), (5, t), (None, t), (6, text(60))])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "None"]
    assert {r["first_id"] for r in got} == {5}
    assert substrings.repeated_spans(rows([])).collect() == []
