"""Decontamination: exact, edited and paraphrased copies; clean text stays."""

import random

import numpy as np

from delaymart.llm import decontam

rnd = random.Random(2)
VOCAB = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30


def text(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


ITEMS = {i: text(30 + i) for i in range(12)} | {50: ["tiny", "item"], 51: []}


def score(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1,
                                      table[i + 1, j] - 1)
    return int(table.max())


def test_finds_copies_and_leaves_clean_documents(spark, rows):
    data, want = [], set()
    for i in range(12):
        item = ITEMS[i]
        few = list(item)
        for k in range(0, len(few), 9):
            few[k] = "other"
        for d, copy in ((100 + i, item), (200 + i, few), (300 + i, item[:14] + ["put", "in"] + item[14:])):
            data.append((d, " ".join(text(40) + copy + text(60)).title() + "."))
            want.add((d, i))
        data.append((400 + i, " ".join(text(50) + item[:8] + text(50))))
    data += [(500, None), (501, ""), (502, "tiny, ITEM"), (None, " ".join(ITEMS[3])), (100, data[0][1]),
             (503, " ".join(text(9000) + ITEMS[4] + text(3000)))]
    want |= {(502, 50), (None, 3), (503, 4)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()] + [(52, None)],
                                  "item_id long, text string")
    got = decontam.contaminated(rows(data), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert sum(r["doc_id"] == 100 for r in got) == 2
    texts = {d: t for d, t in data if d is not None}
    for r in got:
        if r["doc_id"] is not None:
            part = texts[r["doc_id"]].encode()[r["from_byte"]:r["to_byte"]].decode().lower()
            assert len(part.replace(",", "").replace(".", "").split()) == r["n_words"]
    blocks = decontam.contaminated(rows(data), bench, block_bytes=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == want
    kept = decontam.drop_contaminated(rows(data), bench).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(400, 412), 500, 501]
    assert kept[0]["w"] == -5
    assert decontam.contaminated(rows([]), bench).collect() == []
    assert decontam.contaminated(rows(data), bench.limit(0)).collect() == []


def test_widely_copied_edited_and_cut_passages_are_all_found(spark, rows):
    edited, whole = text(40), text(40)
    changed = ["other" if k % 9 == 0 else w for k, w in enumerate(edited)]
    data = [(d, " ".join(text(10) + changed + text(10))) for d in range(1000)]
    data += [(d, " ".join(text(10) + whole[:28] + text(10))) for d in range(1000, 2000)]
    data += [(d, " ".join(text(60))) for d in range(2000, 2100)]
    bench = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(whole))], "item_id long, text string")
    got = decontam.contaminated(rows(data), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, 1 + d // 1000) for d in range(2000)}


def test_every_alignment_at_the_threshold_is_found():
    items = decontam.Items(list(range(60)), [" ".join(text(rnd.randrange(4, 30))) for _ in range(60)])
    docs = []
    for words in [decontam.Items([0], [" ".join(text(120))]).words[0] for _ in range(60)]:
        item, copy = items.words[rnd.randrange(60)], []
        step, kind = rnd.randrange(1, 6), rnd.choice("rid")
        for k, w in enumerate(item.tolist()):
            if k % (step + 1) != step or kind == "i":
                copy.append(w)
            if k % (step + 1) == step and kind != "d":
                copy.append(rnd.randrange(1 << 60))
        docs.append(np.concatenate([words[:50], np.array(copy, np.uint64), words[50:]]))
    first = np.append(0, np.cumsum([len(x) for x in docs]))
    got = {r: [] for r in range(60)}
    for r, item, a, b in decontam._windows(np.concatenate(docs), first, items, 0.5):
        got[r].append((item, a, b))
    hard = 0
    for r, words in enumerate(docs):
        want = {k for k, w in enumerate(items.words) if decontam.align(w, words)[0] >= len(w)}
        hard += len(want)
        assert {x[0] for x in decontam._search(words, got[r], items, 0.5)} == want
    assert hard > 20


def test_alignment_equals_the_full_table():
    for _ in range(60):
        a = np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 15))], np.uint64)
        b = np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 40))], np.uint64)
        best, i, j = decontam.align(a, b)
        assert best == score(list(a), list(b))
        assert best == 0 or score(list(a), list(b[i:j])) == best
