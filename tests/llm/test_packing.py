"""Packing against encoding each whole text and laying the ids end to end."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from delaymart.llm import packing
from delaymart.llm.packing import Encoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = [(1, "Same text, it's two's"), (2, None), (3, ""), (4, " \t\n"), (5, "ÄÖ äö é ́x Σας"), (6, "word " * 700),
        (None, "no id 12345"), (7, "<|endoftext|> is text"), (7, "<|endoftext|> is text"), (8, "a\x0bb\x0cc\rd\ne"),
        (9, "x" * 3000), (10, "日本語 テキスト 🙂🙂")]


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


ENCODER = Encoder(PATH)


def ids_of(texts):
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    ids, first = ENCODER.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def check(got, data, whole, length):
    assert sum(r["length"] for r in got) == sum(len(whole(t)) + 1 for _, t in data)
    place = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for seq, off, n in place:           # one gapless stream, cut at the windows
        assert seq * length + off == at and n > 0 and off + n <= length
        at += n
    found = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        key = r["sequence_id"] * length + r["offset"] - r["start"]      # the document's place in the stream
        found.setdefault((key, r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    texts = []
    for (_, i, n), parts in found.items():
        ids = []
        for start, p in sorted(parts):
            assert start == len(ids)
            ids += p
        assert len(ids) == n
        texts.append((str(i), ids))
    assert sorted(texts) == sorted((str(i), [*whole(t), 1]) for i, t in data)


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_pieces_give_every_text_back(rows, whole, length):
    check(pack(rows(DATA, parts=4), PATH, length=length).collect(), DATA, whole, length)


def test_many_small_rows_over_partitions(rows, whole):
    data = [(i, f"w{i % 7} text {i}") for i in range(300)]
    check(pack(rows(data, parts=9), PATH, length=50).collect(), data, whole, 50)


def test_a_long_text_is_encoded_in_blocks(rows, whole, monkeypatch):
    words = " ".join(f"word{i}" for i in range(400))
    buf = np.frombuffer(words.encode(), np.uint8)
    ends = packing.blocks(buf, 100)
    assert ends[-1] == len(buf) and len(ends) > 20 and all(buf[e] == 32 for e in ends[:-1])
    monkeypatch.setattr(packing, "BLOCK_BYTES", 1 << 20)
    long = "lorem ipsum " * 200_000             # 2.4 MB
    data = [(1, long), (2, "short"), (3, "y" * 2_200_000)]
    got = pack(rows(data, parts=1), PATH).collect()
    for t in ("lorem ipsum " * 400_000, "y" * 5_000_000):      # above a block of the real size
        assert sum(1 for _ in packing.blocks(np.frombuffer(t.encode(), np.uint8), 1 << 20)) == (5 if " " in t else 1)
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 200_000 * len(whole("lorem ipsum")) + 1
    one = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == 1)
    ids = np.frombuffer(b"".join(p for _, p in one), "<u4")
    assert ids.tolist() == whole("lorem ipsum") * 200_000 + [1]


def test_empty_table(rows):
    assert pack(rows([]), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x85\xa0")
                        | st.sampled_from(" \t\n\x0b\x0c\r'sStT,.!<|>é́̈ "), max_size=30), max_size=5))
def test_encoding_word_by_word_equals_whole_texts(texts):
    tok = ENCODER.tokenizer
    assert ids_of(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_digests(spark):
    from delaymart.llm.queries import op11_packing
    from tests.llm.conftest import SF
    got = op11_packing(spark, SF).collect()
    tok = Tokenizer.from_file(PATH)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    assert {r["doc_id"] for r in got} == set(ids)
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    full = {}
    for r in got:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 2048 for s, n in full.items() if s != max(full))
