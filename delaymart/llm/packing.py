r"""Packing documents into token sequences by concatenate and cut.

All documents' ids, each document closed by ``end_id``, form one stream that is
cut into windows of ``length`` ids; only the last window may be short, so the
padding of the whole corpus is below one window.

1. Each task encodes its rows and keeps a running total: a row's place within its
   partition is known where it is encoded. The ids are written once.
2. Partition totals (one row per partition) are summed in partition order: the
   prefix sums give every partition, and so every row, its place in the stream.
3. A row's place and length say which windows it meets. Each meeting is a
   boundary record: the document, where the piece starts and ends in it, the
   window and the place there, with the ids themselves.

Encoding: white space never lies inside a token of a word-level vocabulary, and
``.,;:!?`` after a letter A-Z begins a new one, so a text is cut at both, and each
distinct word is encoded once per block, with a bounded memory of words met before.
A-Z that no combining mark can follow are lower-cased before, as the vocabulary
does. Strings of special tokens in a text are ordinary text.

Defined cases: a null text is empty, and an empty text is its end id alone; rows
with null or repeated ids are packed like any other; a text longer than a window
continues over as many as it needs, and is encoded in blocks; an empty table gives
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import BATCH_BYTES, cut, is_space, lowered, pieces, small, with_row_id, words

LENGTH = 2048
END_ID = 1
MEMORY_WORDS = 1 << 19
BLOCK_BYTES = 4 * BATCH_BYTES
AT_ONCE = 4096
_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[ord(c) for c in ".,;:!?"]] = True
_PART = 33          # a row id holds its partition above this bit


class Encoder:
    """Token ids of the rows of a flat byte buffer, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code: dict[bytes, int] = {}    # word: its place in the arrays below
        self.at = self.n = self.uses = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Of the words remembered, keep those met most often, at most half."""
        least = max(2, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        lens = self.n[kept]
        upto = np.append(0, np.cumsum(lens))
        self.ids = self.ids[np.arange(int(upto[-1])) + np.repeat(self.at[kept] - upto[:-1], lens)]
        new = np.full(len(self.uses), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.code = {w: c for w, c in zip(self.code, new[np.fromiter(self.code.values(), np.int64)].tolist(), strict=True)
                     if c >= 0}
        self.at, self.n, self.uses = upto[:-1], lens, self.uses[kept] // 2

    def _codes(self, distinct: list[bytes]) -> np.ndarray:
        """The words' places in the arrays, after encoding the new ones."""
        if len(self.uses) > MEMORY_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.code]
        found, at = [self.ids], len(self.ids)
        lens: list[int] = []
        for i in range(0, len(new), AT_ONCE):
            some = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in new[i:i + AT_ONCE]],
                                                    add_special_tokens=False)
            ids = [e.ids for e in some]
            lens += map(len, ids)
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        self.code.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
        n = np.array(lens, np.int64)
        self.ids = np.concatenate(found)
        self.at = np.concatenate([self.at, at + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        codes = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[codes] += 1
        return codes

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offset of each row's first id)."""
        starts, ends, _ = words(buf, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        border = np.zeros(len(buf) + 1, bool)
        border[1:-1] = _LETTER[buf[:-1]] & _POINT[buf[1:]]
        border[offs] = False
        more = np.flatnonzero(border)
        starts, ends = np.sort(np.append(starts, more)), np.sort(np.append(ends, more))
        first = np.searchsorted(starts, offs)
        plain = np.append(buf[1:] < 128, True)
        buf = np.where(plain, lowered(buf), buf)
        lens = ends - starts
        begin = np.cumsum(lens) - lens
        flat = buf[np.arange(int(lens.sum())) + np.repeat(starts - begin, lens)]
        bounds = np.append(begin, lens.sum()).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        per = self.n[codes]
        upto = np.append(0, np.cumsum(per))
        out = self.ids[np.arange(int(upto[-1])) + np.repeat(self.at[codes] - upto[:-1], per)]
        return out, upto[first]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def blocks(buf: np.ndarray, size: int) -> list[int]:
    """Ends of blocks of about ``size`` bytes, each cut at white space."""
    ends, at = [], size
    while at < len(buf):
        gap = np.flatnonzero(is_space(buf[at:at + size]))
        if len(gap):
            ends.append(at + int(gap[0]))
            at = ends[-1]
        at += size
    return [*ends, len(buf)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, text) to (row, id, n, before, ids): ``before`` counts the
    ids of the partition's earlier rows."""
    encoder, before = _encoder(path), 0
    for rows, buf, offs in pieces(batches, max_bytes=BLOCK_BYTES):
        if len(buf) > BLOCK_BYTES:      # one long text: its blocks one by one
            ends = blocks(buf, BLOCK_BYTES)
            parts = [encoder.encode(buf[a:b], np.array([0, b - a]))[0]
                     for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            ids = np.concatenate(parts)
            first = np.array([0, len(ids)])
        else:
            ids, first = encoder.encode(buf, offs)
        n = np.diff(first) + 1
        bounds = np.append(0, np.cumsum(n))
        closed = np.full(int(bounds[-1]), end_id, "<u4")
        own = np.ones(len(closed), bool)
        own[bounds[1:] - 1] = False
        closed[own] = ids
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(n), [
            None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(closed)])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(n), pa.array(before + bounds[:-1]), flat],
            names=["row", "id", "n", "before", "ids"])
        before += int(bounds[-1])


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = END_ID) -> DataFrame:
    """Each row's ids: (row, id, n, before, ids as little-endian 32-bit)."""
    docs = with_row_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = docs.schema["id"].dataType.simpleString()

    def run(it):
        return _encode(it, tokenizer, end_id)

    return docs.select("__row", "id", "text").mapInArrow(run, f"row long, id {kind}, n long, before long, ids binary")


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length,
    doc_tokens, sequence_id, offset (in the sequence), ids."""
    rows = cut(encode(df, tokenizer, id_col, text_col, end_id), "tokens")
    rows = rows.withColumn("part", F.shiftrightunsigned("row", _PART))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    bases = cut(totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")), "token-bases")
    rows = rows.join(small(bases, bases.count(), 32), "part").withColumn("at", F.col("base") + F.col("before"))

    def piece(window):
        lo = F.greatest(window * length, F.col("at"))
        hi = F.least((window + 1) * length, F.col("at") + F.col("n"))
        start = lo - F.col("at")
        return F.struct(start.alias("start"), (hi - lo).alias("length"), F.col("n").alias("doc_tokens"),
                        window.alias("sequence_id"), (lo - window * length).alias("offset"),
                        F.substring("ids", (start * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"))

    last = F.floor((F.col("at") + F.col("n") - 1) / length)
    windows = F.sequence(F.floor(F.col("at") / length), last)
    met = rows.select(F.col("id").alias(id_col), F.transform(windows, piece).alias("pieces"))
    return met.select(id_col, F.inline("pieces"))
