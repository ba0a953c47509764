"""Helpers shared by the operators: written tables, checked broadcasts, and
vectorised text handling over Arrow batches.

Texts are handled as one flat byte buffer per batch plus row offsets, so the
per-byte and per-word work is numpy over the whole batch. Batches are cut to
``BATCH_BYTES`` of text (one row at least), which bounds a worker's memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart.session import run_folder

BATCH_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20
_FOLDER = "_written_folder"     # of a DataFrame that cut returned

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 2**63, size=256, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, spent: Iterable[DataFrame | None] = ()) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it
    back: cuts the lineage and survives lost executors. The shuffle files behind
    it are not needed any more and go when the write is done, as do the tables
    ``spent``, which ``cut`` wrote and nothing reads after this write."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = run_folder(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    for old in spent:
        folder = old.__dict__.get(_FOLDER) if old is not None else None
        if folder:
            folder = spark._jvm.org.apache.hadoop.fs.Path(folder)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_FOLDER] = path
    return out


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if ``rows`` (counted by the caller) times ``row_bytes``
    is within ``limit``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """A unique long per row. Write the result (``cut``) before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only, in the JVM."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           max_bytes: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches with at most ``max_bytes`` of text each:
    (rows, bytes of their texts, row offsets). Null texts count as empty."""
    for batch in batches:
        k = batch.schema.get_field_index(text_col)
        texts = batch.column(k).cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        if not n:
            continue
        offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            i = j


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: start and end byte of every
    word, and the index of each row's first word (one more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    solid = buf[at + np.repeat(starts, lens)]
    part = _BYTE_KEYS[solid] * _powers(int(lens.max()))[at]
    return mix(np.add.reduceat(part, first) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the first ``n`` bytes from each start (words that long)."""
    h = np.full(len(starts), n, U64)
    for j, factor in enumerate(_powers(n)):
        h += _BYTE_KEYS[buf[starts + j]] * factor
    return mix(h)


def sort_rows(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sort each h[at[i]:at[i+1]] in place; true where a value is its row's first of its kind."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    return new


def window_hashes(wh: np.ndarray, first: np.ndarray, n: int,
                  whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words inside each row: (row, word index of
    the run's start, hash). With ``whole_if_short`` a row with 1 to n-1 words
    gives its whole sequence as one run."""
    counts = np.diff(first)
    runs = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), runs)
    begin = np.cumsum(runs) - runs
    at = np.arange(int(runs.sum())) - np.repeat(begin, runs) + np.repeat(first[:-1], runs)
    factors = mix(np.arange(1, n + 2, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
    h = np.full(len(at), factors[n], U64)
    for j in range(n):
        h += wh[at + j] * factors[j]
    h = mix(h)
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            hs = np.empty(len(short), U64)
            for k, r in enumerate(short):
                w = wh[first[r]:first[r + 1]]
                hs[k] = np.append(w * factors[:len(w)], factors[n:n + 1] * U64(len(w) + 1)).sum(dtype=U64)
            row = np.concatenate([row, short])
            at = np.concatenate([at, first[short]])
            h = np.concatenate([h, mix(hs)])
    return row, at, h


def strings(col: pa.Array) -> list[str]:
    return ["" if x is None else x for x in col.to_pylist()]
