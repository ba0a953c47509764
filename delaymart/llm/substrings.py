"""Substring deduplication by content-defined chunks.

A gear hash rolls over the lower-cased (A-Z) bytes (window ``REACH``). Chunks
begin at words whose gear hash is the smallest of some ``window`` consecutive
words: a choice that depends on nearby content alone, so an insertion moves the
borders next to it and no others, and no chunk is longer than ``window`` words.
A digest is a hash of the words of two neighbouring chunks (short chunks alone
often recur by chance). The gear window holds the white space between words, so
copies that are wrapped differently have other borders around each difference,
and runs there may be missed.

A digest that occurs more than once marks its two chunks as repeated; maximal
runs of repeated chunks with at least ``min_words`` words are the result. Two
copies of a passage of L words share all its chunks but those at its ends, where
the gear window and one chunk may reach outside: at least L - 2 * window - 3
words. With 11 words a chunk at most, every repeated passage of over 50 words with the
same white space is found as a run of 25 or more.

Digests are counted with partial sums, so a passage that a third of all texts
share is one row per task; occurrences then join the repeated digests, and hot
ones are split by the skew join.

Defined cases: null and empty texts have no chunks; a text of fewer words than
a window is one chunk, which is its own neighbour; repetition within a text counts; the first occurrence is
the one with the smallest id (null last), then position; repeated rows repeat
each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import U64, cut, lowered, mix, pieces, with_row_id, word_hashes, words

WINDOW = 11
MIN_WORDS = 25
REACH = 16
_GEAR = np.random.Generator(np.random.PCG64(4242)).integers(1, 2**63, 256, dtype=np.int64).astype(U64)


def gear(buf: np.ndarray, reach: int = REACH) -> np.ndarray:
    """At each byte the gear hash sum(G[b[i + k]] << k) of the ``reach`` (a
    power of two) bytes that begin there, built by doubling; zero beyond the end."""
    h = _GEAR[buf]
    n = 1
    while n < reach:
        h[:max(len(h) - n, 0)] += h[n:] << U64(n)
        n *= 2
    return h


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i:i+n] for each i that has n values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = pick(x[:len(x) - step], x[step:])
        done += step
    return x


def borders(h: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a chunk: the smallest of some window of words in
    their row; a row's first word always does."""
    n = len(h)
    out = np.zeros(n, bool)
    out[first[:-1][np.diff(first) > 0]] = True
    if n >= window:
        low = _slide(h, window, np.minimum)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        low[row[:len(low)] != row[window - 1:]] = 0  # windows over two rows choose nothing
        pad = np.zeros(window - 1, U64)
        high = _slide(np.concatenate([pad, low, pad]), window, np.maximum)
        out |= (high == h) & (high > 0)
    return out


def chunk(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW):
    """Chunks of each row in order: (row, nth in row, words, from byte, to byte, digest)."""
    buf = lowered(buf)
    starts, ends, first = words(buf, offs)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, U64),)
    # each row's bytes end in the hash's reach of zeros, so that rows do not mix
    lens = np.diff(offs)
    apart = np.zeros(len(buf) + REACH * len(lens), np.uint8)
    shift = np.repeat(np.arange(len(lens)) * REACH, lens)
    apart[np.arange(len(buf)) + shift] = buf
    h = mix(gear(apart)[starts + shift[starts]]) | U64(1)
    begin = np.flatnonzero(borders(h, first, window))
    row = np.searchsorted(first, begin, "right") - 1
    n = np.diff(np.append(begin, len(starts)))
    nth = np.arange(len(begin)) - np.searchsorted(begin, first[row])
    place = np.arange(len(starts)) - np.repeat(begin, n)
    factor = mix(np.arange(1, int(n.max()) + 1, dtype=U64)) | U64(1)
    digest = mix(np.add.reduceat(word_hashes(buf, starts, ends) * factor[place], begin) + n.astype(U64))
    return row, nth, n, starts[begin] - offs[row], ends[begin + n - 1] - offs[row], digest


def pairs(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW):
    """Neighbouring chunks: (row, nth in row, words of the first, of the second,
    from byte, to byte, digest of both)."""
    row, nth, n, a, b, digest = chunk(buf, offs, window)
    if not len(row):
        return row, nth, n, n, a, b, digest
    after = np.append(row[1:], -1) == row
    alone = ~after & (nth == 0)
    nxt = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
    both = np.where(after, mix(digest * U64(0x9E3779B97F4A7C15) + digest[nxt]), digest)
    keep = after | alone
    return (row[keep], nth[keep], n[keep], np.where(after, n[nxt], 0)[keep], a[keep],
            np.where(after, b[nxt], b)[keep], both[keep])


def _digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for _, buf, offs in pieces(batches):
        d, n = np.unique(pairs(buf, offs, window)[-1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(n)], names=["digest", "n"])


def _pair_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches):
        row, nth, n, m, a, b, digest = pairs(buf, offs, window)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(take), rows.column(1).take(take), *[pa.array(x.astype(np.int32)) for x in (nth, n, m)],
             pa.array(a), pa.array(b), pa.array(digest.view(np.int64))],
            names=["id", "row", "nth", "words", "more", "a", "b", "digest"])


def pair_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every pair of neighbouring chunks of rows (id, row, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(it):
        return _pair_rows(it, window)

    return docs.select("id", "row", "text").mapInArrow(
        run, f"id {kind}, row long, nth int, words int, more int, a long, b long, digest long")


def repeated_pairs(df: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The pairs whose digest occurs more than once, with ``copies`` and
    ``first`` (id, byte) of the first occurrence."""
    docs = df.select(F.col(id_col).alias("id"), "text")

    def run(it):
        return _digests(it, window)

    counts = docs.select("text").mapInArrow(run, "digest long, n long").groupBy("digest").agg(
        F.sum("n").alias("copies")).where("copies > 1")
    found = cut(pair_rows(with_row_id(docs, "row"), window).join(cut(counts, "digests"), "digest"), "repeated")
    firsts = found.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("a").alias("at"))).alias("first"))
    return found.join(cut(firsts, "firsts"), "digest")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", window: int = WINDOW,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of repeated chunks with at least ``min_words`` words: id, from_byte,
    to_byte, n_words, later_words (in chunks that occurred before), first_id."""
    rows = repeated_pairs(df, id_col, window)
    later = ~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.at") == F.col("a")))
    rows = rows.select("id", "row", "nth", "words", "more", "a", "b", "copies", later.alias("later"),
                       F.col("first.id").alias("first_id"))
    order = Window.partitionBy("row").orderBy("nth")
    rows = rows.withColumn("run", F.col("nth") - F.row_number().over(order))
    late = F.when(F.col("later"), 1).otherwise(0)
    spans = rows.groupBy("row", "run").agg(
        F.min("id").alias("id"), F.min("a").alias("from_byte"), F.max("b").alias("to_byte"),
        (F.sum("words") + F.max_by("more", "nth")).alias("n_words"),
        (F.sum(F.col("words") * late) + F.max_by(F.col("more") * late, "nth")).alias("later_words"),
        F.max("copies").alias("copies"), F.min("first_id").alias("first_id"))
    return spans.where(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "from_byte", "to_byte", "n_words", "later_words", "copies", "first_id")
