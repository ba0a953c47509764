"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Words are lower-cased (A-Z) with ASCII punctuation taken as space. The score is
the best local alignment of an item's words with the document's (match 2,
mismatch and gap -1) as a part of the item's best possible one; at ``threshold``
or more the passage is a copy, edited or not. An item of n words that reaches
threshold t has at most 2n(1 - t) unmatched columns between its matches, so at
least nt - 1 of its neighbouring matches lie at most one column apart. Seeds are
therefore pairs of words, next to each other or one apart, on both sides; where
that many lie within 2n(1 - t) diagonals, a window is taken that holds the whole
alignment. It is aligned if enough of the item's words occur in it at all. All
three are bounds of the score, so for items of four words or more nothing that
reaches a threshold of 0.5 or more is lost. Shorter items are found as a whole.

The benchmark is the stated query set: it is taken in blocks of at most
``BLOCK_BYTES`` of text, each of which goes to the tasks as one broadcast value,
and every block meets all documents. Documents are never shuffled.

Defined cases: null or empty texts match nothing; items without words are
never found; repeated rows and repeated item ids are each reported; an empty
table gives no rows; other columns are not read (``drop_contaminated`` carries
them through and reports by row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import U64, cut, lowered, mix, pieces, small, window_hashes, with_row_id, word_hashes, words

SEED = 4
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
_HITS = 1 << 20

_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_BARE = np.arange(256, dtype=np.uint8)
_BARE[_PUNCT] = 32
_PAIR = mix(np.arange(1, 3, dtype=U64)) | U64(1)


def _tokens(buf: np.ndarray, offs: np.ndarray):
    flat = _BARE[lowered(buf)]
    starts, ends, first = words(flat, offs)
    return starts, ends, first, word_hashes(flat, starts, ends)


def _pairs(wh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word with the next and with the one after that, alike hashed: (row,
    index of the first word, hash), by row."""
    count = np.diff(first)
    at = np.concatenate([np.arange(len(wh)), np.arange(len(wh))])
    gap = np.repeat([1, 2], len(wh))
    row = np.tile(np.repeat(np.arange(len(count)), count), 2)
    inside = at + gap < first[row + 1]
    row, at, gap = row[inside], at[inside], gap[inside]
    order = np.argsort(row, kind="stable")
    row, at, gap = row[order], at[order], gap[order]
    return row, at, mix(wh[at] * _PAIR[0] + wh[at + gap] * _PAIR[1])


class Items:
    """One block of the benchmark: word hashes per item, and seeds as sorted
    (hash) with their (item, position): pairs under 0, whole short items under
    their number of words."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        offs = np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64))
        _, _, first, wh = _tokens(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.ids = ids
        self.words = [wh[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        n = np.diff(first)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.n = n
        for size in range(SEED):
            if size:
                row, at, h = window_hashes(wh, first, size)
                mine = n[row] == size
            else:
                row, at, h = _pairs(wh, first)
                mine = n[row] >= SEED
            row, at, h = row[mine], at[mine] - first[row[mine]], h[mine]
            if len(h):
                order = np.argsort(h, kind="stable")
                self.seeds[size] = (h[order], row[order], at[order])


def _hits(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which of the runs are seeds."""
    if not len(seeds):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
    return np.flatnonzero(seeds[at] == h)


def align(item: np.ndarray, text: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman over word hashes, a row of the table at a time: (best
    score, first and last word of the text it covers; last exclusive)."""
    n, m = len(item), len(text)
    table = np.zeros((n + 1, m + 1), np.int32)
    step = gap * np.arange(m + 1, dtype=np.int32)
    for i in range(n):
        here = np.maximum(table[i] - gap, 0)
        here[1:] = np.maximum(here[1:], table[i, :-1] + np.where(text == item[i], match, -miss))
        table[i + 1] = np.maximum.accumulate(here + step) - step
    best = int(table.max(initial=0))
    if not best:
        return 0, 0, 0
    i, j = (int(x) for x in np.unravel_index(table.argmax(), table.shape))
    end = j
    while table[i, j] > 0:
        if i and j and table[i, j] == table[i - 1, j - 1] + (match if text[j - 1] == item[i - 1] else -miss):
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return best, j, end


def _windows(wh: np.ndarray, first: np.ndarray, items: Items, threshold: float):
    """(document, item, first and last word of the document; last exclusive) of
    the windows that can hold a copy."""
    slack = np.floor(2 * items.n * (1 - threshold) + 1e-9).astype(np.int64).clip(0)
    for size, (seeds, item, at_item) in items.seeds.items():
        row, at, h = window_hashes(wh, first, size) if size else _pairs(wh, first)
        hit = _hits(h, seeds)
        row, at = row[hit], at[hit] - first[row[hit]]
        lo, hi = np.searchsorted(seeds, h[hit], "left"), np.searchsorted(seeds, h[hit], "right")
        total = np.append(0, np.cumsum(hi - lo))
        need = np.ceil(items.n * threshold - 1 - 1e-9).clip(1) if not size else np.ones(len(items.n))
        i = 0
        while i < len(hit):  # whole documents with about _HITS hits at once
            j = int(np.searchsorted(total, total[i] + _HITS, "right")) - 1
            j = int(np.searchsorted(row, row[min(max(j, i), len(row) - 1)], "left"))
            if j <= i:
                j = int(np.searchsorted(row, row[i], "right"))
            if total[-1] - total[i] <= _HITS:
                j = len(hit)
            c = (hi - lo)[i:j]
            k = np.arange(int(c.sum())) + np.repeat(lo[i:j] - (total[i:j] - total[i]), c)
            r, it, diag = np.repeat(row[i:j], c), item[k], np.repeat(at[i:j], c) - at_item[k]
            order = np.lexsort((diag, it, r))
            r, it, diag = r[order], it[order], diag[order]
            group = np.cumsum(np.append(True, (r[1:] != r[:-1]) | (it[1:] != it[:-1])))
            key = (group << 36) + diag + (1 << 30)
            near = np.searchsorted(key, key + slack[it], "right") - np.arange(len(key))
            take = near >= need[it]
            r, it, diag, group = r[take], it[take], diag[take], group[take]
            if len(r):
                wide = items.n[it] + 2 * slack[it]
                new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (np.diff(diag) > wide[1:])))
                last = np.append(new[1:], len(r)) - 1
                m = np.diff(first)[r[new]]
                yield from zip(r[new].tolist(), it[new].tolist(), np.maximum(0, diag[new] - slack[it[new]]).tolist(),
                               np.minimum(m, (diag + items.n[it] + slack[it])[last]).tolist(), strict=True)
            i = j


def _search(wh: np.ndarray, windows: list[tuple[int, int, int]], items: Items, threshold: float):
    """Best passage of each item in one document, from windows (item, first
    and last word)."""
    spots: dict[int, list[tuple[int, int]]] = {}
    for item, a, b in windows:
        spots.setdefault(item, []).append((a, b))
    for item, merged in spots.items():
        perfect = 2 * len(items.words[item])
        best = (0.0, 0, 0)
        for a, b in merged:
            for lo in range(a, b, 4096):  # a run of copies is aligned piecewise, overlapping
                hi = min(b, lo + 4096 + 2 * perfect)
                if 2 * np.isin(items.words[item], wh[lo:hi]).sum() < threshold * perfect:
                    continue
                s, i, j = align(items.words[item], wh[lo:hi])
                if s / perfect > best[0]:
                    best = (s / perfect, lo + i, lo + j)
        if best[0] >= threshold:
            yield item, *best


def _find(batches: Iterator[pa.RecordBatch], items: Items, threshold: float) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches):
        starts, ends, first, wh = _tokens(buf, offs)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r, item, a, b in _windows(wh, first, items, threshold):
            found.setdefault(r, []).append((item, a, b))
        out: list[tuple] = []
        for r, hits in found.items():
            for item, score, i, j in _search(wh[first[r]:first[r + 1]], hits, items, threshold):
                a, b = int(starts[first[r] + i] - offs[r]), int(ends[first[r] + j - 1] - offs[r])
                out.append((r, items.ids[item], score, j - i, a, b))
        take = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(take), pa.array([o[1] for o in out], pa.int64()),
             *[pa.array([o[k] for o in out], t) for k, t in ((2, pa.float64()), (3, pa.int32()),
                                                             (4, pa.int64()), (5, pa.int64()))]],
            names=["id", "item_id", "score", "n_words", "from_byte", "to_byte"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    bench = benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        rows = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if rows:
            yield Items([r["i"] for r in rows], [r["t"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item it holds: id, item_id, score,
    n_words, from_byte, to_byte of the best passage."""
    texts = docs.select(F.col(id_col).alias("id"), "text")
    spark = docs.sparkSession
    schema = (f"id {texts.schema['id'].dataType.simpleString()}, item_id long, score double, "
              "n_words int, from_byte long, to_byte long")
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(items)

        def find(it, block=block):
            return _find(it, block.value, threshold)

        out = out.unionByName(texts.mapInArrow(find, schema))
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns. Ids need
    not be unique: each row is judged by its own text."""
    rows = cut(with_row_id(docs), "rows")
    bad = cut(contaminated(rows, benchmark, threshold, id_col="__row").select("__row").distinct(), "contaminated")
    return rows.join(small(bad, bad.count(), 16), "__row", "left_anti").select(*docs.columns)
