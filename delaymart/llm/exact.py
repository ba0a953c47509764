"""Exact deduplication by composable polynomial fingerprints.

A text's normalised bytes b_0 b_1 ... are hashed as sum(b_i * x^i) mod p for
two primes. Chunk hashes combine by shifting: the hash of a concatenation is
H(a) + x^len(a) * H(b), so the chunks of one text may be hashed in any order
and place. Texts above ``huge_bytes`` are cut into chunk rows that Spark
spreads over tasks and sums per document; the others are hashed chunk by
chunk where they are read. The fingerprint is (bytes, hash, hash).

Texts with equal fingerprints are then compared in full, chunk by chunk: the
distinct contents of each (fingerprint, chunk number) are counted, with copies
collapsed map-side, and a second content is a conflict. On any conflict all
texts are fingerprinted again with one more random point in the key, until
fingerprints and texts agree. So the groups are exact, not probable.

Defined cases: a null text counts as empty; empty texts equal each other; rows
with a null id take part (the kept id is the largest non-null one); of repeated
rows with the kept id exactly one has kept = true; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import U64, cut, lower_ascii, lowered, pieces, small, with_row_id

BLOCK = 8192            # bytes per hashed block: 2^8 * 2^31 * BLOCK < 2^53
PRIMES = (2147483647, 2147483629)
COMPARE_CHARS = 1 << 16
HUGE_BYTES = 32 << 20


def _points(round_no: int, primes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(x, p) per prime for a round: fixed, different in each round."""
    rng = np.random.Generator(np.random.PCG64(7919 + round_no))
    return [(int(rng.integers(2, p - 1)), p) for p in primes]


def _powers(x: int, p: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    v = 1
    for i in range(n):
        out[i] = v
        v = v * x % p
    return out


class Hasher:
    """Polynomial residues of every row of a flat byte buffer."""

    def __init__(self, rounds: int, primes: tuple[int, ...]):
        self.points = [q for r in range(rounds) for q in _points(r, primes)]
        self.low = [_powers(x, p, BLOCK) for x, p in self.points]

    def residues(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        lens = np.diff(offs)
        blocks = -(-lens // BLOCK)
        row = np.repeat(np.arange(len(lens)), blocks)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(len(row)) - np.repeat(first, blocks)
        begin = offs[:-1][row] + nth * BLOCK
        out = []
        if len(row):
            at = np.arange(len(buf)) - np.repeat(begin, np.diff(np.append(begin, offs[-1])))
        for (x, p), low in zip(self.points, self.low, strict=True):
            total = np.zeros(len(lens), U64)
            if len(row):
                part = np.add.reduceat(low[at] * buf, begin) % U64(p)
                shift = _powers(pow(x, BLOCK, p), p, int(nth.max()) + 1)
                np.add.at(total, row, part * shift[nth] % U64(p))
            out.append((total % U64(p)).astype(np.int64))
        return out


def _fingerprint(batches: Iterator[pa.RecordBatch], rounds: int, primes: tuple[int, ...],
                 digest: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(rounds, primes)
    for rows, buf, offs in pieces(batches):
        buf = lowered(buf)
        res = hasher.residues(buf, offs)
        lens = np.diff(offs)
        fp = [":".join(map(str, v)) for v in zip(lens.tolist(), *(r.tolist() for r in res), strict=True)]
        cols = [rows.column(0), pa.array(fp, pa.string())]
        if digest:
            view = memoryview(buf)
            cols.append(pa.array([hashlib.sha256(view[a:b]).hexdigest()
                                  for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)],
                                 pa.string()))
        if with_text:
            flat = buf.tobytes()
            cols.append(pa.array([flat[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)],
                                 pa.binary()))
        yield pa.RecordBatch.from_arrays(
            cols, names=["id", "fp"] + ["sha256"] * digest + ["norm"] * with_text)


def _hash_chunks(batches: Iterator[pa.RecordBatch], rounds: int,
                 primes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (row, off, text): each chunk's residues, shifted to its offset."""
    hasher = Hasher(rounds, primes)
    for rows, buf, offs in pieces(batches):
        at = rows.column(1).to_pylist()
        res = hasher.residues(lowered(buf), offs)
        shifted = [[h * pow(x, o, p) % p for h, o in zip(r.tolist(), at, strict=True)]
                   for r, (x, p) in zip(res, hasher.points, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(offs), pa.int64()),
             pa.array(list(map(list, zip(*shifted, strict=True))), pa.list_(pa.int64()))],
            names=["row", "n", "h"])


def fingerprints(docs: DataFrame, rounds: int = 1, primes: tuple[int, ...] = PRIMES,
                 digest: bool = False, with_text: bool = False,
                 huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """(id, fp[, sha256][, norm]) for rows (id, text); ``norm`` is the
    normalised text as bytes."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, fp string" + ", sha256 string" * digest + ", norm binary" * with_text)
    huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge_bytes

    def run(it):
        return _fingerprint(it, rounds, primes, digest, with_text)

    out = docs.where(~huge).mapInArrow(run, schema)
    return out.unionByName(_huge(docs.where(huge), rounds, primes, digest, with_text, id_type))


def _huge(docs: DataFrame, rounds: int, primes: tuple[int, ...], digest: bool,
          with_text: bool, id_type: str, chunk: int = 1 << 20) -> DataFrame:
    """The same for huge texts, whose chunks are hashed as rows of their own."""
    norm = F.encode(lower_ascii(F.col("text")), "utf-8")
    keyed = docs.select("id", F.xxhash64(norm).alias("row"), norm.alias("norm"))
    parts = keyed.dropDuplicates(["row"]).select(
        "row", "norm",
        F.explode(F.sequence(F.lit(0), F.octet_length("norm") - 1, F.lit(chunk))).alias("off"))
    parts = parts.select("row", F.col("off").cast("long").alias("off"),
                         F.substring("norm", F.col("off").cast("int") + 1, F.lit(chunk)).alias("text"))

    def run(it):
        return _hash_chunks(it, rounds, primes)

    mods = [p for _ in range(rounds) for p in primes]
    keys = (parts.repartition("row", "off").mapInArrow(run, "row long, n long, h array<long>")
            .groupBy("row").agg(F.sum("n").alias("n"),
                                *[F.sum(F.col("h")[i]).alias(f"h{i}") for i in range(len(mods))])
            .select("row", F.concat_ws(":", F.col("n").cast("string"), *[
                (F.col(f"h{i}") % p).cast("string") for i, p in enumerate(mods)]).alias("fp")))
    return keyed.join(keys, "row").select(
        "id", "fp", *([F.sha2("norm", 256).alias("sha256")] if digest else []),
        *(["norm"] if with_text else []))


def conflicts(docs: DataFrame, groups: DataFrame, n_groups: int, rounds: int,
              primes: tuple[int, ...], huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """The chunks of equal fingerprints (``groups``) that hold more than one
    content. Copies collapse in each task before anything is shuffled."""
    texts = fingerprints(docs, rounds, primes, with_text=True, huge_bytes=huge_bytes)
    dup = texts.join(small(groups.select("fp"), n_groups, 48), "fp", "left_semi")
    chunks = dup.select("fp", "norm", F.explode(F.sequence(
        F.lit(0), F.greatest(F.octet_length("norm") - 1, F.lit(0)), F.lit(COMPARE_CHARS))).alias("off"))
    contents = chunks.select(
        "fp", "off", F.substring("norm", F.col("off") + 1, F.lit(COMPARE_CHARS)).alias("chunk")).distinct()
    return contents.groupBy("fp", "off").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str | Column = "text",
                primes: tuple[int, ...] = PRIMES, digest: bool = False,
                huge_bytes: int = HUGE_BYTES, max_rounds: int = 16) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept[, sha256]."""
    text = F.col(text) if isinstance(text, str) else text
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))
    for rounds in range(1, max_rounds + 1):
        rows = cut(with_row_id(fingerprints(docs, rounds, primes, digest, huge_bytes=huge_bytes)),
                   "fingerprints")
        best = F.max(F.struct("id", (-F.col("__row")).alias("r")))
        groups = cut(rows.groupBy("fp").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
                     .where("group_size > 1"), "equal-fingerprints")
        n_groups = groups.count()
        if not n_groups or conflicts(docs, groups, n_groups, rounds, primes, huge_bytes).isEmpty():
            break
    else:
        raise RuntimeError(f"fingerprints still collide after {max_rounds} points")
    out = rows.join(small(groups, n_groups, 96), "fp", "left")
    alone = F.col("best").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (-F.col("best.r") == F.col("__row"))).alias("kept"),
        *(["sha256"] if digest else []))
