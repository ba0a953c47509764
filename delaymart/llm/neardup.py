r"""Near-duplicate detection with SetSketch registers.

A text is lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; its set
is its distinct ``n``-word shingles (a shorter text is one shingle, a text
without words the empty set, linked with nothing). Two texts are linked when
their Jaccard similarity is at least ``percent`` / 100.

1. Equal sets are one class; only classes go on, so a group of copies costs one.
2. Each class has ``registers`` SetSketch registers: for register i the minimum
   of an exponential variate over the set, kept as an exponentially spaced,
   truncated level (base 1.001, a = 20, 16 bits). Registers of a union are the
   element-wise maxima, so sketches of parts merge.
3. Bands of ``rows`` registers are the candidate keys. A linked pair that agrees
   in no band has a chance of (1 - J^rows)^bands, below 3e-6 at the threshold.
4. In a bucket of up to ``MEET`` members all meet. In a larger one a member meets the
   first one of about its size, the pivot: the similarity is estimated jointly from
   both sketches and set sizes by maximum likelihood; a pair is passed on if the
   estimate is within ``SLACK`` (six standard errors) of the threshold, and
   confirmed on the full sets, which are written once. Of each member the most
   similar pair is confirmed first. Confirmed links give components; then come the
   other pairs of the small buckets that lie in two components, which settles these
   buckets. In the others a group of copies costs one comparison a member.
5. Larger buckets whose members then lie in several components are settled exactly, by a
   prefix filter over their members: two sets of similarity t share one of the
   n - ceil(t n) + 1 rarest shingles of each, and after the first of them both
   have enough shingles left to make up the rest of the overlap. Rare counts are
   taken among these members, so a crowd that only shares a passage has nothing in
   common there.
   Members that share such a shingle meet unless they are of one component by now:
   all at once where that is few, else the members outside the largest component in
   turns, each leaving once it has met all others. A turn takes up to four times as
   many as the one before, while that meets no more than ``TURN`` times the first
   turn's pairs: as buckets close, the rest is done in few turns.
   So no pair is given up, however large a bucket is, and no group of copies
   meets itself.

The result is one row per document. Documents with a null id take part and
count for no component's smallest id; rows that share id and text are alike in
the result; null and empty texts and texts of white space form no links and
keep their own id. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import (U64, cut, lowered, mix, pieces, small, sort_rows, window_hashes,
                                  with_row_id, word_hashes, words)
from delaymart.llm.components import components

REGISTERS, JUDGED = 450, 180      # registers in all, and those an estimate reads
BASE, RATE, LEVELS = 1.001, 20.0, 2**16 - 2
SLACK = 0.2
MEET = 8                          # members of a bucket that meet at once
PIVOTS, PAIRS_OF_SMALL, TURN = 128, 1 << 14, 4
_BLOCK = 1 << 15
_RNG = np.random.Generator(np.random.PCG64(977))
_MUL = _RNG.integers(1, 2**63, REGISTERS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _RNG.integers(1, 2**63, REGISTERS, dtype=np.int64).astype(U64)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row: (hashes, row offsets)."""
    buf = lowered(buf)
    starts, ends, first = words(buf, offs)
    row, _, h = window_hashes(word_hashes(buf, starts, ends), first, n, whole_if_short=True)
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    every = np.arange(len(offs))
    new = sort_rows(h, np.searchsorted(row, every))
    return h[new], np.searchsorted(row[new], every)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sums of x over [at[i], at[i+1])."""
    total = np.append(U64(0), np.cumsum(x, dtype=U64))
    return total[at[1:]] - total[at[:-1]]


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS) of the sets h[at[i]:at[i+1]];
    zero for empty sets."""
    n = len(at) - 1
    low = np.full((REGISTERS, n), 2**32 - 1, U64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
        full = np.flatnonzero(at[i + 1:j + 1] > at[i:j]) + i
        if len(full):
            x = h[at[i]:at[j]]
            t, begin = np.empty_like(x), at[full] - at[i]
            for r in range(REGISTERS):
                np.multiply(x, _MUL[r], out=t)
                np.add(t, _ADD[r], out=t)
                np.right_shift(t, U64(32), out=t)
                low[r, full] = np.minimum.reduceat(t, begin)
        i = j
    least = -np.log1p(-(low.T + 0.5) / 2**32) / RATE
    level = np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)
    level[at[1:] == at[:-1]] = 0
    return level


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches):
        h, at = shingle_sets(buf, offs, n)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(at), pa.int64()),
             pa.array(_sums(mix(h), at).view(np.int64)),
             pa.array(_sums(mix(h ^ U64(0x5851F42D4C957F2D)), at).view(np.int64)),
             pa.array([r.tobytes() for r in registers(h, at)], pa.binary())],
            names=["id", "n", "k1", "k2", "regs"])


def _full_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(n, k1, k2, set), each set once per task."""
    seen: set[tuple[int, int]] = set()
    for _, buf, offs in pieces(batches):
        h, at = shingle_sets(buf, offs, n)
        k1, k2 = _sums(mix(h), at), _sums(mix(h ^ U64(0x5851F42D4C957F2D)), at)
        new = []
        for i, k in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
            if k not in seen and at[i + 1] > at[i]:
                seen.add(k)
                new.append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.diff(at)[new], pa.int64()), pa.array(k1[new].view(np.int64)),
             pa.array(k2[new].view(np.int64)),
             pa.array([h[at[i]:at[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))],
            names=["n", "k1", "k2", "set"])


def _levels(col: pa.Array, n: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, n)


def _band_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(cid, n, regs) to (key, cid, n): one row per band, the band in the key."""
    bands = REGISTERS // rows
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            lv = _levels(part.column(2))[:, :bands * rows].reshape(-1, bands, rows).astype(U64)
            f = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
            key = mix((lv * f).sum(axis=2, dtype=U64) + mix(np.arange(bands, dtype=U64) + U64(101)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)),
                 pa.array(np.repeat(part.column(0).to_numpy(), bands)),
                 pa.array(np.repeat(part.column(1).to_numpy(), bands))], names=["key", "cid", "n"])


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray,
                       grid: int = 201) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two rows of registers and the
    set sizes: register i is larger in a, larger in b or equal with chances
    p(u - vJ), p(v - uJ) and the rest, where u and v are the sizes' shares."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, grid)[None, :]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p1, p2 = p(u - v * j), p(v - u * j)
    p0 = np.clip(1 - p1 - p2, 1e-12, 1)
    ll = more * np.log(p1 + 1e-12) + less * np.log(p2 + 1e-12) + same * np.log(p0)
    return np.take_along_axis(j, ll.argmax(axis=1)[:, None], 1)[:, 0]


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, nu, nv, ru, rv, every) to (u, v, every, est)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            p = batch.slice(i, 2048)
            nu, nv = p.column(2).to_numpy(), p.column(3).to_numpy()
            est = likelihood_jaccard(_levels(p.column(4), JUDGED), _levels(p.column(5), JUDGED), nu, nv)
            yield pa.RecordBatch.from_arrays([*p.columns[:2], p.column(6), pa.array(est)], names=["u", "v", "every", "est"])


class NearDuplicates:
    """The search over one table; see the module's text for the steps."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 7):
        self.docs, self.shingle, self.percent, self.rows = docs, shingle, percent, rows

    def sketches(self) -> DataFrame:
        n, kind = self.shingle, self.docs.schema["id"].dataType.simpleString()

        def run(it):
            return _sketch(it, n)

        return cut(self.docs.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, regs binary"), "sketches")

    def bands(self, classes: DataFrame) -> DataFrame:
        rows = self.rows

        def run(it):
            return _band_keys(it, rows)

        return classes.select("cid", "n", "regs").mapInArrow(run, "key long, cid long, n long")

    def members(self, cids: DataFrame, count: int, classes: DataFrame) -> DataFrame:
        """(cid, n, regs) of some classes, with the registers an estimate reads."""
        known = classes.join(small(cids, count, 16), "cid", "left_semi")
        known = cut(known.select("cid", "n", F.substring("regs", 1, 2 * JUDGED).alias("regs")), "members")
        return small(known, count, 2 * JUDGED + 40)

    def estimates(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """(u, v, every, est) of the pairs (u, v, every) whose sizes allow the threshold."""
        both = pairs.join(members.toDF("v", "nv", "rv"), "v").join(members.toDF("u", "nu", "ru"), "u")
        both = both.where(100 * F.least("nu", "nv") >= self.percent * F.greatest("nu", "nv"))
        est = both.select("u", "v", "nu", "nv", "ru", "rv", "every").mapInArrow(
            _estimate, "u long, v long, every boolean, est double")
        return cut(est.where(F.col("est") >= self.percent / 100 - SLACK), "estimates")

    def full_sets(self, cids: DataFrame, count: int, classes: DataFrame) -> DataFrame:
        """(cid, n, set) of some classes, from their texts."""
        n = self.shingle
        wanted = cut(classes.select("cid", "rep", "n", "k1", "k2").join(small(cids, count, 16), "cid", "left_semi"),
                     "wanted")
        ids = wanted.select(F.col("rep")).distinct()
        texts = self.docs.join(small(ids, count, 32), F.col("id").eqNullSafe(F.col("rep")), "left_semi")

        def run(it):
            return _full_sets(it, n)

        # Every copy of a representative's id may give the set: one is taken.
        sets = texts.mapInArrow(run, "n long, k1 long, k2 long, set array<long>")
        keys = small(wanted.select("cid", "n", "k1", "k2"), count, 48)
        sets = sets.join(keys, ["n", "k1", "k2"]).select("cid", "n", "set")
        return cut(sets.dropDuplicates(["cid"]), "sets", [wanted])

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The written pairs (u, v), spent by it, whose full sets reach the threshold."""
        written, pairs, count = pairs, pairs.select("u", "v"), pairs.count()
        ends = pairs.select(F.explode(F.array("u", "v")).alias("cid"))
        sets = sets.select("cid", "n", "set").join(small(ends, 2 * count, 16), "cid", "left_semi")
        both = (sets.toDF("v", "nv", "sv").join(small(pairs, count, 24), "v")
                .join(sets.toDF("u", "nu", "su"), "u"))
        common = F.size(F.array_intersect("su", "sv"))
        return cut(both.where(100 * common >= self.percent * (F.col("nu") + F.col("nv") - common)).select("u", "v"),
                   "confirmed", [written])

    def join_up(self, links: DataFrame, comp: DataFrame | None) -> DataFrame | None:
        """The components with the links added; both are spent by it."""
        if links.isEmpty():
            return comp
        spent, every = [links, comp], links
        if comp is not None:
            every = links.unionByName(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")))
        return cut(components(every), "components", spent)

    def buckets(self, classes: DataFrame) -> DataFrame:
        """(key, cid, n, c, pivot) of the members of buckets with c > 1 of them. The
        first pass shuffles keys only; few rows are left for the second."""
        about = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.percent))).cast("int")
        band = self.bands(classes)
        keys = cut(band.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-keys")
        band = cut(band.join(small(keys, keys.count(), 24), "key").withColumn("about", about), "shared")
        per = band.groupBy("key", "about").agg(F.min("cid").alias("pivot"))
        return cut(band.join(per, ["key", "about"]).select("key", "cid", "n", "c", "pivot"), "buckets", [keys, band])

    def first_pairs(self, buckets: DataFrame) -> DataFrame:
        """(u, v, every): all pairs of the buckets with up to ``MEET`` members whose sizes
        allow the threshold, and the members of the others with their pivots."""
        of = F.sort_array(F.collect_list(F.struct("cid", "n")))
        per = buckets.where(F.col("c") <= MEET).groupBy("key").agg(of.alias("all")).select("all", F.explode("all").alias("a"))
        later = F.filter("all", lambda b: (b["cid"] > F.col("a.cid")) & (
            100 * F.least(b["n"], F.col("a.n")) >= self.percent * F.greatest(b["n"], F.col("a.n"))))
        met = per.select(F.col("a.cid").alias("u"), F.explode(later).alias("b")).select(
            "u", F.col("b.cid").alias("v"), F.lit(True).alias("every"))
        large = buckets.where((F.col("c") > MEET) & (F.col("cid") > F.col("pivot"))).select(
            F.col("pivot").alias("u"), F.col("cid").alias("v"), F.lit(False).alias("every"))
        return met.unionByName(large).groupBy("u", "v").agg(F.max("every").alias("every"))

    def apart(self, pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
        """The pairs whose ends are not yet in one component."""
        if comp is None:
            return pairs
        for end in ("u", "v"):
            pairs = pairs.join(comp.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
        return pairs.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    def prefixes(self, cids: DataFrame, sets: DataFrame) -> DataFrame:
        """(key, cid, n, left): of each class the shingles that a linked one must share
        one of, rarest first, without those that no other class has, each with the
        number of shingles from it on."""
        rows = sets.join(cids, "cid").select("cid", "n", F.explode("set").alias("key"))
        often = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
        rows = rows.join(small(often, often.count(), 24), "key")
        mine = Window.partitionBy("cid")
        rows = rows.withColumns({"rank": F.row_number().over(mine.orderBy("c", "key")), "shared": F.count(F.lit(1)).over(mine)})
        rows = rows.withColumn("left", F.col("shared") - F.col("rank") + 1)
        length = F.col("n") - F.floor((self.percent * F.col("n") + 99) / 100) + 1
        return cut(rows.where(F.col("n") - F.col("left") < length).select("key", "cid", "n", "left"), "prefixes", [often])

    def search(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(sketches, classes, components of classes or None without links)."""
        rows = self.sketches()
        classes = cut(with_row_id(
            rows.where("n > 0").groupBy("n", "k1", "k2")
            .agg(F.min("id").alias("rep"), F.first("regs").alias("regs")), "cid"), "classes")
        first = self.buckets(classes)
        if first.isEmpty():
            return rows, classes, None
        cids = cut(first.select("cid").distinct(), "in-buckets")
        count = cids.count()
        sets, members = self.full_sets(cids, count, classes), self.members(cids, count, classes)
        found = self.estimates(self.first_pairs(first), members)
        best = found.groupBy("v").agg(F.max(F.struct("est", "u")).alias("b"))
        best = cut(best.select("b.u", "v"), "best")
        others = found.where("every").join(best, ["u", "v"], "left_anti").select("u", "v")
        others = cut(others, "others", [found])
        comp = self.join_up(self.confirm(best, sets), None)
        others = cut(self.apart(others, comp), "apart", [others])
        if not others.isEmpty():
            comp = self.join_up(self.confirm(others, sets), comp)
        large = first.where(F.col("c") > MEET).select("key", "cid", "n", F.col("n").alias("left"))
        active, _ = self._open(large, comp, [first, cids])
        if active.isEmpty():
            return rows, classes, comp
        active = self.prefixes(active.select("cid").distinct(), sets)
        spent, limit, many = [active], 0, PIVOTS
        while True:
            active, several = self._open(active, comp, spent)
            size = several.agg(F.sum("size")).first()[0]
            if not size:
                return rows, classes, comp
            limit = limit or TURN * PIVOTS * size
            pivots = cut(self._pivots(active, several, many), "pivots", [several])
            many = max(PIVOTS, min(4 * many, limit // size))
            pairs = (active.join(pivots, "key").where(
                        (F.col("comp") != F.col("comp_u"))
                        & (100 * F.least("n", "nu") >= self.percent * F.greatest("n", "nu"))
                        & ((100 + self.percent) * F.least("left", "left_u") >= self.percent * (F.col("n") + F.col("nu"))))
                     .select(F.least("u", "cid").alias("u"), F.greatest("u", "cid").alias("v")).distinct()
                     .withColumn("every", F.lit(True)))
            comp = self.join_up(self.confirm(self.estimates(pairs, members), sets), comp)
            done = pivots.select("key", F.col("u").alias("cid"))
            spent = [active, pivots]
            active = active.select("key", "cid", "n", "left").join(done, ["key", "cid"], "left_anti")

    def _open(self, active: DataFrame, comp: DataFrame | None,
              spent: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The members (with their component) of buckets with more than one
        component, and those buckets with their size and number of outsiders.
        ``spent`` are the written tables behind ``active``."""
        if comp is None:
            named = active.select("key", "cid", "n", "left", F.col("cid").alias("comp"))
        else:
            named = (active.select("key", "cid", "n", "left")
                     .join(comp.select(F.col("node").alias("cid"), F.col("comp").alias("c")), "cid", "left")
                     .select("key", "cid", "n", "left", F.coalesce("c", "cid").alias("comp")))
        named = cut(named, "labelled", spent)
        per = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        several = per.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("main"))
        several = cut(several.where(F.col("size") > F.col("main.c")).select(
            "key", "size", (F.col("size") - F.col("main.c")).alias("outside"), F.col("main.comp").alias("main")),
            "open-buckets")
        return cut(named.join(several.select("key"), "key", "left_semi"), "active", [named]), several

    @staticmethod
    def _pivots(active: DataFrame, several: DataFrame, many: int = PIVOTS) -> DataFrame:
        """About ``many`` outsiders of each bucket (more of a small one), the
        same ones in all buckets as far as possible."""
        rank = F.pmod(F.xxhash64("cid", F.lit(29)), F.lit(1 << 40))
        outside = active.join(several, "key").where("comp != main").withColumn("rank", rank)
        least = outside.groupBy("key").agg(F.min("rank").alias("least"))
        part = F.greatest(F.lit(float(many)), PAIRS_OF_SMALL / F.col("size")) / F.col("outside") * float(1 << 40)
        return (outside.join(least, "key").where((F.col("rank") == F.col("least")) | (F.col("rank") < part))
                .select("key", F.col("cid").alias("u"), F.col("n").alias("nu"), F.col("left").alias("left_u"),
                        F.col("comp").alias("comp_u")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, rows: int = 7) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows_, classes, comp = NearDuplicates(docs, shingle, percent, rows).search()
    if comp is None:
        best = classes.select("n", "k1", "k2", F.col("rep").alias("best"))
    else:
        named = classes.select("cid", "n", "k1", "k2", "rep").join(
            comp.select(F.col("node").alias("cid"), "comp"), "cid", "left")
        named = named.withColumn("comp", F.coalesce("comp", "cid"))
        low = named.groupBy("comp").agg(F.min("rep").alias("best"))
        best = named.join(low, "comp").select("n", "k1", "k2", "best")
    out = rows_.select("id", "n", "k1", "k2").join(best, ["n", "k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("best")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
