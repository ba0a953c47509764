r"""Phrase collocations mined from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those
into words ``[^\x20\x09]+``. Everything is per language (null: ``und``).

1. Edges. At every word the longest phrase that begins there is taken: ``width``
   words, or fewer at the end of a piece. A phrase of ``width`` words is an edge
   between two overlapping nodes, its first and its last width - 1 words. Equal
   edges are summed where the texts are read, then by a shuffle on the source
   node, which brings all edges out of a node together.
2. Shorter counts. A phrase of m words is followed by a word, and then begins a
   phrase of m + 1 words, or it ends its piece. So its count is the flow out of
   its node plus the number of pieces that end with it (the shorter phrases taken
   there); level by level, each length follows from the next longer one without
   reading the texts again. A phrase below ``least`` occurrences is kept only as
   flow into its prefix.
3. Unary paths. An edge as frequent as both its nodes is the only way out of one
   and the only way into the other, with no piece that begins or ends between:
   such edges chain into paths of one weight. On a path only what an edge adds
   needs to be looked at (its last word pair and its target node), its two nodes
   need no counts looked up, and the phrases inside need no comparison by edge.
   ``paths`` follows the chains by pointer doubling.
4. A candidate is scored at its cuts into two parts; the lowest score counts. A
   candidate that mostly occurs inside one longer candidate is dropped.

The edges are summed in ``passes`` runs over the texts, by a hash of the first two
words, which bounds the shuffle files alive at a time; results do not depend on it.

Scale: a hot edge is one row per block of text; the shuffle is by three words, so a
hot word or word pair is spread over its continuations. Joins are on phrases, and
hot parts are split by the skew join. Only each language's best rows are ranked.

Defined cases: null and empty texts, and texts of separators, have no words; a
null language is ``und``; repeated rows count each time; ties in score and count
go by phrase (UTF-8 bytes); ids are not read, nor are other columns; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import U64, cut, lowered, mix, pieces, word_hashes

WIDTH, LEAST, BEST, PASSES = 4, 30, 2000, 2
_GAP = np.zeros(256, np.uint8)
# Fixed by the contract: 1 separates words, 2 separates pieces.
_GAP[[0x20, 0x09]] = 1
_GAP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


def piece_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: start byte, end byte, piece (a number that no two
    pieces share) and row of each."""
    kind = _GAP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    solid = kind == 0
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    piece = np.cumsum(kind == 2)[starts] + row if len(starts) else row
    return starts, ends, piece, row


def longest_phrases(buf: np.ndarray, offs: np.ndarray, width: int, turn: int = 0,
                    passes: int = 1) -> tuple[pa.Array, np.ndarray]:
    """The phrase of up to ``width`` words that begins at each word (words joined by
    one space) and its row, of the words whose first pair falls to this pass."""
    buf = lowered(buf)
    starts, ends, piece, row = piece_words(buf, offs)
    stop = np.flatnonzero(np.append(piece[1:] != piece[:-1], np.ones(min(len(piece), 1), bool)))
    last = np.repeat(stop, np.diff(stop, prepend=-1))
    at = np.arange(len(starts))
    if passes > 1:
        h = word_hashes(buf, starts, ends)
        second = np.where(last > at, np.append(h[1:], U64(0)), U64(0))
        at = np.flatnonzero(mix(h + second * U64(3)) % U64(passes) == U64(turn))
    # The words once more, each followed by one space, so that a phrase is a slice.
    lens = ends - starts + 1
    begin = np.cumsum(lens) - lens
    total = int(lens.sum())
    flat = buf[np.minimum(np.arange(total) + np.repeat(starts - begin, lens), max(len(buf) - 1, 0))]
    flat[begin + lens - 1] = 32
    to = np.minimum(at + width - 1, last[at])
    size = begin[to] + lens[to] - 1 - begin[at]
    upto = np.append(0, np.cumsum(size))
    data = flat[np.arange(int(upto[-1])) + np.repeat(begin[at] - upto[:-1], size)]
    grams = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data))
    return grams, row[at]


def _edges(batches: Iterator[pa.RecordBatch], width: int, turn: int, passes: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the phrases (lang, phrase, c) of one pass, summed per block."""
    for rows, buf, offs in pieces(batches, max_bytes=4 << 20):
        if not len(buf):
            continue
        grams, row = longest_phrases(buf, offs, width, turn, passes)
        langs = rows.column(0).fill_null("und").dictionary_encode()
        found = pa.table({"lang": pa.array(langs.indices.to_numpy()[row]), "phrase": grams})
        found = found.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
        out = pa.table({"lang": langs.dictionary.take(found["lang"].combine_chunks()),
                        "phrase": found["phrase"].cast(pa.string()), "c": found["count_all"]})
        yield from out.to_batches(max_chunksize=1 << 16)


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def first_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def last_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", -n)


def _level(rows: DataFrame, keys: list[str], m: int, least: int) -> DataFrame:
    """Sum the phrases of m words and fewer; hand them on to their prefixes of
    m - 1 words, and set aside (``done``) those of m words that are frequent."""
    total = rows.groupBy(*keys, "phrase", "done").agg(F.sum("c").alias("c"))
    keep = ~F.col("done") & (F.col("c") >= least) & (n_words(F.col("phrase")) == m)
    on = F.struct(F.when(F.col("done"), F.col("phrase")).otherwise(first_words(F.col("phrase"), m - 1)).alias("phrase"),
                  F.col("done"), F.col("c"))
    aside = F.when(keep, F.struct("phrase", F.lit(True).alias("done"), F.col("c")))
    return total.select(*keys, F.inline(F.array(on, aside))).where("c is not null")


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = WIDTH,
                  least: int = LEAST, passes: int = PASSES) -> DataFrame:
    """(lang, phrase, m, f): every word, and every phrase of 2 to ``width`` words
    with at least ``least`` occurrences. A written table."""
    docs = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    tables = []
    for turn in range(passes):
        def run(it, turn=turn):
            return _edges(it, width, turn, passes)

        rows = docs.mapInArrow(run, "lang string, phrase string, c long")
        # The node as a number: the sums compare it beside the phrase that it follows from.
        node = F.xxhash64("lang", first_words(F.col("phrase"), width - 1))
        rows = rows.repartition(node).withColumn("node", node).withColumn("done", F.lit(False))
        for m in range(width, 1, -1):
            keys = ["lang", "node"] if m >= width - 1 else ["lang"]
            rows = _level(rows, keys, m, least).drop(*(["node"] if m == width - 1 else []))
        tables.append(cut(rows.groupBy("lang", "phrase", "done").agg(F.sum("c").alias("f")), "phrases"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    # A word's flow comes from all passes, a longer phrase from one.
    return cut(every.groupBy("lang", "phrase", "done").agg(F.sum("f").alias("f"))
               .select("lang", "phrase", F.when(F.col("done"), n_words(F.col("phrase"))).otherwise(1).alias("m"), "f"),
               "phrase-counts")


def graph(counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The frequent edges: lang, phrase, f, node and target with their counts,
    ``unary`` (the edge is part of a unary path) and ``head`` (its first edge)."""
    nodes = counts.where(F.col("m") == width - 1)
    edges = counts.where(F.col("m") == width).select(
        "lang", "phrase", "f", first_words(F.col("phrase"), width - 1).alias("node"),
        last_words(F.col("phrase"), width - 1).alias("target"))
    for name in ("node", "target"):
        edges = edges.join(nodes.select("lang", F.col("phrase").alias(name), F.col("f").alias(f"f_{name}")), ["lang", name])
    edges = edges.withColumn("unary", (F.col("f") == F.col("f_node")) & (F.col("f") == F.col("f_target")))
    inner = edges.where("unary").select("lang", F.col("target").alias("node"), F.lit(True).alias("follows"))
    edges = edges.join(inner, ["lang", "node"], "left")
    return cut(edges.withColumn("head", F.col("unary") & F.col("follows").isNull()).drop("follows"), "phrase-graph")


def paths(edges: DataFrame) -> DataFrame:
    """The compacted unary paths of ``graph``: (lang, path, place, phrase, f), a path
    being named by its first node, an edge's place counted from 0. Closed rings,
    which have no first node, are not among them. Pointer doubling: after k rounds
    each edge knows how far back its path goes, up to 2^k edges."""
    step = edges.where("unary").select("lang", "phrase", "f", "node", "target")
    known = cut(step.select("lang", "phrase", "f", "target", F.col("node").alias("back"), F.lit(1).cast("long").alias("far")),
                "path-links")
    heads = edges.where("head").select("lang", F.col("node").alias("back"), F.lit(True).alias("done"))
    n = known.count()
    for _ in range(max(n, 1).bit_length()):
        prior = known.select("lang", F.col("target").alias("back"), F.col("back").alias("further"), F.col("far").alias("more"))
        new = cut(known.join(prior, ["lang", "back"], "left").select(
            "lang", "phrase", "f", "target", F.coalesce("further", "back").alias("back"),
            (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("further").isNull().alias("ended")), "path-links")
        known = new.drop("ended")
        if new.where("not ended").isEmpty():
            break
    return known.join(heads, ["lang", "back"]).select(
        "lang", F.col("back").alias("path"), (F.col("far") - 1).alias("place"), "phrase", "f")


def _inside(counts: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(lang, phrase, most): for each phrase of 2 words and more inside a longer
    frequent one, the largest count among those."""
    def parts(phrase: Column, m: int, shortest: int = 2) -> Column:
        w = F.split(phrase, " ", -1)
        return F.array(*[F.array_join(F.slice(w, i, k), " ") for k in range(shortest, m) for i in range(1, m - k + 2)])

    phrase = F.col("phrase")
    # Within a path an edge adds its target and its last pair; a path's head has them all.
    added = [last_words(phrase, k) for k in range(2, width)]
    out = edges.select("lang", F.col("f").alias("most"), F.explode(
        F.when(F.col("unary") & ~F.col("head"), F.array(*added)).otherwise(parts(phrase, width))).alias("phrase"))
    for m in range(3, width):
        # Nodes on a path lie in one of its edges, which are as frequent.
        rest = counts.where(F.col("m") == m)
        if m == width - 1:
            on = edges.where("unary").select("lang", F.explode(F.array("node", "target")).alias("phrase")).distinct()
            rest = rest.join(on, ["lang", "phrase"], "left_anti")
        out = out.unionByName(rest.select("lang", F.col("f").alias("most"), F.explode(parts(phrase, m)).alias("phrase")))
    return out.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def _cuts(counts: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(lang, phrase, m, a, k, l, r) of every candidate and cut."""
    words_ = counts.where("m > 1").select(
        "lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    words_ = words_.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substring_index(phrase, ' ', k - m)"))
    ends = edges.select("lang", "phrase", "f_node", "f_target")
    long = words_.where(F.col("m") == width).join(ends, ["lang", "phrase"])
    other = words_.where(F.col("m") < width)

    def look(rows: DataFrame, part: str, name: str) -> DataFrame:
        known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        return rows.join(known.where(F.col(name) >= F.lit(0)), ["lang", part])

    cols = ["lang", "phrase", "m", "a", "k", "l", "r"]
    out = look(look(other, "left", "l"), "right", "r").select(*cols)
    if width > 2:   # an edge's own nodes are known from the graph
        out = out.unionByName(look(long.where("k = 1"), "left", "l").withColumn("r", F.col("f_target")).select(*cols))
        out = out.unionByName(look(long.where(f"k = {width - 1}"), "right", "r").withColumn("l", F.col("f_node")).select(*cols))
        out = out.unionByName(look(look(long.where(f"k > 1 and k < {width - 1}"), "left", "l"), "right", "r").select(*cols))
    return out


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = WIDTH,
                 least: int = LEAST, best: int = BEST, passes: int = PASSES) -> DataFrame:
    """The best phrases of 2 to ``width`` (3 or more) words of each language:
    lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(df, text_col, lang_col, width, least, passes)
    edges = graph(counts, width)
    size = counts.where("m = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = cut(counts.where((F.col("m") > 1) | (F.col("f") >= least)), "frequent-phrases")
    inside = _inside(known, edges, width)
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 as decimal(38,0)) div cast(l + r as decimal(20,0))")
    scored = (_cuts(known, edges, width).withColumn("score", score)
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")))
    scored = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < 80 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
                                         F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n",
                                         F.col("low.score").alias("score"))
