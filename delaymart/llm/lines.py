"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions.

A line is its list of words (split at single spaces, empty pieces left out);
lines of different spacing are alike. Two lines are near when one word
substituted, inserted or deleted turns one into the other; only lines of
``MIN_WORDS`` words or more have near lines, shorter ones just equal ones. An
occurrence is kept if no equal or near line occurs earlier, by document id
(null last), then line number; ``keep_*`` names the earliest of these lines.

1. Lines become forms (two 64-bit hashes of the words), with the first
   occurrence of each, counted map-side: a line that a third of all texts hold
   is one form.
2. Near lines of n and n or n + 1 words share their first or their last
   floor(n / 2) words, whichever half the edit leaves alone. Each form emits
   these halves for its own and for one word less; forms that share none with
   another form cannot have a near one and need no variants. No pair is lost.
3. The others emit the line and every variant with one word deleted as hashed
   keys. Lines that give equal variants at the same place are one substitution
   apart; a line that equals another's variant is one deletion away. So each key
   is a group whose earliest line serves all others: one minimum per key and
   side, no pairs. A variant's hash is the exclusive-or of hashes of (word,
   place), so all variants of a line follow from one running value.
4. The edit distance is verified on the words of the matched lines.

Defined cases: a null text has no lines; empty lines (no words) are kept as
they are; rows that share id, line number and words are the same occurrence;
lines longer than ``LONG`` words are hashed word by word as rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymart.llm.common import cut, small

MIN_WORDS = 5
LONG = 2048


def _lines(df: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no, w, n): every line of every text with its words."""
    rows = df.where(F.col("text").isNotNull()).select(
        F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = F.filter(F.split("line", " ", -1), lambda x: x != "")
    return rows.select("id", "line_no", w.alias("w")).withColumn("n", F.size("w"))


def _form() -> list[Column]:
    return [F.xxhash64(F.lit(1), "w").alias("h1"), F.xxhash64(F.lit(2), "w").alias("h2")]


def _halves() -> Column:
    """The keys of step 2, for lines of MIN_WORDS or more."""
    def half(side: int, m: Column) -> Column:
        part = F.slice("w", 1, m) if side == 1 else F.slice("w", F.col("n") - m + 1, m)
        return F.xxhash64(F.lit(side), m, part)

    own, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    return F.when(F.col("n") >= MIN_WORDS, F.array_distinct(F.array(
        half(1, own), half(2, own), half(1, less), half(2, less))))


def _first() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("line_no").alias("line_no"))


def _at(word: Column, place: Column) -> Column:
    return F.xxhash64(word, place.cast("int"))


def _variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, first, place, key): the line itself at place -1, and each
    variant without the word at ``place``."""
    keep = ["h1", "h2", "n", "first"]
    total = F.aggregate(F.transform("w", lambda x, i: _at(x, i)), F.lit(0).cast("long"),
                        lambda a, x: a.bitwiseXOR(x))
    moved = F.transform("w", lambda x, i: _at(x, i - 1))
    tail = F.aggregate("moved", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    step = F.zip_with(F.transform("w", lambda x, i: _at(x, i)), F.col("moved"), lambda x, y: x.bitwiseXOR(y))
    running = F.aggregate(
        "step", F.struct(F.array().cast("array<bigint>").alias("seen"), F.lit(0).cast("long").alias("v")),
        lambda a, x: F.struct(F.array_append(a["seen"], a["v"]).alias("seen"), a["v"].bitwiseXOR(x).alias("v")),
        lambda a: a["seen"])
    short = (lines.where(F.col("n") <= LONG).withColumn("moved", moved).withColumn("step", step)
             .withColumn("tail", tail).withColumn("before", running))
    short = short.select(*keep, F.posexplode(F.concat(F.array(total), F.zip_with(
        "before", "moved", lambda d, y: F.col("tail").bitwiseXOR(d).bitwiseXOR(y)))).alias("p", "key"))
    short = short.select(*keep, (F.col("p") - 1).alias("place"), "key")
    rows = lines.where(F.col("n") > LONG).select(*keep, F.posexplode("w").alias("place", "word")).select(
        *keep, "place", _at(F.col("word"), F.col("place")).alias("x"),
        _at(F.col("word"), F.col("place") - 1).alias("y"))
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*keep, "place", F.bit_xor("y").over(line).bitwiseXOR(F.col("y")).bitwiseXOR(
        F.coalesce(F.bit_xor(F.col("x").bitwiseXOR(F.col("y"))).over(before), F.lit(0).cast("long"))).alias("key"),
        "x")
    whole = rows.groupBy(*keep).agg(F.bit_xor("x").alias("key")).select(*keep, F.lit(-1).alias("place"), "key")
    return short.unionByName(rows.drop("x")).unionByName(whole)


def _near(a: Column, b: Column) -> Column:
    """Whether two word lists are within one word edit: their common beginning
    and end leave at most one word of the longer."""
    def same(x: Column, y: Column) -> Column:
        hit = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(hit > 0, hit - 1).otherwise(F.least(F.size(x), F.size(y)))

    return same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_lines(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per line: id, line_no, n_words, keep_id, keep_line, kept."""
    lines = cut(_lines(df, id_col).select("id", "line_no", "n", *_form(), _halves().alias("halves")), "lines")
    forms = cut(lines.where("n > 0").groupBy("h1", "h2", "n").agg(
        F.min(_first()).alias("first"), F.max("halves").alias("halves")), "forms")
    halves = forms.where(F.col("halves").isNotNull()).select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    some = cut(halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
               .join(forms.select("h1", "h2", "first"), ["h1", "h2"]), "candidates")
    n_some = some.count()
    texts = _lines(df, id_col).where(F.col("n") >= MIN_WORDS).select("id", "line_no", "w", "n", *_form())
    texts = texts.join(small(some, n_some, 72), ["h1", "h2"]).where(_first() == F.col("first"))
    texts = cut(texts.select("h1", "h2", "n", "first", "w").dropDuplicates(["h1", "h2"]), "candidate-lines")
    keys = cut(_variants(texts), "variants")
    # a line of n words and a variant of a line of n + 1 meet at n words left
    left = F.when(F.col("place") < 0, F.col("n")).otherwise(F.col("n") - 1)
    whole = F.col("place") < 0
    gone = keys.withColumn("left", left).groupBy("left", "key").agg(
        F.min(F.when(whole, F.struct("first", "h1", "h2"))).alias("line"),
        F.min(F.when(~whole, F.struct("first", "h1", "h2"))).alias("variant"))
    gone = gone.where(F.col("line").isNotNull() & F.col("variant").isNotNull())
    put = keys.where(~whole).groupBy("n", "place", "key").agg(
        F.min(F.struct("first", "h1", "h2")).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    by_gap = (keys.withColumn("left", left).join(gone, ["left", "key"])
              .select("h1", "h2", F.when(whole, F.col("variant")).otherwise(F.col("line")).alias("best"), "first"))
    by_swap = keys.where(~whole).join(put, ["n", "place", "key"]).select("h1", "h2", "best", "first")
    best = (by_gap.unionByName(by_swap).where(F.col("best.first") < F.col("first"))
            .select("h1", "h2", "best").distinct())
    words = texts.select("h1", "h2", "w")
    proven = (best.join(words, ["h1", "h2"]).withColumn("b1", F.col("best.h1")).withColumn("b2", F.col("best.h2"))
              .join(words.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("w").alias("v")), ["b1", "b2"])
              .where(_near(F.col("w"), F.col("v")))
              .groupBy("h1", "h2").agg(F.min("best.first").alias("best")))
    firsts = (forms.select("h1", "h2", "first").join(proven, ["h1", "h2"], "left")
              .select("h1", "h2", F.coalesce("best", "first").alias("keep")))
    out = lines.select("id", "line_no", "n", "h1", "h2").join(firsts, ["h1", "h2"], "left")
    keep = F.when(F.col("n") > 0, F.col("keep")).otherwise(_first())
    return out.select(F.col("id").alias(id_col), "line_no", F.col("n").alias("n_words"),
                      keep["id"].alias("keep_id"), keep["line_no"].alias("keep_line"),
                      (keep == _first()).alias("kept"))
