"""Quality classifier from weak labels.

1. Heuristic labellers vote bad, good or nothing on every document: symbol-ended
   words, shouting, exclamations, repeated neighbours, repeated four-word runs,
   table cells, sentence ends, few distinct words, a lexicon of words and word
   beginnings that mark toxic documents, and the human labels where there are
   any. The lexicon is learned from a bounded sample of labelled rows.
2. The votes of all documents are counted by pattern (at most 3^10 rows), and
   expectation-maximisation on those counts estimates each labeller's accuracy
   on good and on bad documents and the share of bad ones. A pattern's
   posterior is the label of its documents.
3. The posterior labels of a bounded sample (``SAMPLE`` documents, drawn by a
   hash of the id) train a hashed linear scorer (logistic regression on words,
   word beginnings and measured shares), which then scores every document.

Votes, counts and scores cover whole texts of all documents; only the two fits
use samples, whose bound is ``SAMPLE`` rows each.

Defined cases: a text without words (null, empty, white space) is bad: score 1,
kept false; labels with nulls are ignored, conflicting labels of an id count as
bad; without labels, or without toxic ones, those labellers abstain; repeated
rows are scored alike; an empty table gives no rows. Other columns are not read
by the scorer and are carried through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import (U64, cut, lowered, mix, pieces, prefix_hashes, sort_rows, window_hashes,
                                  word_hashes, words)

SAMPLE = 10_000
BLOCK_ROWS = 1000       # sampled rows that the driver unfolds at once
BITS = 18
LABELLERS = ("symbols", "shouting", "exclaiming", "neighbours", "repeats", "cells", "ends", "variety",
             "lexicon", "human")
BAD, GOOD, NONE = 1, 0, 2
MIN_DOCS = 6

# fixed values: bytes that end a junk word, and bytes that separate words for
# the scorer (ASCII punctuation)
_JUNK = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~=+<>\\_|", np.uint8))
_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_BARE = np.arange(256, dtype=np.uint8)
_BARE[_PUNCT] = 32
_ALNUM = np.ones(256, bool)
_ALNUM[_PUNCT] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[at[1:]] - total[at[:-1]]


def shares(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x 9: number of words, then the share of symbol-ended words,
    capitals, exclamations, repeated neighbours, repeated four-word runs, words
    without a letter or digit, sentence ends, and distinct words."""
    starts, ends, first = words(buf, offs)
    n = np.diff(first)
    out = np.zeros((len(n), 9))
    out[:, 0] = n
    if not len(starts):
        return out
    some = np.maximum(n, 1)
    last = buf[ends - 1]
    wh = word_hashes(lowered(buf), starts, ends)
    solid = np.append(0, np.cumsum(_ALNUM[buf], dtype=np.int64))
    bare = solid[ends] == solid[starts]
    near = np.zeros(len(wh), bool)
    near[1:] = wh[1:] == wh[:-1]
    near[first[:-1][n > 0]] = False
    out[:, 1] = _per_row(_JUNK[last] & (ends - starts > 1), first) / some
    out[:, 2] = _per_row(_UPPER[buf], offs) / np.maximum(_per_row(_LETTER[buf], offs), 1)
    out[:, 3] = _per_row(last == ord("!"), first) / some
    out[:, 4] = _per_row(near, first) / some
    row, _, h = window_hashes(wh, first, 4)
    runs = np.bincount(row, minlength=len(n))
    out[:, 5] = 1 - _distinct(row, h, len(n)) / np.maximum(runs, 1)
    out[runs == 0, 5] = 0
    out[:, 6] = _per_row(bare, first) / some
    out[:, 7] = _per_row(_END[last], first) / some
    out[:, 8] = _distinct(np.repeat(np.arange(len(n)), n), wh, len(n)) / some
    return out


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each row has; rows are in order."""
    new = sort_rows(h := h.copy(), np.searchsorted(row, np.arange(n + 1)))
    return np.bincount(row[new], minlength=n)


def _features(buf: np.ndarray, offs: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) with repeats: each word, its first four and six
    bytes, and each share in sixteenths."""
    flat = _BARE[lowered(buf)]
    starts, ends, first = words(flat, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    hs, rows = [word_hashes(flat, starts, ends)], [row]
    for cut_at in (4, 6):
        longer = ends - starts > cut_at
        hs.append(prefix_hashes(flat, starts[longer], cut_at))
        rows.append(row[longer])
    for k in range(1, 9):
        level = np.minimum(np.ceil(share[:, k] * 16), 16).astype(U64)
        hs.append(mix(level + U64(1000 * k)))
        rows.append(np.arange(len(share)))
    return np.concatenate(rows), (np.concatenate(hs) & U64((1 << BITS) - 1)).astype(np.int64)


def _once(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) << BITS | feature)
    return key >> BITS, key & ((1 << BITS) - 1)


def _vote(share: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(share: np.ndarray, marks: np.ndarray, use_lexicon: bool, human: np.ndarray) -> np.ndarray:
    """Rows x labellers."""
    n, sym, up, ex, near, rep, cells, ends, var = share.T
    long = n >= 20
    return np.column_stack([
        _vote(sym, sym >= 0.2, sym <= 0.02), _vote(up, up >= 0.4, up <= 0.2), _vote(ex, ex >= 0.3, ex <= 0.05),
        _vote(near, (near >= 0.25) & long, near <= 0.1), _vote(rep, (rep >= 0.5) & long, rep <= 0.25),
        _vote(cells, cells >= 0.15, cells <= 0.02),
        _vote(ends, ((ends >= 0.6) | (ends == 0)) & long, (ends > 0.01) & (ends <= 0.5)),
        _vote(var, (var < 0.3) & (n >= 50), var >= 0.45),
        _vote(marks, marks >= 2, marks == 0) if use_lexicon else np.full(len(n), NONE),
        human])


def _human(col: pa.Array) -> np.ndarray:
    return np.array([NONE if x is None else x for x in col.to_pylist()], np.int64)


def _vote_rows(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, votes as one base-3 number), without the human vote."""
    listed = np.zeros(1 << BITS, bool)
    listed[lexicon] = True
    place = 3 ** np.arange(len(LABELLERS) - 1)
    for rows, buf, offs in pieces(batches):
        share = shares(buf, offs)
        row, f = _features(buf, offs, share)
        hit = listed[f]
        row, f = _once(row[hit], f[hit])
        marks = np.bincount(row, minlength=len(share))
        v = votes(share, marks, len(lexicon) > 0, np.full(len(share), NONE))[:, :-1]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((v * place).sum(axis=1))], names=["id", "pattern"])


def _sample_rows(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(human, text) to (pattern, distinct features)."""
    listed = np.zeros(1 << BITS, bool)
    listed[lexicon] = True
    place = 3 ** np.arange(len(LABELLERS))
    for rows, buf, offs in pieces(batches):
        share = shares(buf, offs)
        row, f = _once(*_features(buf, offs, share))
        hit = listed[f]
        v = votes(share, np.bincount(row[hit], minlength=len(share)), len(lexicon) > 0, _human(rows.column(0)))
        at = np.searchsorted(row, np.arange(len(share) + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array((v * place).sum(axis=1)),
             pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                      pa.binary())], names=["pattern", "features"])


def _blocks(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row's number, row within the block, feature) of up to ``BLOCK_ROWS``
    sampled rows at a time, read where the batches have them."""
    done = 0
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            col = batch.column(1).slice(i, BLOCK_ROWS).cast(pa.large_binary())
            at = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
            data = col.buffers()[2]
            f = np.frombuffer(data, np.int32, (at[-1] - at[0]) // 4, at[0]) if at[-1] > at[0] else np.zeros(0, np.int32)
            yield done + i, np.repeat(np.arange(len(col), dtype=np.int32), np.diff(at) // 4), f
        done += batch.num_rows


def _seen(batches: list[pa.RecordBatch]) -> tuple[int, np.ndarray]:
    """The number of sampled rows, and in how many of them each feature is."""
    df = np.zeros(1 << BITS, np.int64)
    for _, _, f in _blocks(batches):
        df += np.bincount(f, minlength=1 << BITS)
    return sum(b.num_rows for b in batches), df


def learn_lexicon(n_toxic: int, pos: np.ndarray, n_other: int, neg: np.ndarray) -> np.ndarray:
    """Hashed features seen in 5 toxic documents (4 of a small sample) and at
    least e^4 times as often there as in the others."""
    if not n_toxic or not n_other:
        return np.zeros(0, np.int64)
    odds = np.log((pos + 0.1) / (n_toxic + 1)) - np.log((neg + 0.1) / (n_other + 1))
    return np.flatnonzero((pos >= min(5, max(4, 0.005 * n_toxic))) & (odds >= 4))


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of bad per pattern, labellers x kinds: P(bad vote | kind)).

    Bad documents come in kinds, as a labeller sees only some of them: kind 0 is
    good, kind k starts as what heuristic k sees. Within a kind the labellers
    are independent; one that does not vote says nothing."""
    n = len(LABELLERS)
    v = pattern[:, None] // 3 ** np.arange(n) % 3
    bad, good = (v == BAD).astype(float), (v == GOOD).astype(float)
    says = np.full((n, n), 0.05)
    says[:, 0] = 0.01
    says[np.arange(n - 1), np.arange(1, n)] = 0.9
    says[-1] = 0.97
    says[-1, 0] = 0.03
    share = np.append(0.85, np.full(n - 1, 0.15 / (n - 1)))
    post = np.zeros((len(pattern), n))
    for _ in range(steps):
        ll = np.log(share) + bad @ np.log(says) + good @ np.log(1 - says)
        new = np.exp(ll - ll.max(axis=1, keepdims=True, initial=-np.inf))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        weight = post * count[:, None]
        said, total = bad.T @ weight, (bad + good).T @ weight
        says = (said + 0.1 * says) / (total + 0.1)
        says = np.clip(says, 1e-4, 1 - 1e-4)
        share = np.clip(weight.sum(axis=0) / max(count.sum(), 1), 1e-6, 1)
    return 1 - post[:, 0], says


def fit_scorer(batches: list[pa.RecordBatch], target: np.ndarray, steps: int = 80,
               ridge: float = 1e-4, least_odds: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression (weights over the hashed features, bias) on soft
    labels; features in fewer than ``MIN_DOCS`` sampled documents, or about as
    likely in good as in bad ones, get no weight and are never held as a whole."""
    w = np.zeros(1 << BITS)
    if not len(target):
        return w, 0.0
    _, df = _seen(batches)
    in_bad = np.zeros(1 << BITS)
    for first, row, f in _blocks(batches):
        np.add.at(in_bad, f, target[first + row])
    odds = np.log((in_bad + 0.1) / (target.sum() + 1)) - np.log((df - in_bad + 0.1) / ((1 - target).sum() + 1))
    keep = (df >= MIN_DOCS) & (np.abs(odds) >= least_odds)
    kept = [(first + row[keep[f]], f[keep[f]]) for first, row, f in _blocks(batches)]
    row, col = (np.concatenate([k[i] for k in kept]).astype(np.int64) for i in (0, 1))
    bias, gw, gb = 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[col], len(target)) + bias
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(col, miss[row], 1 << BITS) / len(target) + ridge * w
        gw += g * g
        gb += miss.mean() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        bias -= 0.5 * miss.mean() / np.sqrt(gb)
    return w, bias


def _score_rows(batches: Iterator[pa.RecordBatch], out: str, weights: np.ndarray,
                bias: float) -> Iterator[pa.RecordBatch]:
    used = np.abs(weights) > 1e-3
    for rows, buf, offs in pieces(batches):
        share = shares(buf, offs)
        row, f = _features(buf, offs, share)
        hit = used[f]
        row, f = _once(row[hit], f[hit])
        z = np.bincount(row, weights[f], len(share)) + bias
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        score[share[:, 0] == 0] = 1.0
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, out])


class QualityModel:
    """What the fits give: accuracies, share of bad, lexicon and scorer."""

    def __init__(self, docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", sample: int = SAMPLE):
        spark = docs.sparkSession
        texts = docs.select(F.col(id_col).alias("id"), "text")
        if labels is None:
            human = spark.createDataFrame([], "label_id long, human int, toxic int")
        else:
            bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
            human = (labels.where("quality is not null and toxic is not null").groupBy(F.col(id_col).alias("label_id"))
                     .agg(F.max(bad.cast("int")).alias("human"), F.max("toxic").cast("int").alias("toxic")))
        n, n_labels = texts.count(), human.count()

        def part(col: str, of: int):
            """Whether an id (not null) is in a sample of about ``sample`` out of ``of``."""
            return F.col(col).isNotNull() & (F.pmod(F.xxhash64(col, F.lit(41)), F.lit(1 << 30)) < (1 << 30) * (sample / max(of, 1)))

        # both samples of labels are of about ``sample`` rows, so they are broadcast
        few = cut(texts.join(F.broadcast(human.where(part("label_id", n_labels))), F.col("id") == F.col("label_id"))
                  .select("human", "text", "toxic"), "labelled")
        drawn = texts.where(part("id", n)).join(F.broadcast(human.where(part("label_id", n))),
                                                F.col("id") == F.col("label_id"), "left").select("human", "text")

        def sampled(lexicon):
            def run(it):
                return _sample_rows(it, lexicon)
            return run

        empty = np.zeros(0, np.int64)
        n_other, neg = _seen(self._features(few.where("toxic = 0").select("human", "text"), sampled(empty)))
        n_toxic, pos = _seen(self._features(few.where("toxic = 1").select("human", "text"), sampled(empty)))
        self.lexicon = learn_lexicon(n_toxic, pos, n_other, neg)
        lexicon = self.lexicon

        def vote(it):
            return _vote_rows(it, lexicon)

        kind = texts.schema["id"].dataType.simpleString()
        voted = cut(texts.mapInArrow(vote, f"id {kind}, pattern long"), "votes")
        said = F.coalesce(F.col("human"), F.lit(NONE)) * 3 ** (len(LABELLERS) - 1)
        counts = (voted.join(human, F.col("id") == F.col("label_id"), "left")
                  .groupBy((F.col("pattern") + said).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect())
        pattern = np.array([r["pattern"] for r in counts], np.int64)
        self.posterior, self.accuracy = expectation_maximisation(pattern, np.array([r["n"] for r in counts]))
        label = dict(zip(pattern.tolist(), self.posterior.tolist(), strict=True))
        rows = self._features(drawn, sampled(lexicon))
        self.weights, self.bias = fit_scorer(rows, np.array([label[p] for b in rows for p in b.column(0).to_pylist()]))

    @staticmethod
    def _features(df: DataFrame, run) -> list[pa.RecordBatch]:
        return df.mapInArrow(run, "pattern long, features binary").toArrow().to_batches()

    def score(self, df: DataFrame, out: str = "p_bad") -> DataFrame:
        """``df`` with the scorer's chance that a document is bad, as ``out``."""
        weights, bias = self.weights, self.bias
        df = df.drop(out)

        def run(it):
            return _score_rows(it, out, weights, bias)

        return df.mapInArrow(run, df.withColumn(out, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_bad, kept for every document."""
    model = QualityModel(docs, labels)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", "p_bad", (F.col("p_bad") < threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    model = QualityModel(docs, labels)
    return model.score(docs, "__p_bad").where(F.col("__p_bad") < threshold).drop("__p_bad")
