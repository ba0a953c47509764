"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text. A multinomial logistic regression on hashed
word 1- to 3-grams gives each the chances of the licence families and of
``unknown``. It is trained on variants of the templates below (words lost,
names, years and corpus words around them) and on corpus paragraphs, a bounded
sample of ``SAMPLE`` documents (of 1 MiB or less), as unknown. The least chance at which a family
is named is calibrated on the half of the sample that training does not see:
at most ``FALSE_RATE`` of its paragraphs may pass. A named family is confirmed
if a template of it shares enough of its word pairs with the paragraph;
otherwise the paragraph stays unknown.

Every paragraph of every document is scored, but most need one look: the sum of
each feature's largest advantage for any family over unknown bounds the margin,
and a paragraph whose bound is below the calibrated one cannot be named.

Defined cases: null and empty texts have no paragraphs; repeated rows are
reported each; without documents there are no rows (and no training); other
columns are not read. The result has one row per licence paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import U64, lowered, pieces, window_hashes, word_hashes, words

BITS = 15
SAMPLE = 800
FALSE_RATE = 0.001
VARIANTS = 60
LEAST_SHARED = 0.6
UNKNOWN = "unknown"

# fixed values: licence names, how works refer to them, and opening words of
# the public licence texts
NAMES = {
    "agpl": ("GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL v3"),
    "apache": ("Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "cc0": ("CC0 1.0 Universal", "Creative Commons Zero", "CC0 Public Domain Dedication"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
                 "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": ("GNU General Public License, version 3", "GPL-3.0", "GNU GPL v2", "GNU General Public License"),
    "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "LGPL-3.0", "GNU LGPL"),
    "mit": ("MIT License", "MIT licence", "Expat License"),
    "mpl": ("Mozilla Public License, v. 2.0", "MPL-2.0", "Mozilla Public License Version 2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
           "Licensed under {}.", "This work is licensed under {}.", "Released under {}.",
           "Distributed under the terms of the {}.", "This software is available under the {}.",
           "SPDX-License-Identifier: {}", "You may use this file under the {}.")
OPENINGS = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation",),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work.",),
    "gpl": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced "
                    "without permission.", "Proprietary and confidential. Unauthorized copying is prohibited."),
}
FAMILIES = sorted({*NAMES, *OPENINGS})
CLASSES = [UNKNOWN, *FAMILIES]

_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_BARE = np.arange(256, dtype=np.uint8)
_BARE[_PUNCT] = 32


def templates() -> list[tuple[str, str]]:
    out = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    return out + [(f, t) for f, texts in OPENINGS.items() for t in texts]


def paragraphs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines, and the row of each; a row's empty end has none."""
    at = np.unique(np.concatenate([offs, np.flatnonzero(buf == 10) + 1]))
    return at, np.searchsorted(offs, at[:-1], "right") - 1


def _grams(flat: np.ndarray, at: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the word n-grams of each row, in row order."""
    starts, ends, first = words(flat, at)
    wh = word_hashes(flat, starts, ends)
    got = [window_hashes(wh, first, n) for n in sizes]
    row = np.concatenate([g[0] for g in got])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([g[2] for g in got])[order]


def _features(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, h = _grams(flat, at, (1, 2, 3))
    return row, (h & U64((1 << BITS) - 1)).astype(np.int64)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64))
    return _BARE[lowered(np.frombuffer(b"".join(raw), np.uint8))], at


@cache
def _pairs() -> list[tuple[str, frozenset]]:
    known = templates()
    row, h = _grams(*_flat([t for _, t in known]), (2,))
    at = np.searchsorted(row, np.arange(len(known) + 1))
    return [(f, frozenset(h[a:b].tolist())) for (f, _), a, b in zip(known, at[:-1], at[1:], strict=True)]


def template_share(pairs: set[int], family: str) -> float:
    """The best share of word pairs in common with a template of the family,
    of the smaller of both; two pairs at least."""
    best = 0.0
    for f, known in _pairs():
        if f == family and known and pairs:
            both = len(known & pairs)
            if both >= 2 or both == len(known):
                best = max(best, both / min(len(known), len(pairs)))
    return best


class LicenceModel:
    """Weights (features x classes), biases and the calibrated least margin."""

    def __init__(self, lines: list[str], seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        filler = [w for t in lines[:200] for w in t.split()] or ["the"]
        texts, label = [], []
        for f, t in templates():
            ws = t.split()
            for k in range(max(2, VARIANTS * 10 // (10 * len(NAMES.get(f, ("",))) + 10))):
                kept = [w for w in ws if rng.random() > 0.05 * (k % 4)] or ws
                some = [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)))]
                cut_at = int(rng.integers(0, len(some) + 1))
                year = [f"Copyright {int(rng.integers(1990, 2030))}"] if k % 5 == 4 else []
                texts.append(" ".join(some[:cut_at] + year + kept + some[cut_at:]))
                label.append(CLASSES.index(f))
        clean = [t for t in lines if not self._like_template(t)]
        train, held = clean[::2], clean[1::2]
        label += [0] * len(train)
        self._fit(texts + train, np.array(label))
        margin = self.margins(*_features(*_flat(held)), len(held))[0] if held else np.zeros(0)
        self.least = max(0.0, float(np.quantile(margin, 1 - FALSE_RATE)) if len(margin) else 0.0)

    @staticmethod
    def _like_template(text: str) -> bool:
        _, h = _grams(*_flat([text]), (2,))
        got = set(h.tolist())
        return any(len(known & got) >= max(2, LEAST_SHARED * len(known)) for _, known in _pairs())

    def _fit(self, texts: list[str], label: np.ndarray, steps: int = 40, ridge: float = 1e-4) -> None:
        row, col = _features(*_flat(texts))
        order = np.argsort(col, kind="stable")
        sorted_col = col[order]
        begin = np.flatnonzero(np.append(True, sorted_col[1:] != sorted_col[:-1]))
        used = sorted_col[begin]
        n = len(texts)
        want = np.zeros((n, len(CLASSES)), np.float32)
        want[np.arange(n), label] = 1
        each = 1 / np.maximum(want.sum(axis=0), 1)
        weight = (want @ each * n / len(CLASSES)).clip(0.2, 5)[:, None].astype(np.float32)
        self.w = np.zeros((1 << BITS, len(CLASSES)), np.float32)
        self.b = np.zeros(len(CLASSES), np.float32)
        g2, gb2 = np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)
        for _ in range(steps):
            z = self._sum(row, col, n) + self.b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            miss = (z / z.sum(axis=1, keepdims=True) - want) * weight / n
            g = np.add.reduceat(miss[row[order]], begin, axis=0) + ridge * self.w[used]
            g2[used] += g * g
            self.w[used] -= 0.3 * g / np.sqrt(g2[used])
            gb = miss.sum(axis=0)
            gb2 += gb * gb
            self.b -= 0.3 * gb / np.sqrt(gb2)
        self.bound = np.maximum(self.w[:, 1:].max(axis=1) - self.w[:, 0], 0)

    def _sum(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(CLASSES)), np.float32)
        if len(row):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[begin]] = np.add.reduceat(self.w[col], begin, axis=0)
        return out

    def margins(self, row: np.ndarray, col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit margin of the best family over unknown, the family, its chance)."""
        z = self._sum(row, col, n) + self.b
        z[np.bincount(row, minlength=n) == 0, 0] = 100
        best = z[:, 1:].argmax(axis=1) + 1
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return z[np.arange(n), best] - z[:, 0], best, p[np.arange(n), best]

    def scan(self, flat: np.ndarray, at: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(paragraph, family, chance, template share) for the confirmed ones."""
        row, col = _features(flat, at)
        n = len(at) - 1
        able = np.bincount(row, self.bound[col], n) + (self.b[1:].max() - self.b[0]) >= self.least
        some = np.flatnonzero(able)
        keep = able[row]
        margin, best, p = self.margins(np.searchsorted(some, row[keep]), col[keep], len(some))
        out = []
        for k in np.flatnonzero(margin > self.least).tolist():
            a, b = at[some[k]], at[some[k] + 1]
            family = CLASSES[best[k]]
            share = template_share(set(_grams(flat[a:b], np.array([0, b - a]), (2,))[1].tolist()), family)
            if share >= LEAST_SHARED:
                out.append((int(some[k]), family, float(p[k]), share))
        return out


def _scan(batches: Iterator[pa.RecordBatch], model: LicenceModel) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches):
        at, doc = paragraphs(buf, offs)
        out = model.scan(_BARE[lowered(buf)], at)
        take = np.array([o[0] for o in out], np.int64)
        of = doc[take]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(of)), pa.array((take - np.searchsorted(doc, of)).astype(np.int32)),
             pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64()),
             pa.array([o[3] for o in out], pa.float64()),
             pa.array(at[take] - offs[of]), pa.array(at[take + 1] - offs[of])],
            names=["id", "paragraph", "family", "chance", "template_share", "from_byte", "to_byte"])


def licence_paragraphs(df: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """One row per licence paragraph: id, paragraph (from 0), family, chance,
    template_share, from_byte, to_byte."""
    docs = df.select(F.col(id_col).alias("id"), "text")
    spark = df.sparkSession
    n = docs.count()
    u = F.pmod(F.xxhash64("id", F.lit(67)), F.lit(1 << 30)) / float(1 << 30)
    drawn = (docs.where(u < sample / max(n, 1)).where(F.octet_length("text") <= 1 << 20)
             .orderBy(F.xxhash64("id", F.lit(67)), "text").limit(2 * sample))
    lines = [x for r in drawn.select("text").collect() for x in r["text"].split("\n") if x.strip()]
    model = spark.sparkContext.broadcast(LicenceModel(lines))

    def run(it):
        return _scan(it, model.value)

    out = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, paragraph int, family string, "
                               "chance double, template_share double, from_byte long, to_byte long")
    return out.withColumnRenamed("id", id_col)
