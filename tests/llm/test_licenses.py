"""Licence scan: families named, look-alikes left, edges."""

import random

import numpy as np

from delaymart.llm import licenses

rnd = random.Random(6)
VOCAB = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]


def text(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def test_families_and_clean_lines(rows):
    known = [("mit", "Released under the MIT License."), ("apache", "licensed under the apache license, version 2.0"),
             ("gpl", "This work is licensed under the GNU General Public License, version 3."),
             ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("proprietary", "All rights reserved."),
             ("bsd", licenses.OPENINGS["bsd"][0][:-20]),
             ("mpl", "Note: " + licenses.OPENINGS["mpl"][0] + " See below for " + text(5))]
    data = [(i, f"{text(30)}\n\n{line}\n{text(20)}") for i, (_, line) in enumerate(known)]
    data += [(100 + i, "\n".join(text(25) for _ in range(6))) for i in range(60)]
    data += [(200, "the public was released under a version"), (201, None), (202, ""), (203, "\n\n"),
             (204, text(30_000)), (None, "Released under the MIT License."), (0, data[0][1])]
    got = licenses.licence_paragraphs(rows(data)).collect()
    want = [(i, 2, f) for i, (f, _) in enumerate(known)] + [(None, 0, "mit"), (0, 2, "mit")]
    assert sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        body = dict(data)[r["doc_id"]].encode()[r["from_byte"]:r["to_byte"]].decode()
        assert body.rstrip("\n") == dict(data)[r["doc_id"]].split("\n")[r["paragraph"]]
        assert r["template_share"] >= licenses.LEAST_SHARED
    assert licenses.licence_paragraphs(rows([])).collect() == []


def test_training_templates_and_the_bound():
    model = licenses.LicenceModel([text(25) for _ in range(300)])
    lines = [f"{p.format(n)} {text(3)}" for f, names in licenses.NAMES.items() for n in names
             for p in licenses.PHRASES[:4]] + [text(30) for _ in range(300)]
    family = [f for f, names in licenses.NAMES.items() for _ in names for _ in range(4)] + ["unknown"] * 300
    flat, at = licenses._flat(lines)
    found = {k: f for k, f, _, _ in model.scan(flat, at)}
    right = [found.get(i, "unknown") == f for i, f in enumerate(family)]
    assert np.mean(right) > 0.95
    margin, best, _ = model.margins(*licenses._features(flat, at), len(lines))
    named = {i for i in range(len(lines)) if margin[i] > model.least}
    assert set(found) <= named
