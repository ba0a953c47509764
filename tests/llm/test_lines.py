"""Line dedup against edit distance by definition on a small fixture."""

from delaymart.llm import lines

BASE = "the quick brown fox jumps over the lazy dog"
LONG = " ".join(f"w{i}" for i in range(40))
DATA = [(1, f"{BASE}\nshort line\n\n{LONG}"), (2, BASE.replace("fox", "cat") + "\nshort  line \nshort lines"),
        (3, BASE.replace("lazy ", "") + "\n" + BASE.replace("fox", "cat").replace("dog", "hen")),
        (4, BASE + " today\na a a a b\na a a b\na a a a a b\nb a a a a"), (5, None), (6, ""), (7, "\n\n"),
        (None, BASE + "\nonly null here at last"), (8, LONG.replace("w20 ", "") + "\n" + LONG.replace("w39", "x")),
        (1, f"{BASE}\nshort line\n\n{LONG}"), (9, "x y z u v\nx y z u\nx y z u v w")]


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(data):
    occ = [(i, k, [w for w in line.split(" ") if w]) for i, t in data if t is not None
           for k, line in enumerate(t.split("\n"))]
    out = []
    for i, k, w in occ:
        other = [(j is None, j or 0, m, j) for j, m, v in occ if w and near(w, v)] or [(i is None, i or 0, k, i)]
        best = min(other, key=lambda o: o[:3])
        out.append((i, k, len(w), best[3], best[2], (best[3], best[2]) == (i, k)))
    return out


def check(df, data):
    got = [tuple(r[c] for c in ("doc_id", "line_no", "n_words", "keep_id", "keep_line", "kept"))
           for r in lines.near_lines(df).collect()]
    assert sorted(got, key=str) == sorted(brute(data), key=str)


def test_equals_brute_force(rows):
    check(rows(DATA), DATA)


def test_lines_hashed_as_rows(rows, monkeypatch):
    monkeypatch.setattr(lines, "LONG", 8)
    check(rows(DATA), DATA)


def test_empty_table(rows):
    assert lines.near_lines(rows([])).collect() == []
