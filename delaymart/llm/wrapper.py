"""HTML main-text extraction by wrapper induction.

Each page becomes a tree of its block elements; runs of like siblings without
children of their own (paragraphs, list items) count as one node. Up to ``REFS``
pages of a host are aligned by simple tree matching. Nodes that match in
several of them, always with the same text, are template; pages without text do
not count. The lowest node that holds all other text
but furniture is the content slot (never a part of a list, table or quotation).
Every page of the host is then aligned with that template in the same way. Its
main text is in the lowest node that holds both what meets the slot and all
text of the page that is neither furniture nor template. Where no text varies,
as on a host with one page, the slot is the lowest node that holds all article
and main elements, or all text if there are none.

Within that node, what is not article goes: elements that say so by tag, role or
class (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments), and containers the template knows as constant. A name
never drops the element with the page's only articles or most of its text.
Paragraphs, headings and list items are never dropped for being alike.

Blocks are the text of a block element up to the next block element or line
break, in page order; character references are decoded, white space becomes one
space, and blocks are joined by a newline.

Only the references are a sample (``REFS`` pages per host, drawn by a hash of
the id); every page is read whole. Defined cases: null or empty html gives an
empty text; a null or odd url belongs to the host ''; broken and unclosed
elements are closed where the next block begins; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import cut, pieces, small

REFS = 4
MAX_DEPTH = 60

# fixed values: HTML element names and words that name page furniture
BLOCKS = frozenset(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog "
    "script style noscript template textarea select button svg iframe object title center hr".split())
VOID = frozenset("hr".split())
FURNITURE = frozenset(
    "head nav header footer aside form dialog script style noscript template textarea select button svg iframe "
    "object title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice "
    "notices alert gdpr nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside "
    "widget related share sharing social comment comments reply replies newsletter subscribe signup popup modal "
    "pagination login search".split())
AROUND = frozenset(
    "left right top bottom primary secondary main inner outer area bar box block container wrapper wrap list item items "
    "link links button buttons icon icons section form unit slot text content title body post posts article articles "
    "story stories x".split())
STATES = frozenset("has no not non with without is hide hidden show can".split())
READERS = frozenset("comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_HEADERS = frozenset("article post entry story content section main page".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption address summary".split())
WHOLE = LEAVES | frozenset("ul ol dl table thead tbody tfoot tr".split())


class Node:
    __slots__ = ("drop", "items", "named", "sig", "tag")

    def __init__(self, tag: str, sig: str, drop: bool, named: str = ""):
        self.tag, self.sig, self.drop, self.items, self.named = tag, sig, drop, [], named


def furniture_word(tag: str, tokens: list[str]) -> str:
    """The word by which a class or id names the element as furniture, or ''. It
    is the whole token, its last part, or its first before words for boxes; a
    token that tells a state of the element (has-sidebar) names nothing."""
    for token in tokens:
        parts = re.findall(r"[a-z]+", token)
        if not parts or STATES.intersection(parts[:-1]):
            continue
        if parts[-1] in WORDS:
            word = parts[-1]
            if word in ("header", "masthead") and (tag in HEADINGS or OWN_HEADERS.intersection(parts[:-1])):
                continue
            if len(parts) > 1 and tag in HEADINGS:
                continue
            return word
        if parts[0] in WORDS and tag not in LEAVES and all(p in WORDS or p in AROUND for p in parts[1:]):
            return parts[0]
    return ""


def spare(root: Node) -> None:
    """Mark what its name calls furniture as dropped, but not what holds all
    article and main elements of the page, if it is one, has a main element or
    has most of the text (readers' comments may well be longer than what they
    are about, and hold articles)."""
    held: dict[int, tuple[int, int, int]] = {}

    def measure(node: Node) -> tuple[int, int, int]:
        size, articles, mains = 0, 0, 0
        for item in node.items:
            if isinstance(item, str):
                size += len("".join(item.split()))
            elif item is not None and not item.drop:
                got = measure(item)
                size, articles, mains = size + got[0], articles + got[1], mains + got[2]
        if size and node.named not in READERS:
            articles += node.tag in ("article", "main")
            mains += node.tag == "main"
        held[id(node)] = size, articles, mains
        return held[id(node)]

    def spared(node: Node) -> bool:
        size, articles, mains = held[id(node)]
        if articles != total[1] or (node.named in READERS and not mains):
            return False
        return mains > 0 or (articles > 0 and node.tag == "article") or 2 * size > total[0]

    def mark(node: Node) -> None:
        for item in node.items:
            if isinstance(item, Node) and not item.drop:
                if item.named and not spared(item):
                    item.drop = True
                else:
                    mark(item)

    total = measure(root)
    mark(root)


class TreeBuilder(HTMLParser):
    """The block elements of a page; inline elements only carry their text.
    Elements below MAX_DEPTH open ones are put side by side into the last of
    these, in page order, and inherit being furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", "root", False)
        self.open = [self.root]
        self.count = Counter()

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _here(self) -> Node:
        """The node that text or an element at this point goes to."""
        if len(self.open) <= MAX_DEPTH:
            return self.open[-1]
        base, last = self.open[MAX_DEPTH - 1], self.open[-1]
        if base.items[-1] is not last:
            self.open[-1] = last = Node(last.tag, last.sig, last.drop, last.named)
            base.items.append(last)
        return last

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._here().items.append(None)
        if tag not in BLOCKS:
            return
        if tag in CLOSES_ITSELF and tag != "p" and self.count[tag]:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in ("ul", "ol", "dl", "table"):
                    break
                if self.open[at].tag == tag:
                    self._close(at)
                    break
        elif self.count["p"]:
            left, at = self.count["p"], len(self.open)
            while left:
                at -= 1
                left -= self.open[at].tag == "p"
            self._close(at)
        got = dict(attrs)
        tokens = f"{got.get('class') or ''} {got.get('id') or ''}".lower().split()
        drop = (tag in FURNITURE or (got.get("role") or "").lower() in ROLES or "hidden" in got
                or got.get("aria-hidden") == "true"
                or "display:none" in (got.get("style") or "").replace(" ", "").lower())
        named = "" if tag in ("html", "body") else furniture_word(tag, tokens)
        node = Node(tag, ".".join([tag, *sorted(set((got.get("class") or "").split()))]), drop, named)
        if len(self.open) < MAX_DEPTH:
            self.open[-1].items.append(node)
        else:
            if len(self.open) > MAX_DEPTH:
                node.drop, node.named = drop or self.open[-1].drop, named or self.open[-1].named
            self.open[MAX_DEPTH - 1].items.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.count[tag]:
            at = len(self.open) - 1
            while self.open[at].tag != tag:
                at -= 1
            self._close(at)

    def handle_data(self, data):
        self._here().items.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    spare(builder.root)
    return builder.root


def blocks(node: Node, skip: set[int] = frozenset()) -> list[str]:
    """The texts of a node's blocks in page order, without furniture."""
    out, text = [], []

    def end():
        line = " ".join("".join(text).split())
        if line:
            out.append(line)
        text.clear()

    for item in node.items:
        if isinstance(item, str):
            text.append(item)
        else:
            end()
            if item is not None and not item.drop and id(item) not in skip:
                out.extend(blocks(item, skip))
    end()
    return out


class Shape:
    """A node of the tree that is aligned: like leaf siblings are one."""

    __slots__ = ("digest", "drop", "kids", "nodes", "own", "sig", "size", "slot")

    def __init__(self, sig, digest="", size=0, drop=False, kids=(), nodes=(), slot=False, own=""):
        self.sig, self.digest, self.size, self.drop, self.own = sig, digest, size, drop, own
        self.kids, self.nodes, self.slot = list(kids), list(nodes), slot

    def dump(self) -> list:
        return [self.sig, self.digest, self.size, int(self.drop), int(self.slot), [k.dump() for k in self.kids],
                self.own]

    @classmethod
    def load(cls, x: list) -> Shape:
        return cls(x[0], x[1], x[2], bool(x[3]), [cls.load(k) for k in x[5]], slot=bool(x[4]), own=x[6])


def shape(node: Node) -> Shape:
    """``size`` and ``own`` are of the node's own blocks, ``digest`` is of all below it."""
    kids: list[Shape] = []
    inner = [i for i in node.items if isinstance(i, Node)]
    if not node.drop:
        for item in inner:
            leaf = not any(isinstance(i, Node) for i in item.items)
            if leaf and kids and kids[-1].sig == f"{item.sig}*":
                kids[-1].nodes.append(item)
                kids[-1].size += sum(map(len, blocks(item)))
                continue
            kid = shape(item)
            if leaf:
                kid.sig += "*"
            kids.append(kid)
    own = Node(node.tag, node.sig, node.drop)
    own.items = [i if isinstance(i, str) else None for i in node.items]
    for kid in kids:
        if kid.sig.endswith("*"):
            kid.digest = kid.own = _digest([b for n in kid.nodes for b in blocks(n)])
    return Shape(node.sig, _digest([k.digest for k in kids] + blocks(own)),
                 0 if node.drop else sum(map(len, blocks(own))), node.drop, kids, [node],
                 own=_digest(blocks(own)))


def _digest(texts: list[str]) -> str:
    return md5("\n".join(texts).encode(errors="replace")).hexdigest()[:16] if texts else ""


def tree_match(a: Shape, b: Shape, pairs: list[tuple[Shape, Shape]] | None = None) -> int:
    """Simple tree matching: the most nodes of two trees that match in order,
    parent to parent. With ``pairs`` the matched nodes are added to it."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def table(x: Shape, y: Shape):
        key = (id(x), id(y))
        if key not in memo:
            m, n = len(x.kids), len(y.kids)
            best = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(m):
                for j in range(n):
                    both = 0
                    if x.kids[i].sig == y.kids[j].sig:
                        both = 1 + table(x.kids[i], y.kids[j])[0]
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + both)
            memo[key] = best[m][n], best
        return memo[key]

    def walk(x: Shape, y: Shape):
        pairs.append((x, y))
        best = table(x, y)[1]
        i, j = len(x.kids), len(y.kids)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                walk(x.kids[i], y.kids[j])

    if a.sig != b.sig:
        return 0
    score = 1 + table(a, b)[0]
    if pairs is not None:
        walk(a, b)
    return score


def _tag(x: Shape) -> str:
    return x.sig.split(".")[0].rstrip("*")


def _cover(x: Shape, skips, has) -> Shape | None:
    """The lowest node that holds all nodes below x for which ``has`` is true,
    without those for which ``skips`` is; groups of leaves and parts of lists,
    tables and leaves are not nodes of their own. None if there are none."""
    if x.drop or skips(x):
        return None
    if has(x):
        return x
    inner = [(k, c) for k in x.kids if (c := _cover(k, skips, has)) is not None]
    if not inner:
        return None
    kid, c = inner[0]
    return x if len(inner) > 1 or kid.sig.endswith("*") or _tag(x) in WHOLE else c


def _article(x: Shape) -> Shape | None:
    """The lowest node that holds all article and main elements with text."""
    def text(y: Shape) -> bool:
        return not y.drop and (y.size > 0 or any(map(text, y.kids)))

    return _cover(x, lambda y: False, lambda y: _tag(y) in ("article", "main") and not y.sig.endswith("*") and text(y)
                  or any(k.sig.endswith("*") and _tag(k) in ("article", "main") and text(k) for k in y.kids))


def induce(pages: list[Shape]) -> Shape:
    """The template of a host's reference pages: its tree has the digests of
    constant nodes only, and one node marked as the content slot."""
    pages = [p for p in pages if _cover(p, lambda x: False, lambda x: x.size > 0)] or pages[:1]
    base = max(pages, key=lambda p: sum(tree_match(p, q) for q in pages))
    met: dict[int, list[Shape]] = {}
    more: set[int] = set()
    for page in pages:
        pairs: list[tuple[Shape, Shape]] = []
        tree_match(base, page, pairs)
        matched = {id(y) for _, y in pairs}
        for x, y in pairs:
            met.setdefault(id(x), []).append(y)
            if any(_cover(k, lambda z: False, lambda z: z.size > 0) for k in y.kids if id(k) not in matched):
                more.add(id(x))

    def constant(x: Shape, part: str) -> bool:
        seen = met.get(id(x), [])
        return len(seen) > 1 and len({getattr(y, part) for y in seen}) == 1

    def varies(x: Shape) -> bool:
        return id(x) in more or (not constant(x, "own") and any(y.size for y in met.get(id(x), [])))

    slot = _cover(base, lambda x: id(x) not in more and constant(x, "digest"), varies)
    alike = slot is None or len(pages) == 1
    article = _article(base) if alike else None
    if alike:
        slot = article or _cover(base, lambda x: False, lambda x: x.size > 0) or base

    def template(x: Shape, inside: bool) -> Shape:
        inside = inside or x is slot
        known = article is not None and not inside
        return Shape(x.sig, x.digest if known or (not alike and constant(x, "digest")) else "", x.size, x.drop,
                     [template(k, inside) for k in x.kids], slot=x is slot,
                     own=x.own if known or (not alike and constant(x, "own")) else "")

    return template(base, False)


def extract(page: Node, template: Shape) -> str:
    """The page's main text: what is under the lowest node that holds both the
    node that meets the template's slot (or the page's own articles if none
    does) and all other text that is neither furniture nor template."""
    own = shape(page)
    pairs: list[tuple[Shape, Shape]] = []
    tree_match(template, own, pairs)
    known = {id(y): x for x, y in pairs}
    slot = next((y for x, y in pairs if x.slot), None) or _article(own)

    def constant(y: Shape) -> bool:
        x = known.get(id(y))
        return x is not None and x.digest != "" and x.digest == y.digest and y is not slot and not _holds(y, slot)

    def text(y: Shape) -> bool:
        x = known.get(id(y))
        return y is slot or (y.size > 0 and (x is None or x.own != y.own))

    at = _cover(own, constant, text)
    if at is None:
        return ""
    inside: set[int] = set()

    def mark(y: Shape) -> None:
        inside.add(id(y))
        for k in y.kids:
            mark(k)

    if slot is not None:
        mark(slot)
    skip = {id(n) for _, y in pairs if constant(y) and (id(y) not in inside or _tag(y) not in LEAVES)
            for n in y.nodes}
    return "\n".join(b for n in at.nodes for b in blocks(n, skip))


def _holds(x: Shape, y: Shape) -> bool:
    return any(k is y or _holds(k, y) for k in x.kids)


def _text(buf, a: int, b: int) -> str:
    return buf[a:b].tobytes().decode("utf-8", "replace")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches, "html"):
        out = [json.dumps(shape(parse(_text(buf, a, b))).dump())
               for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string())], names=["host", "shape"])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [json.dumps(induce([Shape.load(json.loads(s)) for s in sorted(x)]).dump())
               for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "template"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in pieces(batches, "html"):
        known: dict[str, Shape] = {}
        out = []
        for t, a, b in zip(rows.column(2).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if t not in known:
                known[t] = Shape.load(json.loads(t))
            out.append(extract(parse(_text(buf, a, b)), known[t]))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def host_templates(pages: DataFrame, refs: int = REFS) -> DataFrame:
    """(host, template) for rows (page_id, host, html)."""
    lots = [F.min(F.struct(F.xxhash64("page_id", F.lit(k)).alias("h"), "page_id")).alias(f"r{k}") for k in range(refs)]
    chosen = pages.groupBy("host").agg(*lots).select(
        F.col("host").alias("ref_host"),
        F.explode(F.array_distinct(F.array(*[F.col(f"r{k}.page_id") for k in range(refs)]))).alias("ref"))
    chosen = cut(chosen, "references")
    html = pages.join(small(chosen, chosen.count(), 64), F.col("page_id").eqNullSafe(F.col("ref"))
                      & (F.col("host") == F.col("ref_host")), "left_semi").dropDuplicates(["host", "page_id"])
    shapes = html.select("host", "html").mapInArrow(_shapes, "host string, shape string")
    return shapes.groupBy("host").agg(F.collect_list("shape").alias("shapes")).mapInArrow(
        _templates, "host string, template string")


def main_text(df: DataFrame, refs: int = REFS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select("page_id", "url", host.alias("host"), "html")
    templates = cut(host_templates(pages.select("page_id", "host", "html"), refs), "templates")
    size = templates.agg(F.count(F.lit(1)), F.sum(F.length("template") + 64)).first()
    joined = pages.join(small(templates, 1, size[1] or 0), "host")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "template", "html").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long")
