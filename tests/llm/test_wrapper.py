"""HTML extraction: article text without furniture, broken html, templates."""

import random

from delaymart.llm import wrapper

rnd = random.Random(9)


def text(n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def page(body, i, wrap="article"):
    open_, close = {"article": ("<article>", "</article>"), "div": ('<div class="story"><div class="body">',
                                                                  "</div></div>")}[wrap]
    return (f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x}}</style><script>var a='<p>no</p>';</script>"
            f"</head><body><header><p>Site {i}</p></header><nav><ul><li><a href=/>Menu {text(2)}</a><li>More</ul></nav>"
            f"<div class='ad'>Buy {text(4)}</div><div class='cookie-notice'>We use cookies</div>"
            f"<div class='legal'><p>Imprint and terms of this fine site</p></div>{open_}{body}{close}"
            f"<aside>Side {text(5)}</aside><form><p>Sign up</p><input></form>"
            f"<section id='comments'><p>First! {text(9)}</p></section><footer>&copy; {i} {text(3)}</footer></body></html>")


def cases(host, n, wrap, first):
    data, want = [], {}
    for i in range(first, first + n):
        paras = [text(rnd.randrange(5, 60)) for _ in range(rnd.randrange(1, 6))]
        lines = [f"Title &amp; {i}", *paras[:1], "Same  line\n on every page", *paras[1:]]
        data.append((i, f"https://{host}/p/{i}?q=1", page(f"<h1>{lines[0]}</h1>" + "".join(
            f"<p>{x.replace(' ', ' <b>', 1)}" if k % 2 else f"<p>{x}</p>" for k, x in enumerate(lines[1:])), i, wrap)))
        want[i] = "\n".join(" ".join(x.replace("&amp;", "&").split()) for x in lines)
    return data, want


def run(spark, data):
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    return wrapper.main_text(df.selectExpr("*", "-5 as host", "'x' as template", "1 as ref", "0 as text")).collect()


def test_articles_of_several_hosts(spark):
    data, want = [], {}
    for host, n, wrap, first in (("a.example", 30, "article", 0), ("b.example", 12, "div", 100),
                                 ("one.example", 1, "article", 200)):
        d, w = cases(host, n, wrap, first)
        data, want = data + d, want | w
    data += [(300, "https://a.example/empty", None), (301, "https://a.example/e", ""), (302, None, "<p>Only <i>this</i>"),
             (303, "odd", "no tags &lt;here&gt; at\xa0all"), data[3],
             (304, "https://a.example/long", page("<p>" + text(20_000) + "<br>end", 304)),
             (305, "https://a.example/x", "<article><p>one<p>two<div>three <b>3</article>"),
             (306, "https://c.example/x", "<div><p>same</p></div>"), (307, "https://c.example/y", "<div><p>same</p></div>")]
    want |= {300: "", 301: "", 302: "Only this", 303: "no tags <here> at all", 305: "one\ntwo\nthree 3", 306: "same",
             307: "same"}
    got = run(spark, data)
    assert len(got) == len(data)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] == 304:
            assert r["text"].endswith("\nend") and len(r["text"].split()) == 20_001
        else:
            assert r["text"] == want[r["page_id"]], r["page_id"]


def test_leads_beside_the_body_and_list_heavy_references():
    def texts(bodies):
        pages = [f"<html><body><nav><p>Menu</p></nav><div class='legal'><p>Imprint</p></div>{b}"
                 f"<footer>{text(3)}</footer></body></html>" for b in bodies]
        template = wrapper.induce([wrapper.shape(wrapper.parse(p)) for p in pages[:4]])
        template = wrapper.Shape.load(template.dump())
        return [wrapper.extract(wrapper.parse(p), template) for p in pages]

    def parts(*sizes):
        return [[text(n) for n in sizes] for _ in range(6)]

    lead = parts(3, 4, 90)
    got = texts([f"<article><h1>{a}</h1><p>{b}</p><div class=body><p>{c}</p></div></article>" for a, b, c in lead])
    assert got == ["\n".join(x) for x in lead]
    split = parts(15, 85)
    got = texts([f"<div class=intro><p>{a}</p></div><div class=text><p>{b}</p></div>" for a, b in split])
    assert got == ["\n".join(x) for x in split]
    lists = parts(5, 40, 40)
    bodies = [f"<article><ul><li>{b}<li>{c}</ul></article>" for _, b, c in lists[:4]]
    bodies += [f"<article><p>{a} {b}</p><ul><li>{c}</ul></article>" for a, b, c in lists[4:]]
    want = [f"{b}\n{c}" for _, b, c in lists[:4]] + [f"{a} {b}\n{c}" for a, b, c in lists[4:]]
    assert texts(bodies) == want
    late = parts(5, 80)
    bodies = [f"<div class=text><p>{b}</p></div>" for _, b in late[:4]]
    bodies += [f"<div class=lead><p>{a}</p></div><div class=text><p>{b}</p></div>" for a, b in late[4:]]
    assert texts(bodies) == [b for _, b in late[:4]] + [f"{a}\n{b}" for a, b in late[4:]]


def test_names_that_only_mention_furniture_and_deep_pages():
    def read(html):
        root = wrapper.parse(f"<html><body>{html}</body></html>")
        return wrapper.extract(root, wrapper.induce([wrapper.shape(root)])).split("\n")

    body = "<h2 class='section-header'>Head</h2><p class='notice-period'>One month</p><div id='search-results'>Hit</div>"
    want = ["Head", "One month", "Hit"]
    for attrs in ("class='post has-sidebar'", "class='content no-sidebar' id='main'", "class='entry share-enabled'",
                  "class='widget'"):
        for tag in ("article", "div"):
            assert read(f"<{tag} {attrs}>{body}</{tag}>") == want
    assert read(f"<div class='social'><main>{body}</main></div>") == want
    for name in ("ad", "cookie-notice", "sidebar-left", "comments-area", "related-posts", "site-header", "main_nav"):
        assert read(f"<article>{body}<div class='{name}'>Away</div></article>") == want
    for name in ("comments", "related"):
        teaser = f"<div id='{name}'><article>One more</article></div>"
        assert read(f"<div class='text'>{body}</div>{teaser}") == want
    for n in (10, 57, 58, 59, 60, 61, 62, 100, 3000):
        deep = "<div>" * n + "a<nav><div>no</div>no</nav><script>no</script><div>b</div>c" + "</div>" * n
        assert read(f"<article><div>x{deep}y</div><p>z</p></article>") == ["x", "a", "b", "c", "y", "z"]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tree_matching_is_the_largest_ordered_match():
    def tree(n, depth=0):
        kids = [tree(rnd.randrange(3), depth + 1) for _ in range(n)] if depth < 3 else []
        return wrapper.Shape(rnd.choice("ab"), kids=kids)

    def brute(x, y):
        if x.sig != y.sig:
            return 0

        def best(xs, ys):
            if not xs or not ys:
                return 0
            return max(best(xs[1:], ys), best(xs, ys[1:]), best(xs[1:], ys[1:]) + brute(xs[0], ys[0]))

        return 1 + best(x.kids, y.kids)

    for _ in range(40):
        a, b = tree(3), tree(3)
        pairs = []
        assert wrapper.tree_match(a, b, pairs) == brute(a, b) == len(pairs)
