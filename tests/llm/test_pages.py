"""Main text by hand-made pages, and style trees against the definition written out page by page."""

import math
import random
import time
from collections import defaultdict

import pytest

from chronolith.llm import maintext

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header class="top"><a href="/">Site</a></header><nav><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; <b>tail</b></h1><p>First <i>pa</i>ra<br>graph&nbsp;x<p>Second &lt;b&gt;
<aside>side</aside><form><p>mail</p><button>go</button></form><script>var s="</p>";</script>
<table><tr><td>a<td>b</table><div class="comments"><p>Nice!</p></div></article>
<!-- gone --><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert maintext.text_of(PAGE) == "Head & tail\n\nFirst para graph x\n\nSecond <b>\n\na\n\nb"
    assert maintext.text_of("plain <b>text</b> only") == "plain text only"
    assert maintext.text_of("") == "" and maintext.text_of("<p>open <script>x") == "open"


@pytest.mark.parametrize(
    "page,want",
    [
        ("One. <svg-icon></svg-icon> Two. Three.", "One.\n\nTwo. Three."),
        ("<p>a</p><select-box><p>b</p></select-box><title-bar>c</title-bar><object-x>d</object-x>", "a\n\nb\n\nc\n\nd"),
        ("<p>a</p><select><p>b</p><iframe src=x><p>c</p>", "a\n\nb\n\nc"),
        ("<body><main class='content no-sidebar'><p>a</p></main></body>", "a"),
        ("<article class='post has-comments category-legal tag-search'><p>a</p></article>", "a"),
        ("<div id='search-article'><p>a</p></div>", "a"),
        ("<form id=all><article><p>a</p><form><p>b</p></form></article><p>c</p></form>", "a"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "Let x=2 be"),
        ("<p title=don't>a</p><p>b</p>", "a\n\nb"),
        ("<p>a</p><div class='post-comments'><p>b</p></div><div class='sidebar-content'>c</div><div class=commentlist>d</div>", "a"),
        ("<article><p>a</p></article><aside><article class=teaser><p>b</p></article></aside>", "a"),
        ("<article><p>a</p><article class='comment'><p>b</p></article></article>", "a"),
        ("<p>a < b and c > d</p><!-- x <p>y</p>", "a < b and c > d\n\ny"),
        ("<p>x <a title=\"1>0\" href='>'>y</a></p>", "x y"),
        ("<p>a</p><div hidden>b</div><div data-hidden=1>c</div>", "a\n\nc"),
        ("<head><title>t</title><p>a</p>", "a"),
        ("<p>a</p><svg><text>b</text></svg><noscript>c</noscript><textarea>d</textarea>", "a"),
    ],
)
def test_markup(page, want):
    assert maintext.text_of(page) == want


@pytest.mark.parametrize("piece", ['<a "', "<a ='", '<a x=">" ', "<div>", "<li><div>", "<iframe>", "<!--", "<", "</p>", "&amp;", "<p class='a b'>word "])
def test_time_grows_with_the_page(piece):
    def took(n):
        began = time.perf_counter()
        maintext.text_of("<ul><li>" + piece * n + ">")
        return time.perf_counter() - began

    took(1000)
    small, large = min(took(10_000) for _ in range(3)), took(100_000)
    assert large < 40 * small + 0.5


def test_deep_pages():
    page = "<div>" * 5000 + "<p>a</p><aside>b</aside>" + "</div>" * 5000 + "<p>c</p>"
    assert maintext.text_of(page) == "a\n\nc"
    rows = maintext.node_rows(maintext.Page(page), "h")
    assert max(r[3] for r in rows) == maintext.DEEPEST + 1 and len({r[0] for r in rows}) == len(rows)


def tree(pages):
    """(importance, highest in the branch) of each node of a site's tree, a node being the path of (label, place among its kind)."""
    styles, contents, kids = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for p in {x.digest(): x for x in map(maintext.Page, pages)}.values():
        paths, count = [()], defaultdict(int)

        def child(up, label, count=count):
            count[up, label] += 1
            return (*up, (label, count[up, label]))

        for i in range(1, len(p.parent)):
            paths.append(child(paths[p.parent[i]], p.label[i]))
        seen = set()
        for e, text in p.blocks:
            leaf = child(paths[e], "#")
            contents[leaf][text] += 1
            kids[paths[e]].add(leaf)
            while e > 0 and e not in seen:
                seen.add(e)
                styles[paths[e]][tuple(p.below[e])] += 1
                kids[paths[p.parent[e]]].add(paths[e])
                e = p.parent[e]

    def entropy(c):
        m = sum(c.values())
        return -sum(n / m * math.log(n / m, m) for n in c.values()) if m > 1 else 1.0

    pages_of = {k: sum(v.values()) for k, v in (*styles.items(), *contents.items())}

    def judged(node):
        if pages_of[node] < 20:
            return 1.0, 1.0
        if node in contents:
            e = entropy(contents[node])
            return e, e
        g = 0.9 ** len(styles[node])
        below = [(pages_of[k], *judged(k)) for k in kids[node]]
        own = (1 - g) * entropy(styles[node]) + g * sum(n * x for n, x, _ in below) / sum(n for n, _, _ in below)
        return own, max(own, *(h for _, _, h in below))

    return [judged(k) for k in pages_of if pages_of[k] >= 20]


def site(r, n=70):
    """Pages with a varying menu, a box that is nearly the same everywhere, a fixed tail and an article."""
    out = []
    for i in range(n):
        menu = "".join(f"<li>{x}</li>" for x in ("home", "news", "about")[: r.choice((3, 3, 3, 2))])
        box = f"<section><p>Read our magazine</p><p>Issue {r.choice('aaaaaaab')}</p></section>" if r.random() < 0.9 else ""
        story = "".join(f"<p>story {i} {j}</p>" for j in range(r.randrange(1, 6)))
        out.append(f"<html><body><div><ul>{menu}</ul></div>{box}<div class='t'><h1>Head {i}</h1>{story}</div><div class='z'><p>All rights</p></div></body></html>")
    return out


def test_importance(spark):
    r = random.Random(3)
    own = site(r)
    rows = [(f"http://h/{i}", p) for i, p in enumerate(own + own[:20])]
    df = spark.createDataFrame(rows, "url string, html string").repartition(3)
    got = maintext.importance(maintext.style_nodes(df, "url", "html"), 20).collect()
    want = tree(own)
    assert sorted((round(x["own"], 9), round(x["high"], 9)) for x in got) == sorted((round(a, 9), round(b, 9)) for a, b in want)
    texts = {x["url"]: x["text"] for x in maintext.extract(df).collect()}
    for i, p in enumerate(own):
        assert texts[f"http://h/{i}"] == "\n\n".join(f"{x}" for x in [f"Head {i}", *[f"story {i} {j}" for j in range(p.count("story"))]])


def test_style_trees(spark):
    """An unmarked box that says the same on every page goes; the same words in an article stay."""
    rows = [(i, f"http://h/{i}", f"<body><div class='x'><p>Read our magazine</p></div><div class='t'><p>Story {i} of many</p><p>{'Read our magazine' if i < 3 else i}</p></div></body>") for i in range(30)]
    rows += [(99, "http://lone/1", "<body><div class='x'><p>Read our magazine</p></div></body>"), (100, None, None), (101, "http://h/101", ""), (101, "http://h/101", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", *[f"page_id AS {c}" for c in ("host", "node", "low", "text", "nodes", "__low", "p")])
    out = maintext.extract(df)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "host", "node", "low", "nodes", "__low", "p", "text"] and out.count() == len(rows)
    assert got[1]["text"] == "Story 1 of many\n\nRead our magazine" and got[99]["text"] == "Read our magazine" and got[100]["text"] == got[101]["text"] == "" and got[5]["host"] == 5
    assert maintext.extract(df.limit(0)).count() == 0


def test_style_trees_copies(spark):
    """Many copies of one page take no heading from it, nor from the different pages of its host."""
    page = lambda k: f"<body><div class='x'><p>Read our magazine</p></div><div class='t'><h1>Head {k}</h1><p>Story {k} of many</p></div></body>"
    rows = [(i, "http://h/1", page("a")) for i in range(200)] + [(200 + i, f"http://h/{i}", page(i)) for i in range(30)]
    rows += [(300 + i, f"http://one/{i}", page("b")) for i in range(25)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in maintext.extract(df).collect()}
    assert all(got[i] == "Head a\n\nStory a of many" for i in range(200)) and all(got[200 + i] == f"Head {i}\n\nStory {i} of many" for i in range(30))
    rows = [(i, f"http://h/{i}", f"<body><div><p>{'Same' if i % 40 else f'Only {i}'}</p></div><p>Story {i}</p></body>") for i in range(200)]
    own = {r["page_id"]: r["text"] for r in maintext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(own[i] == (f"Story {i}" if i % 40 else f"Only {i}\n\nStory {i}") for i in range(200))
    assert all(got[300 + i] == "Read our magazine\n\nHead b\n\nStory b of many" for i in range(25))
    nodes = maintext.style_nodes(df, "url", "html").filter("host = 'h' AND leaf").groupBy("node").sum("n").collect()
    assert [r["sum(n)"] for r in nodes] == [31] * 3


def test_hosts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("HTTPS://user@Site.Example:80/x",), (None,), ("no address",)], "u string")
    assert [r[0] for r in df.select(maintext.host_of(F.col("u"))).collect()] == ["site.example", "", ""]
