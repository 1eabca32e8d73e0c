"""Main text of web pages by site style trees.

A page becomes a tree of its elements.  The pages of a host are merged node by
node: a node is known by its parent, its tag and class names, and how many
sisters of that kind stand before it; texts are leaves.  For each node the pages
are counted that have it, with each style (the sequence of its children) or,
for a leaf, each content.  Of ``m`` pages:

* a leaf's importance is the entropy of its contents to the base ``m``: 1 where
  each page says something else, 0 where all say the same;
* an element's own importance is the entropy of its styles to the base ``m``,
  and its composite importance ``(1 - damping^l)`` of that and ``damping^l`` of
  the mean of its children's, weighted by their pages, for ``l`` styles.

Importances rise from the leaves, one level of all trees at a time.  A leaf
below ``least`` goes from each page, and so does the whole branch of an element
below ``least`` under which nothing reaches ``telling``.  What fewer than
``min_seen`` pages have says nothing about a site: its importance is 1.  What
only one page says at a place stays on it.

Markup that says itself what it is goes too: menus, footers, forms, adverts,
comments, by tag, or by the class, id or role of an element that isn't the
article.  What stays is joined block by block, inside the page's article or main
element if it has one.

Rules: null html counts as empty and gives an empty text; a null address, or one
without a host, belongs to a host of its own.  Pages of a host with the same
blocks are one page in the tree, so that copies and repeated rows don't make an
article look like template; each row has its own result.  Ties don't matter:
nothing is chosen by order.  Pages of any length are parsed whole, in time that
grows with them; elements below level ``DEEPEST`` count as part of their
ancestor there.  An empty table gives none.  Further columns stay as they are,
whatever their names; ``text`` is replaced and the html left out.

Copies are dropped, and then counts summed, in each task before the shuffle, so
a host with a third of all pages costs a row for each different page, and a row
for each task, node and content.  The low nodes are joined to the pages by host;
Spark sees the size of that table and broadcasts it if it is small.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import saved, small_batches

#: A tag as browsers read it: quotes enclose only what follows an equals sign.
STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
#: The same where the page's quotes don't close.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no markup, or nothing to read.
RAW = frozenset("script style noscript template svg textarea title iframe select object".split())
#: Of these, the ones that run to the page's end if they have none.
CODE = frozenset(("script", "style"))
#: Elements that stand inside a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small source span strike strong sub sup time tt u var wbr picture ruby rt rp "
    "math mi mn mo ms mtext mrow mfrac msup msub msqrt mroot semantics annotation".split()
)
#: Elements that end without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head.
HEAD = frozenset("base link meta title style script noscript template".split())
#: Elements that are no main text wherever they stand.
NOISE_TAGS = frozenset("nav footer aside button menu dialog audio video canvas map fieldset label head".split())
#: Words in class, id and role that mark what is no main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup sidebar side rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments "
    "commentlist reply replies respond disqus discussion social share sharing related recommended recommendations pagination pager skip legal copyright login search "
    "contentinfo complementary alert outbrain taboola teaser".split()
)
#: A name that ends so is the article's, whatever stands before; one that begins so tells of something else.
ARTICLE_WORDS = frozenset("article articles main post posts story entry".split())
OTHER_FIRST = frozenset("no has have had with without not is category tag type status format layout template theme page".split())
#: What an article element may be instead of the article.
NO_ARTICLE = frozenset("comment comments reply teaser".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
#: An element of the first kind ends an open one of the second, up to the third.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Levels of a tree; a sister ends one that stands at most as many levels above.
DEEPEST = 64
SOFT, HARD = 1, 2

Token = tuple[str, bool, str]  # tag in lower case, whether it ends one, attributes


def tokens(page: str) -> Iterator[str | Token]:
    """Texts and tags in order; comments, declarations and raw elements are left out.

    Each part of the page is read a fixed number of times, whatever it holds:
    what isn't found once isn't sought again.
    """
    last, at, pos = page.rfind(">"), 0, 0
    pattern, unended, comments = STRICT, set(), True
    while 0 <= (pos := page.find("<", pos)) < last:
        end = -1
        if page.startswith("<!--", pos) and comments:
            end = page.find("-->", pos + 4)
            comments = end >= 0
            end = end + 3 if comments else -1
        if end < 0 and page[pos + 1 : pos + 2] in ("!", "?"):
            end = page.find(">", pos) + 1
        if end > 0:
            if pos > at:
                yield page[at:pos]
            at = pos = end
            continue
        m = pattern.match(page, pos)
        if m is None and pattern is STRICT and LOOSE.match(page, pos):
            pattern = LOOSE  # the quotes of this tag run to the page's end: from here on they say nothing
            m = LOOSE.match(page, pos)
        if m is None:
            pos += 1
            continue
        if pos > at:
            yield page[at:pos]
        at = pos = m.end()
        tag = m[2].lower()
        if tag in RAW and not m[1] and (tag in CODE or not m[3].endswith("/")):
            closing = None if tag in unended else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if closing:
                at = pos = closing.end()
                continue
            unended.add(tag)
            if tag in CODE:
                return
            continue
        if tag not in RAW:
            yield tag, bool(m[1]), m[3]
    if at < len(page):
        yield page[at:]


def marks(tag: str, attributes: str) -> tuple[str, int]:
    """Class names for the node, and whether the element says that it is no main text."""
    classes, noise = "", 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
        if key in ("class", "id", "role"):
            if any(_tells(tag, name) for name in value.split()):
                noise = SOFT
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
            noise = SOFT
    return classes, noise


def _tells(tag: str, name: str) -> bool:
    words = [w.lower() for w in NAME.findall(name)]
    if not words or tag in ("html", "body", "main") or words[0] in OTHER_FIRST or words[-1] in ARTICLE_WORDS:
        return False
    return words[0] in NO_ARTICLE if tag == "article" else any(w in NOISE_WORDS for w in words)


class Page:
    """The elements of a page as lists by number, parents first, and its blocks of text."""

    def __init__(self, page: str):
        self.parent, self.label, self.noise, self.main = [-1], [""], [0], [False]
        self.below: list[list[str]] = [[]]  # labels of children in order
        self.blocks: list[tuple[int, str]] = []  # element, text
        stack: list[tuple[str, int]] = [("", 0)]
        held: dict[str, int] = {}
        parts: list[str] = []

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.blocks.append((stack[-1][1], text))
                self.below[stack[-1][1]].append("#")

        def close(depth: int) -> None:
            for tag, _ in stack[depth:]:
                held[tag] -= 1
            del stack[depth:]

        for token in tokens(page):
            if isinstance(token, str):
                parts.append(token)
                continue
            tag, ends, attributes = token
            if tag == "br":
                parts.append(" ")
                continue
            if tag in INLINE:
                continue
            flush()
            if ends:
                if held.get(tag):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                continue
            if stack[-1][0] == "p" and tag in CLOSES_P or stack[-1][0] == "head" and tag not in HEAD:
                close(len(stack) - 1)
            if tag in SIBLINGS:
                close_to = self._sister(stack, held, *SIBLINGS[tag])
                if close_to:
                    close(close_to)
            if tag in VOID:
                continue
            up = stack[-1][1]
            classes, noise = marks(tag, attributes) if attributes else ("", 0)
            if tag in NOISE_TAGS:
                noise = HARD
            elif tag == "form" or tag == "header" and not self.main[up]:
                noise = SOFT
            self.parent.append(up)
            self.label.append(f"{tag}.{classes}" if classes else tag)
            self.noise.append(noise)
            self.main.append(self.main[up] or tag in MAIN_TAGS)
            self.below.append([])
            self.below[up].append(self.label[-1])
            stack.append((tag, len(self.parent) - 1))
            held[tag] = held.get(tag, 0) + 1
        flush()

    @staticmethod
    def _sister(stack: list[tuple[str, int]], held: dict[str, int], ends: set[str], limits: set[str]) -> int:
        """Where the open elements begin that this one ends; 0 if there are none."""
        if not any(held.get(t) for t in ends):
            return 0
        i = len(stack) - 1
        least = max(0, i - DEEPEST)
        while i > least and stack[i][0] not in limits and stack[i][0] not in ends:
            i -= 1
        if i <= least or stack[i][0] not in ends:
            return 0
        while i > 1 and stack[i - 1][0] in ends:
            i -= 1
        return i

    def digest(self) -> bytes:
        return xxhash.xxh3_128_digest("\0".join(x for e, text in self.blocks for x in (self.label[e], text)).encode("utf-8", "surrogatepass"))

    def nodes(self, host: str) -> tuple[list[int], list[int], list[int]]:
        """Keys and levels of the elements, and keys of the blocks' leaves."""
        key, level = [_hash(host)], [0]
        seen: list[dict[str, int] | None] = [None] * len(self.parent)

        def child(at: int, label: str) -> int:
            sisters = seen[at]
            if sisters is None:
                sisters = seen[at] = {}
            n = sisters[label] = sisters.get(label, -1) + 1
            return _hash(f"{key[at]} {label} {n}")

        tops = [0]  # the element of the tree that each stands for
        for i in range(1, len(self.parent)):
            up = tops[self.parent[i]]
            deep = level[up] >= DEEPEST
            tops.append(up if deep else i)
            key.append(key[up] if deep else child(up, self.label[i]))
            level.append(level[up] if deep else level[up] + 1)
        return key, level, [child(tops[e], "#") for e, _ in self.blocks]

    def kept(self) -> list[int]:
        """Numbers of the blocks that the markup leaves."""
        n = len(self.parent)
        noise, lifted = self._noisy(frozenset()), frozenset()
        own = [i for i in range(1, n) if self.main[i] and not self.main[self.parent[i]]]
        if own and all(noise[i] for i in own):  # names don't speak against what holds the only article
            above = set()
            for i in own:
                while (i := self.parent[i]) > 0 and i not in above:
                    above.add(i)
            lifted = frozenset(above)
            noise = self._noisy(lifted)
        left = [k for k, (e, _) in enumerate(self.blocks) if not noise[e]]
        inside = [k for k in left if self.main[self.blocks[k][0]]]
        return inside or left

    def _noisy(self, lifted: frozenset[int] | set[int]) -> list[bool]:
        out = [False]
        for i in range(1, len(self.parent)):
            out.append(out[self.parent[i]] or self.noise[i] == HARD or self.noise[i] == SOFT and i not in lifted)
        return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


NODE = (("node", pa.int64()), ("parent", pa.int64()), ("leaf", pa.bool_()), ("level", pa.int32()), ("value", pa.int64()))


def node_rows(page: Page, host: str) -> list[tuple[int, int, bool, int, int]]:
    """(node, parent, leaf, level, style or content) of each node of a page that has text below it."""
    key, level, leaves = page.nodes(host)
    rows: dict[int, tuple[int, int, bool, int, int]] = {}
    told = {0}
    for (e, text), leaf in zip(page.blocks, leaves, strict=True):
        rows[leaf] = leaf, key[e], True, level[e] + 1, _hash(text)
        while e not in told:
            told.add(e)
            up = page.parent[e]
            if key[up] != key[e]:
                rows[key[e]] = key[e], key[up], False, level[e], _hash(",".join(page.below[e]))
            e = up
    return list(rows.values())


def style_nodes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, node, parent, leaf, level, value, n): the different pages of a host that have the node with this style or content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, bytes], list] = {}
            for host, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(text.as_py() or "")
                key = host, page.digest()
                if key not in found:
                    found[key] = node_rows(page, host)
            parts = list(zip(*[x for own in found.values() for x in own], strict=True)) or [[] for _ in NODE]
            each = pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip(parts, NODE, strict=True)], names=[k for k, _ in NODE])
            ends = pa.array(list(accumulate(map(len, found.values()), initial=0)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.ListArray.from_arrays(ends, each)], names=["host", "page", "nodes"])

    own = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    each = own.mapInArrow(run, "host string, page binary, nodes array<struct<node:bigint,parent:bigint,leaf:boolean,level:int,value:bigint>>")
    each = each.groupBy("host", "page").agg(F.first("nodes").alias("nodes")).select("host", F.inline("nodes"))
    return each.groupBy("host", "node", "parent", "leaf", "level", "value").agg(F.count(F.lit(1)).alias("n"))


def importance(values: DataFrame, min_seen: int, damping: float = 0.9) -> DataFrame:
    """(host, node, leaf, own, high) of nodes that ``min_seen`` pages have: importance, and the highest in the branch."""
    n = F.col("n").cast("double")
    by = values.groupBy("host", "node", "parent", "leaf", "level").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(n * F.log(n)).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("nlogn") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    nodes = saved(by.withColumn("e", F.greatest(entropy, F.lit(0.0))).drop("nlogn"), "style_nodes")
    below = nodes.groupBy(F.col("parent").alias("p")).agg(F.sum("m").alias("all"))
    often = nodes.filter(F.col("m") >= min_seen)
    often = saved(often.join(below, often["node"] == below["p"], "left").drop("p"), "style_often")
    deepest = often.agg(F.max("level")).first()[0] or 0  # DEEPEST + 1 at most
    levels: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        own = often.filter(F.col("level") == level)
        if levels:
            kids = levels[-1].groupBy(F.col("parent").alias("p")).agg(F.sum(F.col("m") * F.col("own")).alias("s"), F.sum("m").alias("k"), F.max("high").alias("h"))
        else:
            kids = own.limit(0).select(F.col("parent").alias("p"), F.lit(0.0).alias("s"), F.col("m").alias("k"), F.lit(0.0).alias("h"))
        met = own.join(kids, own["node"] == kids["p"], "left")
        rare = F.col("all") - F.coalesce("k", F.lit(0))  # children that too few pages have: each 1
        mean = (F.coalesce("s", F.lit(0.0)) + rare) / F.col("all")
        share = F.pow(F.lit(damping), F.col("l"))
        both = F.when(F.col("leaf"), F.col("e")).otherwise((1 - share) * F.col("e") + share * mean)
        met = met.withColumn("own", both).withColumn("high", F.greatest("own", F.coalesce("h", F.lit(0.0)), F.when(rare > 0, 1.0).otherwise(0.0)))
        levels.append(saved(met.select("host", "node", "parent", "leaf", "m", "own", "high"), "style_level"))
    out = levels[0] if levels else often.select("host", "node", "parent", "leaf", "m", F.col("e").alias("own"), F.col("e").alias("high"))
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("host", "node", "leaf", "own", "high")


def low_nodes(pages: DataFrame, url_col: str, html_col: str, min_seen: int, least: float, telling: float) -> DataFrame:
    """(host, low, often): the leaves and branches of each host that go, and the contents that stand on several of its pages."""
    values = saved(style_nodes(pages, url_col, html_col), "style_values")
    found = saved(importance(values, min_seen), "style_importance")
    low = found.filter((F.col("own") < least) & (F.col("leaf") | (F.col("high") < telling)))
    again = values.filter("leaf AND n > 1").join(found.filter(F.col("own") < telling).select(F.col("node").alias("k")), F.col("node") == F.col("k"))
    either = low.select("host", "node", F.lit(None).cast("bigint").alias("both")).unionByName(again.select("host", F.lit(None).cast("bigint").alias("node"), F.col("node").bitwiseXOR(F.col("value")).alias("both")))
    return either.groupBy("host").agg(F.collect_set("node").alias("low"), F.collect_set("both").alias("often")).filter(F.size("low") > 0)


def text_of(html_text: str, host: str = "", low: frozenset[int] = frozenset(), often: frozenset[int] = frozenset()) -> str:
    page = Page(html_text)
    left = page.kept()
    if low and left:
        key, _, leaves = page.nodes(host)
        gone = [False]
        for i in range(1, len(key)):
            gone.append(gone[page.parent[i]] or key[i] in low)
        left = [k for k in left if not ((leaves[k] in low or gone[page.blocks[k][0]]) and leaves[k] ^ _hash(page.blocks[k][1]) in often)]
    return "\n\n".join(page.blocks[k][1] for k in left)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_seen: int = 20, least: float = 0.25, telling: float = 0.5) -> DataFrame:
    """The rows without their html, with its main text as ``text``."""
    small_batches(pages.sparkSession)
    low = saved(low_nodes(pages, url_col, html_col, min_seen, least, telling), "style_low").withColumnsRenamed({"host": "__key", "low": "__low", "often": "__often"})
    names = [c for c in pages.columns if c not in (html_col, "text")]
    schema = pages.select(*[pages[c] for c in names]).schema.add("text", "string")
    rows = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(names)], host_of(pages[url_col]).alias("__host"), pages[html_col].alias("__html"))
    rows = rows.join(low, rows["__host"] == low["__key"], "left").drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        sets: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            out = []
            for host, page, low, often in zip(b.column(n).to_pylist(), *b.columns[n + 1 : n + 4], strict=True):
                if host not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[host] = frozenset(low.as_py() or ()), frozenset(often.as_py() or ())
                out.append(text_of(page.as_py() or "", host, *sets[host]))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, schema)
