"""Main text of web pages by a site style tree: one tree a host, importance by entropy, branches of little of it removed."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quern.llm.common import only, skew_lookup, staged, table

# The roles of elements in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "caption"))
RAW = frozenset("script style textarea title iframe xmp noframes noembed noscript template svg annotation annotation-xml select button head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu dialog search fieldset".split())
MAIN = frozenset(("article", "main"))
SCOPES = frozenset("article aside blockquote body dd details div fieldset figure footer form header li main nav section table tbody td th thead tr ul ol dl html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}  # what a start tag ends, beside an open p
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NAMES = (
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related "
    "reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget"
).split()
#: What may follow a name in a class or id.
LAYOUT = "area bar block box buttons container content inner left list links outer right section slot top unit wrap wrapper".split()
#: Whole class tokens that are a name, or end in one, but for those that deny or only mention it.
NAMED = re.compile(rf"(?:^|\s)(?!(?:no|not|has|have|with|without|hide|show|is)[_-])(?:\S*[_-])?(?:{'|'.join(NAMES)})(?:[_-]+(?:{'|'.join(LAYOUT)}))*(?=$|\s)", re.I)
#: Names of what readers write: no two pages agree in it, so no tree can tell it from an article.
READERS = re.compile(r"(?:^|\s)(?:\S*[_-])?(?:comments?|disqus|replies|reply|respond)(?=$|[\s_-])", re.I)
#: Names that count outside of article and main only, as a header element does.
HEADED = re.compile(r"(?:^|\s)(?:(?:site|global|top)[_-]+)?(?:header|masthead)(?=$|\s)", re.I)
#: The share of an article's text from which a branch of it does not go.
WHOLE = 0.9

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: What may still come after the last '>' of a page.
OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: A branch goes that has less than this share of the importance of its host's text: by what it says and how it is laid
#: out alone, within a main element, and if its prior is 0.
LEAST, INNER, SAID = 0.6, 0.06, 0.9
#: The prior counts as so many pages: on them a branch is of importance 1, or 0 if its name is one of NAMES or it is beside
#: the main elements of its pages.
PRIOR = 8
#: Weight of what a branch says against how it is laid out, by the power of its height.
DECAY = 0.9

NODE = "host string, page long, key long, height int, style long, content long, chars long, named boolean, inner boolean"


class Tree:
    """The block elements of a page, as parallel lists, and its blocks of text (element, words)."""

    def __init__(self, html: str):
        self.parent, self.key, self.tag = [-1], [0], [""]
        self.low, self.named, self.readers, self.main, self.article = [False], [False], [False], [False], [0]
        self.links: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _open(self, tag: str, name: str, low: bool, named: bool, readers: bool, up: int) -> int:
        self.parent.append(up)
        self.tag.append(tag)
        self.key.append(xxh3_64_intdigest(f"{self.key[up]} {tag} {name}".encode()) >> 1)
        self.low.append(self.low[up] or low)
        self.named.append(named)
        self.readers.append(readers)
        self.article.append(len(self.key) - 1 if tag == "article" else self.article[up])
        self.main.append(self.main[up] or tag in MAIN)
        self.links.append([])
        return len(self.key) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open block elements
        muted: list[str] = []  # open inline elements that a rule drops
        buffer: list[str] = []
        opened: Counter = Counter()  # how many elements of a tag are on the stack
        endless: set[str] = set()  # raw elements that nothing closes from here on
        at, end, last = 0, len(html), html.rfind(">")

        def cut(i: int) -> None:
            opened.subtract(tag for tag, _ in stack[i:])
            del stack[i:]

        def flush() -> None:
            if buffer:
                if text := " ".join("".join(buffer).split()):
                    self.blocks.append((stack[-1][1], text))
                buffer.clear()

        while at < end:
            m = at <= last and TOKEN.search(html, at, last + 1) or OPEN.search(html, max(at, last + 1))
            stop = m.start() if m else end
            if stop > at and not muted:
                buffer.append(unescape(html[at:stop]))
            if m is None:
                break
            at = m.end()
            if at == last + 1 and m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "--!>", "]]>")):
                break  # what nothing closes holds all that follows
            tag = m.lastindex and (m[2] or m[5])
            if not tag:
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
            if tag in RAW and not closing:
                if not rest.endswith("/"):
                    over = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at, last + 1)
                    if not over:
                        endless.add(tag)
                    # what is never closed would swallow the page: only scripts and the like may do so
                    at = over.end() if over else end if tag in ("script", "style", "textarea", "title") else at
                continue
            if tag not in BLOCKS:
                if tag == "br" or tag in CELLS:
                    if not muted:
                        buffer.append(" ")
                elif closing:
                    if muted and muted[-1] == tag:
                        muted.pop()
                elif tag not in VOID:
                    if muted:
                        if muted[-1] == tag:
                            muted.append(tag)
                    elif rest:
                        name, low, named, link = self._attributes(rest, self.main[stack[-1][1]])
                        if link and tag == "a":
                            self.links[stack[-1][1]].append(link)
                        if (low or named) and not rest.endswith("/"):
                            muted.append(tag)
                continue
            muted.clear()
            flush()
            if closing:
                if opened[tag]:
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                continue
            for ended in (("p",), CLOSES.get(tag, ())):  # start tags that end an open element
                for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
                    if stack[i][0] in ended:
                        cut(i)
                        break
                    if stack[i][0] in SCOPES and not (stack[i][0] == "tr" and "tbody" in ended):
                        break
            up = stack[-1][1]
            name, low, named, _ = self._attributes(rest, self.main[up]) if rest else ("", False, False, "")
            may = tag not in ("html", "body") and tag not in MAIN
            low = low and may or tag in DROPPED or (tag == "header" and not self.main[up])
            readers = named and may and bool(READERS.search(name.replace("class=", " ").replace("id=", " ")))
            node = self._open(tag, name, low, named and may, readers, up)
            if tag not in VOID:
                stack.append((tag, node))
                opened[tag] += 1
        flush()

    @staticmethod
    def _attributes(rest: str, main: bool) -> tuple[str, bool, bool, str]:
        """Class and id, whether the role or ``hidden`` marks something dropped, whether class or id do, and the link."""
        name, low, named, link = [], False, False, ""
        for k, a, b, c in ATTRIBUTE.findall(rest):
            k, v = k.lower(), a or b or c
            if k in ("class", "id"):
                name.append(f"{k}={v}")
                named = named or bool(NAMED.search(v)) or not main and bool(HEADED.search(v))
            elif k == "role":
                low = low or v.lower() in ROLES
            elif k == "hidden":
                low = True
            elif k == "href":
                link = v
        return " ".join(name), low, named, link

    def features(self) -> list[tuple]:
        """Of each style node that no rule drops: key, height, style (tags of the children), content (texts and links of the
        branch), how many characters it holds itself, whether its prior is 0 (it is named, or beside the main elements), and
        whether it is in a main element."""
        n = len(self.key)
        _, main = self._said()
        height, chars, child, said = [0] * n, [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
        for node, text in self.blocks:
            said[node].append(text)
            chars[node] += len(text)
        for i in range(n - 1, 0, -1):  # children come after their parents
            said[i] += self.links[i]
            up = self.parent[i]
            height[up] = max(height[up], height[i] + 1)
            child[up].append(self.tag[i])
            said[up].append(str(xxh3_64_intdigest("\n".join(said[i]).encode())))
        by_key: dict[int, list] = {}
        for i in range(1, n):
            if not self.low[i]:
                known = by_key.setdefault(self.key[i], [0, [], [], 0, self.named[i] or bool(main[0]) and not main[i], self.main[i]])
                known[0] = max(known[0], height[i])
                known[1] += [*reversed(child[i]), "/"]
                known[2] += [*said[i], "/"]
                known[3] += chars[i]
        digest = lambda xs: xxh3_64_intdigest("\n".join(xs).encode()) >> 1
        return [(k, h, digest(style), digest(content), *more) for k, (h, style, content, *more) in by_key.items()]

    def _said(self) -> tuple[list[int], list[int]]:
        """Characters of each branch that no rule drops, and of the main elements in it."""
        n = len(self.key)
        said, main = [0] * n, [0] * n
        for i, text in self.blocks:
            if not self.low[i]:
                said[i] += len(text)
                main[i] += len(text) if self.main[i] else 0
        for i in range(n - 1, 0, -1):
            said[self.parent[i]] += said[i]
            main[self.parent[i]] += main[i]
        return said, main

    def text(self, weak: frozenset[int], stay: frozenset[int] | None = None) -> str:
        """The blocks that neither a rule nor the tree of the site (``weak``: keys) removes.

        ``stay``: without a tree, branches with names go but for these keys, and so does what is beside the main elements.
        What readers write goes either way.  What holds most of the page's main elements' text (of its text, where it has
        none) stays, and so does nearly all of an article.  A page of which the tree would leave nothing is left to the rules.
        """
        n = len(self.key)
        said, main = self._said()
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]]
            if not gone[i] and (self.readers[i] or self.key[i] in weak or stay is not None and self.named[i] and self.key[i] not in stay):
                a = self.article[self.parent[i]]
                most = said[i] >= WHOLE * said[a] if a else 2 * main[i] >= main[0] if main[0] else self.named[i] and 2 * said[i] >= said[0]
                gone[i] = not most or not said[i]
        blocks = [(i, t) for i, t in self.blocks if not self.low[i]]
        left = [(i, t) for i, t in blocks if not gone[i]] or blocks
        if any(self.main[i] for i, _ in left):  # what stands between the main elements, or (without a tree) beside them, is no text
            left = [(i, t) for i, t in left if self.main[i] or stay is None and not main[i]]
        return "\n\n".join(t for _, t in left)


def style_tree(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page, copies, weak: keys of each page's style nodes that are of little importance in its host's merged tree.

    ``pages``: host, page (the hash of host and html; null where the host is), html.  Pages of equal html count once.  A
    node's content importance is the entropy of its contents over the host's pages, its presentation importance that of
    its child sequences, both against the logarithm of the node's pages: 0 if all pages agree, 1 if none do.  A branch of
    height h weighs content by DECAY ** h, presentation by the rest.  Every node is judged, on however few pages: a prior
    of PRIOR pages joins what the m pages say.  A node goes whose importance is less than ``least`` times that of the
    host's text (its nodes' importance, weighed by their characters); in proportion less within main elements, and more
    if its class or id is a name of boilerplate or it is beside the main elements.  What is found goes to the pages by node, nodes of many pages by
    broadcast: nothing is held by host.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), *(pa.int64(),) * 2, pa.int32(), *(pa.int64(),) * 3, *(pa.bool_(),) * 2)
        names = ["host", "page", "key", "height", "style", "content", "chars", "named", "inner"]
        for b in batches:
            for a in range(0, b.num_rows, 512):
                rows = [(host, page, *f) for host, page, html in zip(*(c.to_pylist() for c in b.slice(a, 512).columns), strict=True) for f in Tree(html).features()]
                cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    known = pages.where("host is not null")
    x = known.select("host", "page", "html").mapInArrow(parse, NODE).withColumn("node", F.xxhash64("host", "key")).withColumn("site", F.xxhash64("host"))
    one = ("site", "key", "height", "style", "content", "chars", "named", "inner")
    x = staged(x.groupBy("node", "page").agg(*(F.min(c).alias(c) for c in one)), "page-nodes")

    def entropy(what: str, *more: Column) -> DataFrame:
        each = x.groupBy("node", what).agg(F.count("*").alias("n"), F.max("height").alias("height"), F.sum("chars").alias("chars"), *(F.min(c).alias(c) for c in ("site", "named", "inner")))
        e = each.groupBy("node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"), *more)
        h = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("m") * F.ln("m")))).otherwise(F.lit(1.0))
        return e.withColumn(f"h_{what}", h).drop("s")

    more = (F.max("height").alias("height"), F.sum("chars").alias("chars"), *(F.min(c).alias(c) for c in ("site", "named", "inner")))
    nodes = entropy("content", *more).join(entropy("style").drop("m"), "node")
    weight = F.pow(F.lit(DECAY), F.col("height"))
    nodes = staged(nodes.withColumn("told", F.col("m") * (weight * F.col("h_content") + (1 - weight) * F.col("h_style"))), "style-nodes")
    importance = (F.col("told") + F.when(F.col("named"), 0.0).otherwise(float(PRIOR))) / (F.col("m") + PRIOR)
    unnamed = (F.col("told") + PRIOR) / (F.col("m") + PRIOR)
    hosts = nodes.groupBy("site").agg((F.sum(unnamed * F.col("chars")) / F.sum("chars")).alias("usual"), F.count("*").alias("nodes"))
    hosts = staged(hosts, "sites")
    nodes = skew_lookup(nodes, hosts, "site", "nodes", nodes.count(), F.col("node"))
    share = F.when(F.col("named"), SAID).when(F.col("inner"), least * INNER / LEAST).otherwise(least)
    # important nodes stay in: skew_lookup must know of every node with many pages
    judged = staged(nodes.select("node", "m", (importance < share * F.coalesce("usual", F.lit(1.0))).alias("low")), "judged-nodes")
    found = skew_lookup(x.select("node", "page", "key"), judged, "node", "m", x.count(), F.col("page")).where("low")
    weak = found.groupBy("page").agg(F.sort_array(F.collect_list("key")).alias("weak"))
    weak = known.groupBy("page").agg(F.count("*").alias("copies")).join(weak, "page", "left")
    return weak.select("page", "copies", F.coalesce("weak", F.array().cast("array<bigint>")).alias("weak"))


def extracted(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text of every row of ``pages``."""
    x = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    x = x.withColumn("host", F.nullif(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")))
    x = x.withColumn("page", F.when(F.col("host").isNotNull(), F.xxhash64("host", "html")))

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                ids, urls, keys, htmls = b.slice(a, 512).columns
                yield pa.RecordBatch.from_arrays([ids, urls, keys, pa.array([zlib.compress(h, 1) for h in htmls.to_pylist()], pa.binary())], names=["page_id", "url", "page", "html"])

    # the pages themselves meet their nodes in a shuffle, so they are made small before it
    small = x.select(F.col("page_id").cast("long"), "url", "page", F.col("html").cast("binary")).mapInArrow(deflate, "page_id long, url string, page long, html binary")
    x = skew_lookup(small, staged(style_tree(x, least), "style-tree"), "page", "copies", pages.count(), F.col("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                ids, urls, htmls, weak = (c.to_pylist() for c in b.slice(a, 512).columns)
                none = frozenset()
                texts = [Tree(zlib.decompress(h).decode()).text(frozenset(w or ()), none if w is None else None) for h, w in zip(htmls, weak, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return x.select("page_id", "url", "html", "weak").mapInArrow(run, "page_id long, url string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    Null or empty html: an empty text.  A page whose url is null or has no host is judged by the rules and by names.
    Null or repeated page_ids: a row for each row.  Empty table: no rows.  Reading a page takes time in proportion to its
    length, well-formed or not.  Further columns are not read.
    """
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
