"""Main text of web pages by a site style tree.

The DOMs of a host are merged: elements with the same path of tags and classes
are one node of the tree. Over the distinct pages of the host, a node's
importance is the entropy of its contents and of the sequences of its children,
as a share of the most there can be: what says the same on every page is low, an
article is high. Branches of low importance are cut from each page. Hosts with
fewer than PAGES distinct pages share the tree of their domain (the last two
labels), and domains with fewer that of all such.

What a page says of itself comes first: menus, headers, footers, sidebars, forms,
adverts and comments by tag, role or class are cut. Names that articles use as
well (WEAK: notice, related, search ...) cut outside an article; inside, the tree
decides, with a milder limit for them. If the article or main elements of a page
hold at least half of its remaining text, that is the text; else (a teaser in an
article beside the body) all of it is. The tree decides on the remaining containers
and blocks. A block (paragraph, heading, item, cell) is a leaf of the tree; its
importance is 1 - log d / log m if d of the m pages that have such a leaf say the
same in it. So what one article alone says is never cut as a block, and inside an
article only what most repeat.

Reading a page takes time in proportion to its length, however broken. Text:
character references decoded, white space in a block one space, blocks by "\\n";
a line break inside a block is white space. Defined results: null or empty html
gives ""; a null url is the host ""; broken markup is read to its end; a quote
that never closes is a sign like others; scripts end at their end tag only; pages
count once that are copies, or differ only in what they cut themselves; other
columns than page_id, url and html are not in the result.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Distinct pages that a host must have for its tree to count.
PAGES = 5
#: Importance under which a branch or block is cut inside an article, elsewhere, and a branch with a WEAK name.
LIMITS = (0.2, 0.5, 0.8)
INSIDE, OUTSIDE, NAMED = range(3)
#: Weight of contents against presentation.
CONTENT = 0.9

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Kinds of elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table pre blockquote figcaption caption".split())
CUT = frozenset("head nav footer aside form script style noscript template button select option svg canvas dialog menu iframe object video audio textarea".split())
MAIN = frozenset("article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|toolbar|share|sharing|comments?|"
    r"replies|disqus|pagination|skip-link|sr-only)(?:$|[\s_-])", re.I)
WEAK = re.compile(r"(?:^|[\s_-])(?:promo\w*|banner|notices?|alert|widget\w*|social|related|recommend\w*|respond|pager|search)(?:$|[\s_-])", re.I)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def attributes(text: str) -> dict[str, str]:
    """Values by name in lower case; of a name that repeats, the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each tag; comments and declarations have no name.

    Each place is looked at a bounded number of times: from the first tag on whose
    quotes take to the end of the page, quotes are signs like others.
    """
    at, size, quotes = 0, len(html), True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = end + 3 if end >= 0 else size
            yield at, end, "", False, ""
            at = end
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            if end < 0:
                return
            yield at, end + 1, "", False, ""
            at = end + 1
            continue
        m = TAG.match(html, at)
        if not m:
            at += 1
            continue
        end = m.end()
        while quotes and (stop := STOP.search(html, end)):
            if stop[0] == ">":
                end = stop.start()
                break
            end = html.find(stop[0], stop.end()) + 1
            if not end:
                quotes = False
        else:
            quotes = False
        if not quotes:
            end = html.find(">", m.end())
        if end < 0:
            return
        yield at, end + 1, m[1].lower(), html[at + 1] == "/", html[m.end() : end]
        at = end + 1


BASE = 0x9FB21C651E98DF25
WORD64 = (1 << 64) - 1


class Content:
    """Digest of a sequence of texts, to which sequences can be added."""

    __slots__ = ("size", "value")

    def __init__(self):
        self.size, self.value = 0, 0

    def add(self, size: int, value: int) -> None:
        self.value = (self.value * pow(BASE, size, 1 << 64) + value) & WORD64
        self.size += size

    def digest(self) -> int:
        return (self.value ^ self.size) - (1 << 63) if (self.value ^ self.size) >> 63 else self.value ^ self.size


class Page:
    """A page as blocks, and its containers with what they hold.

    blocks: (innermost container, leaf, cut by the page, in an article, cut by a branch, text). cuts: level by node of the host's tree.
    """

    def __init__(self, html: str | None, cuts: dict[int, int] | None = None):
        self.blocks: list[tuple[int, str, bool, bool, bool, str]] = []
        #: by container: what it holds, and its children's tags
        self.nodes: dict[int, Content] = {}
        self.children: dict[int, Content] = {}
        self.cuts = cuts or {}
        self._read(html or "")

    def _read(self, html: str) -> None:
        # open elements: tag, container or None, innermost container, cut, in an article, cut by a branch, what it holds
        stack: list[tuple] = []
        opened: dict[str, int] = {}
        text: list[str] = []
        root = ("", None, 0, False, False, False, Content())
        at, size = 0, len(html)

        def flush():
            if text:
                line = " ".join(H.unescape("".join(text)).split())
                text.clear()
                if line:
                    top = stack[-1] if stack else root
                    self.blocks.append((top[2], top[0] if top[1] is None else "", *top[3:6], line))
                    top[6].add(1, xxhash.xxh64_intdigest(line))

        def close(n: int):
            while len(stack) > n:
                tag, node, _, _, _, _, held = stack.pop()
                opened[tag] -= 1
                (stack[-1] if stack else root)[6].add(held.size, held.value)
                if node is not None and held.size:
                    self.nodes.setdefault(node, Content()).add(held.size, held.value)

        for start, end, tag, ends, attrs in tags(html):
            if start < at:
                continue
            if start > at:
                text.append(html[at:start])
            at = end
            if not tag:
                continue
            if ends:
                if tag in INLINE or tag in VOID:
                    continue
                flush()
                if opened.get(tag):
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    close(i)
                continue
            if tag == "br":
                text.append(" ")
            if tag in INLINE or tag == "br":
                continue
            flush()
            if tag in VOID:
                continue
            if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (tag not in RAW) and (stack[-1][0] == "p" or tag[0] == "h"):
                close(len(stack) - 1)
            closed = CLOSED_BY.get(tag, ())
            i = len(stack) - 1
            while i >= 0 and any(opened.get(c) for c in closed) and stack[i][0] not in ("ul", "ol", "dl", "table", "div", "article", "section"):
                if stack[i][0] in closed:
                    close(i)
                i -= 1
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else size
                continue
            up = stack[-1] if stack else root
            if stack and up[1] is not None:
                self.children.setdefault(up[1], Content()).add(1, xxhash.xxh64_intdigest(tag))
            if attrs.endswith("/") and tag not in LEAF and tag not in MAIN and "svg" in tag:
                continue
            names = attributes(attrs) if attrs else {}
            label = f"{names.get('class', '')} {names.get('id', '')}"
            cut = up[3] or tag in CUT or names.get("role", "").lower() in CUT_ROLES or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
            if tag == "header" and not up[4]:
                cut = True
            frame = tag in ("html", "body", "main", "article")
            weak = False
            if not cut and not frame and label != " ":
                cut = bool(CUT_NAMES.search(label))
                weak = not cut and bool(WEAK.search(label))
                cut = cut or (weak and not up[4])
            main = not cut and (up[4] or tag in MAIN)
            node, branch = None, up[5]
            if tag not in LEAF:
                node = node_key(up[2], f"{tag}.{names.get('class', '')}")
                branch = branch or (not frame and self.cuts.get(node, 9) <= (NAMED if weak else INSIDE if main else OUTSIDE))
            stack.append((tag, node, up[2] if node is None else node, cut, main, branch, Content()))
            opened[tag] = opened.get(tag, 0) + 1
        if at < size:
            text.append(html[at:])
        flush()
        close(0)

    def decided(self) -> Iterator[tuple[str, str]]:
        """(text, what cuts it: page, branch, leaf or nothing) of each block."""
        sizes = [sum(len(b[5]) for b in self.blocks if not b[2] and b[3] == main) for main in (True, False)]
        only = sizes[0] > 0 and sizes[0] >= sizes[1]
        for node, leaf, cut, main, branch, line in self.blocks:
            if cut or (only and not main):
                yield line, "page"
            elif branch:
                yield line, "branch"
            else:
                yield line, "leaf" if self.cuts and self.cuts.get(leaf_key(node, leaf, line), 9) <= (INSIDE if main else OUTSIDE) else ""

    def text(self) -> str:
        return "\n".join(line for line, by in self.decided() if by == "")

    def leaf_nodes(self) -> tuple[int, set[tuple[int, int]]]:
        """Digest of what is left by what the page says of itself, and (leaf, leaf with what it says) of its blocks."""
        left = [(b[0], b[1], b[5]) for b, (_, by) in zip(self.blocks, self.decided()) if by != "page"]
        return _digest([x[2] for x in left]), {(leaf_key(node, leaf), leaf_key(node, leaf, line)) for node, leaf, line in left}


def node_key(parent: int, key: str) -> int:
    """A container by its path: that of its parent, and its tag and class."""
    return xxhash.xxh64_intdigest(key, parent & WORD64) - (1 << 63)


def leaf_key(node: int, leaf: str, line: str = "") -> int:
    return _digest([str(node), leaf, line])


def _digest(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(parts)) - (1 << 63)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, html) -> the tree (site, node, pages, content, presentation, importance) and the site (host) of each host; for leaves, node has what they say.

    Each distinct page of a host sends a row per container and per leaf; counts of equal
    contents combine before they are summed, so a hot host is spread over tasks.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            seen: set[tuple[str, int]] = set()
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source)
                host, (whole, leaves) = host_of(url), page.leaf_nodes()
                if (host, whole) in seen:
                    continue
                seen.add((host, whole))
                none = Content()
                rows += [(host, node, whole, held.digest(), page.children.get(node, none).digest(), 0) for node, held in page.nodes.items()]
                rows += [(host, leaf, whole, None, None, said) for leaf, said in leaves]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["host", "node", "page", "content", "style", "said"])

    rows = pages.select("url", "html").mapInArrow(run, "host string, node bigint, page bigint, content bigint, style bigint, said bigint")
    every = materialize(rows.dropDuplicates(["host", "node", "page", "said"]), "style-nodes")
    # small hosts share a tree with their domain, and small domains one with all such
    hosts = every.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
    hosts = hosts.withColumn("_d", F.when(F.col("_n") >= PAGES, F.col("host")).otherwise(F.concat(F.lit("*."), F.substring_index("host", ".", -2))))
    domains = hosts.groupBy("_d").agg(F.sum("_n").alias("_m"))
    sites = materialize(hosts.join(domains, "_d").select("host", F.when(F.col("_m") >= PAGES, F.col("_d")).otherwise(F.lit("*")).alias("site")), "style-sites")
    every = every.join(sites, "host").withColumn("page", F.xxhash64("host", "page")).drop("host").withColumnRenamed("site", "host")
    rows, leaves = every.filter("said = 0"), every.filter("said != 0")

    def entropy(column: str) -> DataFrame:
        counts = rows.groupBy("host", "node", column).agg(F.count(F.lit(1)).alias("_c"))
        total = counts.groupBy("host", "node").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.log("_c")).alias("_s"))
        share = (F.log("_m") - F.col("_s") / F.col("_m")) / F.log("_m")
        return total.filter(F.col("_m") >= PAGES).select("host", "node", F.col("_m").alias("pages"), share.alias(column))

    both = entropy("content").join(entropy("style").drop("pages"), ["host", "node"])
    repeated = leaves.groupBy("host", "node", "said").agg(F.count(F.lit(1)).alias("_d")).filter("_d > 1")
    having = leaves.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= PAGES)
    share = 1 - F.log("_d") / F.log("pages")
    said = repeated.join(having, ["host", "node"]).select("host", F.col("said").alias("node"), "pages", share.alias("content"), F.lit(None).cast("double").alias("presentation"), share.alias("importance"))
    both = both.select("host", "node", "pages", "content", F.col("style").alias("presentation"), (CONTENT * F.col("content") + (1 - CONTENT) * F.col("style")).alias("importance"))
    return both.unionByName(said).withColumnRenamed("host", "site"), sites


def style_cuts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The site of each host, and written (site, _node, _level): nodes of the site to cut, and under which of LIMITS they are."""
    tree, sites = style_tree(pages)
    level = F.lit(len(LIMITS))
    for i in reversed(range(len(LIMITS))):
        level = F.when(F.col("importance") < LIMITS[i], F.lit(i)).otherwise(level)
    low = tree.withColumn("_level", level.cast("tinyint")).filter(F.col("_level") < len(LIMITS))
    cuts = low.groupBy("site").agg(F.collect_list(F.struct(F.col("node"), F.col("_level"))).alias("_c"))
    cuts = cuts.select("site", F.transform("_c", lambda c: c["node"]).alias("_node"), F.transform("_c", lambda c: c["_level"]).alias("_level"))
    return sites, materialize(cuts, "style-cuts")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    sites, cuts = style_cuts(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def hosts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], names=[*batch.schema.names, "host"])

    def run(batches):
        known: dict[str, dict[int, int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for r, (site, source) in enumerate(zip(part.column("site").to_pylist(), part.column("html").to_pylist())):
                    if site not in known:
                        # the trees of some sites are kept; pages of a site carry the same
                        if len(known) >= 64:
                            known.clear()
                        node, level = part.column("_node")[r].as_py(), part.column("_level")[r].as_py()
                        known[site] = dict(zip(node or (), level or ()))
                    out.append(Page(source, known[site]).text())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    named = pages.select("page_id", "url", "html").mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    joined = named.join(sites, "host", "left").join(cuts, "site", "left").select("page_id", "url", "html", "site", "_node", "_level")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
