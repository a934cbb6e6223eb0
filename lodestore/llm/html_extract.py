"""Main text of web pages, with templates of each site removed.

Pages are parsed into a tree. The subtree of every element is hashed (tag and text,
without attributes, which often differ in ids); Spark counts on how many pages of its
host each hash stands, and subtrees that recur on many are deleted, outside of articles and
inside. Inside an article of recurring subtrees those of several blocks or mostly of links that
different articles hold go: a sentence that two articles share is text. What the counts deleted of
what would else be text is reported for each page. Then, as a second step, what elements or (a parameter) their names mark as
furniture goes. Where a page marks no article, the text that is left after deletion is the main text.

Each page is given its own recurring subtrees, by a join, so that a host may have any number of them.
All steps take time in proportion to a page's length, however broken it is.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import batch_of, let_go, map_arrow, read, scratch, texts

#: A subtree is a template if it stands on so many of its host's pages, and on this share of them or on many.
MIN_PAGES = 4
MIN_SHARE = 0.2
MANY_PAGES = 100
#: Inside articles: on so many different articles, and on this share of the host's pages. No part of over half of an article's text is one.
INSIDE_SHARE = 0.5

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template nav header footer aside menu form button select option textarea input iframe object embed svg canvas audio video dialog noembed noframes title xmp".split())
CLOSES_P = BLOCK - {"html", "body"}
STOPS_P = {"table", "td", "th", "div", "section", "article", "aside", "li", "blockquote", "body"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that mark furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|side-?bar|widget|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|toolbar|share|sharing|social|related|recommend\w*|comments?|comment-?list|respond|disqus|replies|pagination|pager|search|skip-?link|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|teaser|related)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "dropped", "parent", "hash", "at", "text")

    def __init__(self, tag: str, dropped: bool, parent: Node | None):
        self.tag, self.dropped, self.parent = tag, dropped, parent
        self.kids: list[Node | str] = []
        self.hash = 0


def _furniture(tag: str, attributes: str, names: re.Pattern | None) -> bool:
    if tag in DROPPED:
        return True
    if names is None or not attributes or tag in ("html", "body", "main"):
        return False
    return any((COMMENT if tag == "article" else names).search(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes))


class _Open:
    """The open elements, with the depths of each tag, so that none is looked for one by one."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        self.stack.append(node)

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where a tag's > stands, or -1. It may stand in quotes, if all quotes are closed."""
    while quotes and (m := _MARK.search(page, at)):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1 if quotes else page.find(">", at)


def parse(page: str, names: re.Pattern | None = FURNITURE) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended the way browsers do.

    Once a quote is found that never ends, quotes count for nothing in the rest of the page.
    """
    root = Node("", False, None)
    up = _Open(root)
    at, n, quotes, last = 0, len(page), True, page.rfind(">")
    while at < n:
        node, m = up.stack[-1], TOKEN.search(page, at)
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                node.kids.append(html.escape(page[m.start() + 9 : at].removesuffix("]]>")))
            continue
        if at > last:  # no tag ends any more
            node.kids.append(page[m.start() :])
            break
        end = _tag_end(page, at, quotes)
        if end < 0:
            quotes = False
            end = page.find(">", at)
        attributes, at, tag = page[at:end], end + 1, tag.lower()
        if m[1]:
            depth = up.deepest((tag,))
            if depth:
                up.leave(depth)
            elif tag == "br":
                node.kids.append(" ")
            continue
        if tag in VOID:
            node.kids.append(Node(tag, False, node) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            _leave(up, {"p"}, STOPS_P)
        if tag in SAME:
            _leave(up, *SAME[tag])
        node = up.stack[-1]
        child = Node(tag, _furniture(tag, attributes, names), node)
        node.kids.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if not attributes.endswith("/") or tag not in ("svg", "path"):
            up.push(child)
    return root


def _leave(up: _Open, closed: set[str], stop: set[str]) -> None:
    """Out of the innermost open element of ``closed``, unless one of ``stop`` is further in."""
    depth = up.deepest(closed)
    if depth and depth > up.deepest(stop - closed):
        up.leave(depth)


def _order(root: Node) -> list[Node]:
    """Every element, parents before children, without recursion; each knows its place and whether it has text."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.at, node.text = len(out), False
        out.append(node)
        todo += [k for k in reversed(node.kids) if type(k) is not str]
    for node in reversed(out):
        node.text = node.text or any(type(k) is str and not k.isspace() and k for k in node.kids)
        if node.text and node.parent is not None:
            node.parent.text = True
    return out


def hash_subtrees(root: Node) -> list[Node]:
    """Gives each element the hash of its subtree; returns all elements."""
    nodes = _order(root)
    for node in reversed(nodes):
        h = hashlib.blake2b(node.tag.encode() + b"\0", digest_size=8)
        for k in node.kids:
            h.update(k.encode("utf-8", "surrogatepass") if type(k) is str else b"\1" + k.hash.to_bytes(8, "big"))
        node.hash = int.from_bytes(h.digest(), "big")
    return nodes


def main_node(nodes: list[Node]) -> list[Node]:
    """Articles outside of furniture, the outermost ones; else the main elements; else the whole page."""
    # Names like has-sidebar also stand on what holds everything, and an unclosed menu holds the rest of its page: if
    # all articles are inside furniture, first elements alone decide, and then nothing does.
    for wanted, by_name, by_tag in (("article", True, True), ("article", False, True), ("main", True, True), ("main", False, True), ("article", False, False)):
        found, inside = [], [False] * len(nodes)  # inside furniture or another one
        for node in nodes:
            held = node.parent is not None and inside[node.parent.at]
            if node.tag == wanted and not node.dropped and not held and node.text:
                found.append(node)
            inside[node.at] = held or node.tag == wanted or node.dropped and (by_name or by_tag and node.tag in DROPPED)
        if found:
            return found
    return nodes[:1]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def template_candidates(page: str) -> list[int]:
    """Hashes of the subtrees with text that stand outside of an article, as signed 64-bit numbers; each once."""
    return [h for h, _, article in candidates(page) if article is None]


def _parts(nodes: list[Node], main: list[Node]) -> list[bool | None]:
    """For each element whether it stands inside the main text; None for what holds it."""
    out: list[bool | None] = [False] * len(nodes)
    for m in main:
        up = m.parent
        while up is not None and out[up.at] is False:
            out[up.at] = None
            up = up.parent
        if m.parent is not None:
            for n in _subtree(m):
                out[n.at] = True
    return out


def _subtree(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if type(k) is not str]
    return out


def candidates(page: str, names: re.Pattern | None = FURNITURE) -> list[tuple[int, bool, int | None]]:
    """(hash, whether the page's text is without it if it is a template, the article it stands in), each once.

    Outside of articles these are the subtrees with text, which count for all pages of the host and change the
    text of those without an article; inside, what may be furniture.
    """
    nodes = hash_subtrees(parse(page, names))
    main = main_node(nodes)
    inside = _parts(nodes, main)
    held = {n.hash for n in nodes if inside[n.at] is False and n.tag not in ("", "html", "body") and n.text}
    free = main[0].parent is None
    out: list[tuple[int, bool, int | None]] = [(_signed(h), free, None) for h in sorted(held)]
    if not free:
        article = _signed(int.from_bytes(hashlib.blake2b(b"".join(m.hash.to_bytes(8, "big") for m in main), digest_size=8).digest(), "big"))
        out += [(_signed(h), True, article) for h in sorted(_furniture_like(main))]
    return out


def _furniture_like(main: list[Node]) -> set[int]:
    """Hashes of the parts of an article that may be furniture: several blocks, or mostly links, and not the most of the text."""
    size: dict[int, tuple[int, int, int]] = {}  # characters, those in links, blocks with text further in
    nodes = [n for m in main for n in _subtree(m)]
    for n in reversed(nodes):
        chars = links = blocks = 0
        for k in n.kids if not n.dropped else ():
            if type(k) is str:
                chars += len("".join(k.split()))
            else:
                c, a, b = size[id(k)]
                chars, links, blocks = chars + c, links + a, blocks + b + (k.tag in BLOCK and c > 0)
        size[id(n)] = chars, chars if n.tag == "a" else links, blocks
    total, tops = sum(size[id(m)][0] for m in main), set(map(id, main))
    held = set()
    for n in nodes:
        chars, links, blocks = size[id(n)]
        if chars and id(n) not in tops and n.tag in BLOCK and 2 * chars <= total and (blocks >= 2 or 2 * links > chars):
            held.add(n.hash)
    return held


def main_text(page: str, outside: frozenset[int] = frozenset(), inside: frozenset[int] = frozenset(), names: re.Pattern | None = FURNITURE) -> str:
    """Blocks of the main text joined by line ends; ``outside`` and ``inside`` are signed hashes of subtrees that go there."""
    return cut_text(page, outside, inside, names)[0]


def cut_text(page: str, outside: frozenset[int], inside: frozenset[int], names: re.Pattern | None) -> tuple[str, int]:
    """The main text, and how many subtrees the counts deleted on the page, the outermost ones."""
    root = parse(page, names)
    nodes = hash_subtrees(root) if outside or inside else _order(root)
    main = main_node(nodes)
    n_cut = 0
    if outside or inside:
        place, gone = _parts(nodes, main), [False] * len(nodes)
        for node in nodes:
            held = node.parent is not None and gone[node.parent.at]
            here = place[node.at] is not None and node.tag not in ("", "html", "body") and node.text and _signed(node.hash) in (inside if place[node.at] else outside)
            n_cut += here and not held
            gone[node.at] = held or here
            node.dropped = node.dropped or here
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            text = SPACE.sub(" ", html.unescape("".join(inline))).strip()
            inline.clear()
            if text:
                blocks.append(text)

    for top in main:
        todo: list = [top]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif type(k) is str:
                inline.append(k)
            elif k.dropped:
                inline.append(" ")
            else:
                block = k.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(k.kids)
        flush()
    return "\n".join(blocks), n_cut


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, inside_share: float = INSIDE_SHARE, furniture: re.Pattern | None = FURNITURE
) -> DataFrame:
    """(page_id, url, text, n_templates): one row for each row of ``pages``.

    A subtree outside of articles is a template if it stands on ``min_pages`` of its host's pages, and on
    ``min_share`` of them or on ``many_pages``; inside, on ``min_pages`` different articles and ``inside_share``
    as many as the host has pages. ``n_templates`` says how many subtrees of what
    would else be the page's text that deleted (where there is an article, what is outside of it is no text anyway).
    ``furniture`` finds classes, ids and roles of furniture (None: elements alone mark it).

    Pages without a host (null or odd urls) share none and lose no template. A null
    or empty page has an empty text. Repeated rows each count as a page of their
    host, so copies alone can make a template, but never of an article's text. An
    empty table gives no rows. Other columns are not looked at.
    """
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.when(host != "", host).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("html"))  # pages of one host and text have one template
    held_schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("hash", pa.int64()), ("cut", pa.bool_()), ("article", pa.int64())])

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            out += [(host, page, *x) for x in candidates(text, furniture)]
        return batch_of(held_schema, *([r[k] for r in out] for k in range(5)))

    on_host = rows.where("host IS NOT NULL")
    pairs = scratch(map_arrow(on_host.select("host", "page", "html"), held, "host string, page long, hash long, cut boolean, article long"))
    # Outside of articles pages are counted, inside different articles: copies of one do not make its text a template.
    inside = F.col("article").isNotNull().alias("inside")
    each = pairs.groupBy("host", "hash", "article").agg(F.count("*").alias("n"))
    counts = each.groupBy("host", "hash", inside).agg(F.sum(F.when(inside, 1).otherwise(F.col("n"))).alias("n"))
    sizes = on_host.groupBy("host").agg(F.count("*").alias("pages"))
    least = F.when(F.col("inside"), F.col("pages") * inside_share).otherwise(F.least(F.col("pages") * min_share, F.lit(many_pages)))
    often = counts.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") >= least).select("host", "hash", "inside")
    own = pairs.where("cut").select("host", "page", "hash", inside).join(often, ["host", "hash", "inside"])
    of = lambda where: F.sort_array(F.collect_set(F.when(where, F.col("hash"))))
    templates = scratch(own.groupBy("host", "page").agg(of(~F.col("inside")).alias("outside"), of(F.col("inside")).alias("inside")))
    let_go(pairs)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_templates", pa.int64())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [cut_text(page, frozenset(a.as_py() or ()), frozenset(b.as_py() or ()), furniture) for page, a, b in zip(texts(batch.column(2)), batch.column(3), batch.column(4))]
        return batch_of(schema, batch.column(0), batch.column(1), [t for t, _ in found], [n for _, n in found])

    joined = rows.join(templates, ["host", "page"], "left").select("page_id", "url", "html", "outside", "inside")
    return map_arrow(joined, cut, "page_id long, url string, text string, n_templates long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_templates")


QUERIES = {"op10_html_extract": op10_html_extract}
SQL: dict[str, str] = {}
