"""Main text of web pages by a site style tree.

The trees of all pages of one host are merged: a style node is the path of
labels (tag, classes, id) from the root.  For each style node the tree keeps how
its pages present it (the sequence of its children) and what they say in it.
A leaf that says the same on many pages has low content importance,
1 - mean(log c / log m) over its distinct contents, c of m pages each; an inner
node's importance joins the entropy of its presentations with its children's
importance.  Branches of low importance are removed from each page, and so are
branches whose tag, role or class names a menu, header, footer, sidebar,
notice, advert, form or comment list.  An article or main element, where there
is one, bounds the text; the tree judges what is inside it too.

The tree is never held as a whole: tasks emit counted (host, node, content)
keys that are summed with partial aggregation, copies of a page count once, and
only nodes of low importance come back.  A node is judged by the pages that hold
it, whatever else its host has, if these are MIN_PAGES or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .arrowtext import slices
from .common import BROADCAST_BYTES, bound_batches, cut
from .dom import BLOCK, RAW, Element, parse

#: A style node on fewer different pages of its host is judged by names alone.
MIN_PAGES = 8
LOW_IMPORTANCE = 0.3
GAMMA = 0.9
SLICE_BYTES = 8 << 20

_NOISE_TAGS = frozenset("nav aside footer form script style noscript template iframe object embed svg canvas button select input textarea label dialog menu head title audio video".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words in class and id that name a part which is not the article.
_NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|sign-?up"
    r"|sidebar\w*|side|rail|menu\w*|nav\w*|breadcrumb\w*|masthead|topbar|header|site-?header|page-?header|footer\w*|foot|comment\w*|respond|repl(?:y|ies)|discussion|disqus"
    r"|social|share\w*|sharing|related|recommend\w*|widget\w*|login|search\w*|toolbar|pagination|pager|skip\w*|hidden|sr-only)(?=$|[\s_-])",
    re.I,
)


# Inside an article a name counts only whole: one of these words, in a class also beside words for the shape of a part.
_NOISE_NAME = (
    r"(?:ads?|adv|advert(?:s|isements?|ising)?|adsense|sponsor(?:s|ed)?|promo(?:s|tions?)?|banners?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletters?|subscri(?:be|ptions?)|sign-?up"
    r"|side|sidebars?|rail|menus?|nav|navigation|breadcrumbs?|topbar|footers?|foot|comments?|respond|repl(?:y|ies)|discussion|disqus"
    r"|social|shar(?:e|es|ing)|related|recommend(?:ed|ations?)|widgets?|login|search|toolbar|pagination|pager|skip|hidden|sr-only)"
)
_SHAPE = r"(?:articles?|entry|posts?|story|stories|content|page|site|slot|box|bar|block|list|items?|area|wrap(?:per)?|container|inner|buttons?|btn|links?|icons?|form|section|panel|group|thread|\d)"
_WHOLE_ID = re.compile(_NOISE_NAME, re.I)
_WHOLE_CLASS = re.compile(rf"(?:{_SHAPE}[_-]*)*{_NOISE_NAME}(?:[_-]*(?:{_NOISE_NAME}|{_SHAPE}))*", re.I)
_LONGEST_NAME = 64
#: Elements whose ids are made from headings.
_HEADED = frozenset("h1 h2 h3 h4 h5 h6 section".split())


def _named_noise(e: Element) -> bool:
    """Whether a whole class or id names a part inside an article that is not its text."""
    if any(len(c) <= _LONGEST_NAME and _WHOLE_CLASS.fullmatch(c) for c in _ARTICLE_HEAD.sub(" ", e.attrs.get("class", "")).split()):
        return True
    return e.tag not in _HEADED and _WHOLE_ID.fullmatch(e.attrs.get("id", "").strip()) is not None


#: Heads of the article itself, where they are named as such.
_ARTICLE_HEAD = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|content)[\s_-]?(?:header|head)(?=$|[\s_-])", re.I)


def _wraps_article(form: Element) -> bool:
    """Whether a form is only the shell of a page: an article, main or h1 is in it."""
    work = [form]
    while work:
        for c in work.pop().children:
            if not isinstance(c, str):
                if c.tag in ("article", "main", "h1"):
                    return True
                work.append(c)
    return False


def is_noise(e: Element, inside: bool) -> bool:
    """Whether names alone say that an element is no part of the article; ``inside`` one, header is its head and only whole names count."""
    if e.tag == "form" and _wraps_article(e):
        return False
    if e.tag in _NOISE_TAGS or (e.tag == "header" and not inside and not _ARTICLE_HEAD.search(e.attrs.get("class", ""))):
        return True
    if not e.attrs or e.tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or e.attrs.get("role", "").lower() in _NOISE_ROLES:
        return True
    style = e.attrs.get("style")
    if style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I):
        return True
    if inside:
        return _named_noise(e)
    names = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
    if names.strip():
        return _NOISE_WORDS.search(_ARTICLE_HEAD.sub(" ", names)) is not None
    return False


def is_article(e: Element) -> bool:
    return e.tag in ("article", "main") or e.attrs.get("role", "").lower() in ("main", "article") or e.attrs.get("itemprop") == "articleBody"


def _hash(s: str, above: int = 0) -> int:
    """Signed hash of a text, or of a path: its last label and the hash of what is above."""
    x = xxh64_intdigest(s.encode("utf-8", "surrogatepass"), above & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


#: Paths recur on the pages of a host.
_path_hash = lru_cache(1 << 16)(_hash)


def style_nodes(root: Element) -> set[tuple[int, int, int]]:
    """(node, kind, content) of a page: kind 0 what a node says itself, 1 how it presents its children, 2 that the page holds it."""
    out: set[tuple[int, int, int]] = set()
    work = [(root, 0)]  # a path is carried as its hash, so depth costs no memory
    while work:
        e, node = work.pop()
        own = " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())
        kids = [c for c in e.children if not isinstance(c, str)]
        out.add((node, 2, 0))
        if own:
            out.add((node, 0, _hash(own)))
        if kids:
            out.add((node, 1, _hash(" ".join(k.label for k in kids))))
        elif not own:
            out.add((node, 0, _hash("src " + e.attrs.get("src", "") + e.attrs.get("href", ""))))
        work += [(k, _path_hash(k.label, node)) for k in kids if k.tag not in RAW]
    return out


def _says(e: Element) -> bool:
    return any(isinstance(c, str) and not c.isspace() for c in e.children)


def noisy_elements(root: Element, known: dict[int, float]) -> set[int]:
    """Elements of a page, by object, that are of low composite importance with all below them.

    An element with children joins its own value with the mean of theirs and of
    its own text's; a node that the site does not call low counts 1.  Articles
    stay, and so do elements whose own text is not low, and inline parts of
    a running text that stays.
    """
    order: list[tuple[Element, int, int]] = [(root, 0, -1)]
    for at, (x, node, _) in enumerate(order):  # grows while it is read: parents come before children
        order += [(k, _path_hash(k.label, node), at) for k in x.children if not isinstance(k, str) and k.tag not in RAW]
    below = [(0.0, 0, True)] * len(order)  # sum and number of the children's importance, whether all are noisy
    noisy: set[int] = set()
    for at in range(len(order) - 1, -1, -1):
        x, node, parent = order[at]
        own = 1.0 if is_article(x) else known.get(node, 1.0)
        total, n, quiet = below[at]
        if n and _says(x):
            total, n = total + own, n + 1
        value = (1 - GAMMA) * own + GAMMA * total / n if n else own
        quiet = quiet and value < LOW_IMPORTANCE and (own < LOW_IMPORTANCE or not _says(x))
        if quiet and (x.tag in BLOCK or parent < 0 or not _says(order[parent][0])):
            noisy.add(id(x))
        if parent >= 0:
            t, k, q = below[parent]
            below[parent] = (t + value, k + 1, q and quiet)
    return noisy


def _articles(root: Element) -> list[Element]:
    """Outermost article or main elements that no noise encloses, in page order."""
    found, work = [], [root]
    while work:
        e = work.pop()
        if is_article(e):
            found.append(e)
            continue
        work += [c for c in reversed(e.children) if not isinstance(c, str) and not is_noise(c, False)]
    return found


def _blocks(e: Element, inside: bool, noisy: set[int], out: list[str], line: list[str]) -> None:
    """Text of the blocks below ``e`` in page order; iterative, so any depth will do."""

    def flush() -> None:
        words = "".join(line).split()
        line.clear()
        if words:
            out.append(" ".join(words))

    work: list = [(e, inside)]
    while work:
        item = work.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            line.append(item)
            continue
        x, within = item
        if x.tag == "br":
            line.append(" ")
            continue
        if x is not e and (is_noise(x, within) or id(x) in noisy):
            if x.tag in BLOCK:
                flush()
            else:
                line.append(" ")
            continue
        within = within or is_article(x)
        block = x.tag in BLOCK
        if block:
            flush()
            work.append(None)
        for c in reversed(x.children):
            work.append(c if isinstance(c, str) else (c, within))
    flush()


def main_text(html: str, known: dict[int, float] | None = None) -> str:
    """Main text of one page; ``known`` has the site's style nodes of low importance."""
    root = parse(html)
    tops = _articles(root)
    mains = [t for t in tops if t.tag == "main" or t.attrs.get("role", "").lower() == "main"]
    tops = mains or tops
    tops = tops or [root]
    noisy = noisy_elements(root, known) if known else set()
    out: list[str] = []
    for t in tops:
        _blocks(t, is_article(t), noisy, out, [])
    if not out and noisy:  # a page that says only what its site always says
        for t in tops:
            _blocks(t, is_article(t), set(), out, [])
    return "\n".join(out)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))


def low_nodes(keyed: DataFrame) -> DataFrame:
    """(host, nodes): the style nodes of low importance of each host, as an array of (node, importance)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            host, page, node, kind, content = [], [], [], [], []
            for h, digest, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for n, k, c in style_nodes(parse(html)):
                    host.append(h)
                    page.append(digest)
                    node.append(n)
                    kind.append(k)
                    content.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(node, pa.int64()), pa.array(kind, pa.int8()), pa.array(content, pa.int64())],
                names=["host", "page", "node", "kind", "content"],
            )

    named = keyed.filter("host <> ''")
    counted = named.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(count, "host string, page long, node long, kind byte, content long")
    per_content = counted.distinct().groupBy("host", "node", "kind", "content").agg(F.count("*").alias("c"))
    per_node = per_content.groupBy("host", "node", "kind").agg(
        F.avg(F.log("c")).alias("mean_log"), F.sum("c").alias("total"), F.sum(F.col("c") * F.log("c")).alias("c_log_c")
    )
    pages = F.max(F.when(F.col("kind") == 2, F.col("total"))).over(Window.partitionBy("host", "node"))
    joined = per_node.withColumn("m", pages).filter((F.col("kind") < 2) & (F.col("m") >= MIN_PAGES))
    # kind 0: contents that recur count little; kind 1: entropy of the presentations.
    value = F.when(F.col("kind") == 0, 1 - F.col("mean_log") / F.log("m")).otherwise((F.log("total") - F.col("c_log_c") / F.col("total")) / F.log("m"))
    low = joined.select("host", "node", value.alias("v")).groupBy("host", "node").agg(F.max("v").alias("v")).filter(F.col("v") < LOW_IMPORTANCE)
    return low.groupBy("host").agg(F.collect_list(F.struct("node", "v")).alias("nodes"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html gives an empty text.  A page without a host in its url
    is judged by names alone.  Repeated pages count once in the site's tree and
    each keep their row.  A page that says only what its site always says keeps
    that text.  An empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    keyed = _keyed(pages, id_col, url_col, html_col)
    low = cut(low_nodes(keyed))
    table = low.select(F.col("host").alias("__host"), F.col("nodes.node").alias("nodes"), F.col("nodes.v").alias("values"))
    size = low.agg(F.sum(F.size("nodes")).alias("n")).first()["n"] or 0
    if size * 64 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    joined = keyed.join(table, keyed["host"] == F.col("__host"), "left").select("page_id", "url", "html", "host", "nodes", "values")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, float]] = {}
        for batch in slices(batches, "html", SLICE_BYTES):
            texts = []
            nodes, values = batch.column(4), batch.column(5)
            for k, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = dict(zip(nodes[k].as_py() or (), values[k].as_py() or ()))
                texts.append(main_text(html, known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)[id_col]
    return joined.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
