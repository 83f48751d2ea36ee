"""Extraction of main texts: names, site style tree, broken markup, odd tables."""

import math
import time
from collections import Counter, defaultdict

import pytest

from tallyrank.llm import html_extract
from tallyrank.llm.dom import parse
from tallyrank.llm.html_extract import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Logo</a></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice">We use cookies</div>
<main><article><header><h1>Big &amp; small</h1></header><p>First&nbsp;line <b>bold</b>
 text<p>Second <a href="x>y">link</a><br>more</p><div class="ad-slot"><p>Buy</p></div><ul><li>one<li>two</ul>
<form><label>Mail</label><input></form><section class="comments"><p>Reader says</p></section><pre>a
  b</pre><table><tr><td>c1<td>c2</table></article></main><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Big & small\nFirst line bold text\nSecond link more\none\ntwo\na b\nc1\nc2"


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a &lt; b < c</p>", "a < b < c"), ("<p>x<!-- <p>no</p> -->y</p>", "xy"), ("<p>open <b", "open"),
        ("<script>never closed <p>x", ""), ("<div><div><p>a</p>tail</div></div>", "a\ntail"), ("<article></article><p>out</p>", ""), ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
        ("<P CLASS='Sidebar'>a</P><p class=\"shadow\">b</p>", "b"), ("</p>a</div>b", "ab"), ("<p>&#x41;&#66;&nosuch;&amp;lt;</p>", "AB&nosuch;&lt;"), ("<article><p>1</p></article><div>x</div><article><p>2</p></article>", "1\n2"),
        ("<form id='shell'><h1>t</h1><p>a</p></form>", "t\na"), ("<div class='entry-header'><h1>t</h1></div><div class='page-header'>x</div><p>a</p>", "t\na"),
        ("<header class='post-header'><h1>t</h1></header><header>x</header><p>a</p><form><p>q</p></form>", "t\na"),
        ("<body><p>a</p><textarea><p>b</p></textarea></body>", "a"), ("<p>é   z</p>", "é z"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_deep_pages():
    assert main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(parse("<p>x" * 20_000).children) == 20_000


def soup(k):
    """A page whose parts only the site's other pages tell apart."""
    return f'<body><div class="a1"><span>All the news</span></div><div class="b{k}"><p>Story {k} begins.</p><p>It ends {k * 7}.</p></div><div class="z"><p>Call us at any hour</p></div></body>'


def test_site_style_tree(spark, monkeypatch):
    pages = [(k, f"https://user@News.example:80/{k}", soup(k)) for k in range(20)]
    pages += [(100, "https://one.example/", soup(1)), (101, None, soup(2)), (102, "no url", None), (None, "https://news.example/", soup(3)), (3, "https://news.example/3", soup(3))]
    got = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    of = {(r["page_id"], r["url"]): r["text"] for r in got}
    for k in range(20):
        assert of[k, f"https://user@News.example:80/{k}"] == f"Story {k} begins.\nIt ends {k * 7}."
    assert of[100, "https://one.example/"].startswith("All the news\nStory 1") and of[102, "no url"] == ""
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    again = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_style_tree_inside_articles(spark):
    """Unnamed boilerplate of a site goes from its articles too; the article's own words stay, also around inline parts that recur."""
    page = '<body><article><h1>Title {0}</h1><p>Story {0} <b>note</b> begins.</p><p>One {0}<br>two<br>three<br>four<br>five<br>six<br>seven<br>eight<br>nine<br>ten<br>eleven</p><div class="x1"><p>Pass it on</p></div><div class="x2">By the <i>staff</i></div></article></body>'
    pages = [(k, f"https://in.example/{k}", page.format(k)) for k in range(12)]
    got = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    verse = " ".join("two three four five six seven eight nine ten eleven".split())
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Title {k}\nStory {k} note begins.\nOne {k} {verse}" for k in range(12)}
    said = [(k, f"https://same.example/{k}", f"<article id='a'><p>Always this</p></article><i>{k}</i>") for k in range(12)]
    got = html_extract.extract_text(spark.createDataFrame(said, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Always this"}


def naive_site(pages):
    """Main texts by a style tree that is held as a whole: paths as tuples, every node's contents in one table, recursion."""
    trees = {html: parse(html) for html in pages}
    holds, contents = defaultdict(set), defaultdict(lambda: defaultdict(set))

    def own(e):
        return " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())

    def kids(e):
        return [c for c in e.children if not isinstance(c, str)]

    def walk(e, path, html):
        holds[path].add(html)
        if own(e) or not kids(e):
            contents[path, "says"][own(e) or ("link", e.attrs.get("src", ""), e.attrs.get("href", ""))].add(html)
        if kids(e):
            contents[path, "shows"][tuple(k.label for k in kids(e))].add(html)
        for k in kids(e):
            walk(k, (*path, k.label), html)

    for html, tree in trees.items():
        walk(tree, (), html)

    def importance(path):
        m, values = len(holds[path]), []
        if m < html_extract.MIN_PAGES:
            return 1.0
        says, shows = [Counter({c: len(p) for c, p in contents[path, kind].items()}) for kind in ("says", "shows")]
        if says:
            values.append(1 - sum(math.log(c) / math.log(m) for c in says.values()) / len(says))
        if shows:
            n = shows.total()
            values.append(-sum(c / n * math.log(c / n) for c in shows.values()) / math.log(m))
        return max(values) if max(values) < html_extract.LOW_IMPORTANCE else 1.0

    def judged(e, path, inside, marks):
        """(importance, whether all is noise) of an element; marks the noise."""
        mine = 1.0 if html_extract.is_article(e) else importance(path)
        below = [judged(k, (*path, k.label), own(e) != "", marks) for k in kids(e)]
        parts = [v for v, _ in below] + [mine] * bool(below and own(e))
        value = (1 - html_extract.GAMMA) * mine + html_extract.GAMMA * sum(parts) / len(parts) if parts else mine
        quiet = all(q for _, q in below) and value < html_extract.LOW_IMPORTANCE and (mine < html_extract.LOW_IMPORTANCE or not own(e))
        if quiet and (e.tag in html_extract.BLOCK or not path or not inside):
            marks.add(id(e))
        return value, quiet

    out = {}
    for html, tree in trees.items():
        marks = set()
        judged(tree, (), False, marks)
        out[html] = marks and [t for t in texts(tree, marks)] or [t for t in texts(tree, set())]
    return out


def texts(e, marks):
    """Texts of the blocks below an element without names: the test's pages have none."""
    line = []
    for c in e.children:
        if isinstance(c, str):
            line.append(c)
        elif id(c) in marks:
            line.append(" ")
        elif c.tag in html_extract.BLOCK:
            if "".join(line).split():
                yield " ".join("".join(line).split())
            line = []
            yield from texts(c, marks)
        else:
            line.append(" ".join(texts(c, marks)))
    if "".join(line).split():
        yield " ".join("".join(line).split())


def test_the_tree_agrees_with_one_held_as_a_whole(spark):
    """A site whose articles hold boilerplate without any telling name; the tree decides, as the naive one does."""
    pages = {}
    for k in range(24):
        share = '<div class="q2"><p>Pass this on to a friend</p></div>' if k % 3 else '<div class="q2"><p>Pass this on to all friends</p></div>'
        extra = f"<ul><li>Point {k}</li><li>Always a point</li></ul>" if k % 2 else f"<blockquote><p>Quote {k}</p><p>Said before</p></blockquote>"
        pages[k] = f'<html><body><div class="t"><i>Daily</i></div><article><h1>Head {k}</h1><p>Body {k} of it</p>{extra}{share}<section class="z"><p>Written by the desk</p></section></article><div class="e">All rights</div></body></html>'
    frame = spark.createDataFrame([(k, f"https://tree.example/{k}", h) for k, h in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(frame).collect()}
    naive = naive_site(list(pages.values()))
    for k, html in pages.items():
        article = naive[html]  # what is outside the article is noise by the tree as well
        assert got[k] == "\n".join(article)
        assert "desk" in main_text(html) and "Pass this" in main_text(html)  # without the tree they stay
        assert "desk" not in got[k] and "Pass this" not in got[k] and f"Body {k} of it" in got[k]


def test_hostile_pages_take_linear_time():
    for html in ("<div>" * 50_000 + "x", "<p>a" + "</div>" * 50_000, "<i>" * 25_000 + "</b>" * 25_000, "<p>" + "<i>" * 25_000 + "<p>x" * 25_000, "<form>" * 50_000 + "x"):
        began = time.process_time()
        root = parse(html)
        html_extract.style_nodes(root)
        html_extract.noisy_elements(root, {1: 0.1})
        main_text(html, {1: 0.1})
        assert time.process_time() - began < 6


def test_names_inside_articles_count_whole():
    own = '<section id="related-work"><p>a</p></section><h2 id="search-algorithms">b</h2><section id="discussion"><p>c</p></section><h2 id="navigation-systems">d</h2><div class="share-price">e</div><p class="side-effects">f</p><div id="skip-list">g</div><p class="shareholders">h</p>'
    noise = '<div class="post-share">x</div><div class="related_posts">x</div><div id="comments">x</div><p class="lead hidden">x</p><div class="sidebar">x</div><div class="social-share-buttons">x</div>'
    assert main_text(f"<article>{own}{noise}</article>") == "\n".join("abcdefgh")


def test_rare_templates_of_a_large_host(spark):
    """A section's template on a twentieth of the host's pages is judged as on a host of its own."""
    pages = [(k, f"https://big.example/{k}", soup(k)) for k in range(10)]
    alone = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    pages += [(k, f"https://big.example/{k}", f"<body><section><p>Other {k}</p></section></body>") for k in range(10, 210)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {r["page_id"]: r["text"] for r in alone} == {k: f"Story {k} begins.\nIt ends {k * 7}." for k in range(10)}
    assert got == {k: f"Story {k} begins.\nIt ends {k * 7}." if k < 10 else f"Other {k}" for k in range(210)}


def test_copies_of_one_page_lose_nothing(spark):
    pages = [(k, "https://copy.example/x", soup(1)) for k in range(30)]
    got = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"].split("\n")[1] for r in got} == {"Story 1 begins."}


def test_empty_table(spark):
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
