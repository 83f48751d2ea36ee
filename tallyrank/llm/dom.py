"""A small tolerant HTML tree: elements, text, implied end tags, raw-text elements."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend optgroup option summary dd dt li".split()) | frozenset("dd dt li".split())
#: A start tag closes an open element of these kinds, unless one of the others lies between.
_CLOSES = {
    "li": (("li",), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (("dt", "dd"), frozenset({"dl"})),
    "dd": (("dt", "dd"), frozenset({"dl"})),
    "tr": (("tr", "td", "th"), frozenset({"table"})),
    "td": (("td", "th"), frozenset({"tr", "table"})),
    "th": (("td", "th"), frozenset({"tr", "table"})),
    "tbody": (("tbody", "thead", "tfoot"), frozenset({"table"})),
    "thead": (("tbody", "thead", "tfoot"), frozenset({"table"})),
    "tfoot": (("tbody", "thead", "tfoot"), frozenset({"table"})),
    "option": (("option",), frozenset({"select", "datalist"})),
    "body": (("head",), frozenset()),
}
_P_SCOPE = frozenset("table td th caption button object template html body article section div main aside nav header footer li dd blockquote form fieldset".split())
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Element | str] = []

    @property
    def label(self) -> str:
        """Tag with its classes and id, digits left out: what makes nodes of several pages one style node."""
        marks = sorted(self.attrs.get("class", "").split())
        if "id" in self.attrs:
            marks.append("#" + self.attrs["id"])
        return ".".join([self.tag, *(_DIGITS.sub("", m) for m in marks)]) if marks else self.tag


class _Open:
    """The open elements, with the places of each tag among them, so that no end tag has to search."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 where there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for e in self.stack[place:]:
            self.places[e.tag].pop()
        del self.stack[place:]

    def close(self, tags: tuple[str, ...], until: frozenset) -> None:
        """Close the innermost element of ``tags``, unless one of ``until`` lies inside it."""
        place = max(map(self.last, tags))
        if place and (place == len(self.stack) - 1 or place >= max(map(self.last, until), default=0)):
            self.cut(place)


def parse(html: str) -> Element:
    """Tree of a page, in time linear in its length. Text is unescaped; comments, declarations and broken tails are dropped.

    A form inside a form is none, as browsers have it.
    """
    root = Element("", {})
    open_ = _Open(root)
    stack = open_.stack
    at, n = 0, len(html)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if m is None:  # a lone <
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        end, tag, raw = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if end:
            end = end.lower()
            place = open_.last(end)
            if place:
                open_.cut(place)
            elif end == "p" or end == "br":
                stack[-1].children.append(Element(end, {}))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "form" and open_.places.get("form"):
            continue
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}
        if tag in _CLOSES_P:
            open_.close(("p",), _P_SCOPE)
        if tag in _CLOSES:
            open_.close(*_CLOSES[tag])
        element = Element(tag, attrs)
        stack[-1].children.append(element)
        if tag in VOID or raw and raw.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            body = html[at : stop.start()] if stop else html[at:]
            if tag in ("textarea", "title"):
                body = unescape(body)
            element.children.append(body)
            at = stop.end() if stop else n
            continue
        open_.push(element)
    return root
