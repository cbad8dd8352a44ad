"""Main text of web pages by tree scoring.

A page becomes a tree (lenient: unclosed and stray tags are mended, raw text of scripts and
the like is skipped). Each paragraph gives points for its length and commas to its
ancestors: all to the nearest container, half to the next, then a third, a quarter. A
container's points are discounted by the share of its text in links. The best container is
kept, with the siblings that score like it, its plain paragraphs and headings; and, further
up, the containers beside its ancestors that score like it.

Menus, page headers, footers, sidebars, forms, notices, adverts and reader comments are
marked by element, role, and whole names in class or id. What is marked is left out, unless
it is a block that holds most of the page's prose: then the mark is taken to be wrong, and it
is scored like the rest (reader comments only where there is no other prose).
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, clean_name, kept_columns, sliced, tidy

# HTML's elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl article section div body html td th li".split())
# What is not main text, by element, role, and names in a class or id; and parts of names that say nothing.
_NEVER = frozenset("nav footer aside form head button select dialog menu svg canvas object audio video fieldset label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
_STRONG = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr menu menubar nav navbar navigation newsletter pager pagination promo promoted sidebar sidenav sponsor sponsored subscribe subscription topbar".split()
)
_WEAK = frozenset("banner disclaimer masthead modal notice notices notification overlay popup promotion recommended related share sharing skip social toolbar widget".split())
_PLAIN_PARTS = frozenset("area articles bar block bottom box button buttons container content fixed form global group header holder inner item items left legal line link links list main media message more outer page panel post posts primary right secondary section site slot sticky stories top unit widgets wrap wrapper".split())
#: Elements that hold a paragraph's text: a weak name says nothing about them.
_PHRASES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption span a b i em strong small u cite q code time mark".split())
_CONTAINERS = frozenset("div section article main body center".split())
#: Points of these elements count so many times.
_HINTS = {"article": 1.5, "main": 1.25}
#: Marked prose is taken back only from so many points on.
_PROSE = 10.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"=?[^\s/>=]*")
_SETS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(tag: str, value: str) -> int:
    """2 if a class or id is a name of reader comments, 1 if of something else that is not main text. A name counts as a whole: all its parts must be known."""
    found = 0
    for name in value.split():
        parts = {x for x in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if x}
        if not parts <= _COMMENTS | _STRONG | _WEAK | _PLAIN_PARTS:
            continue
        if parts & _COMMENTS:
            found = 2
        elif parts & _STRONG or (parts & _WEAK and tag not in _PHRASES):
            found = max(found, 1)
    return found


def _mark(tag: str, attrs: list[tuple[str, str]], in_article: bool) -> int:
    """0 for what may be main text, 1 by name, 2 reader comments, 3 by element, role or being hidden."""
    if tag in ("body", "html", "article", "main"):
        return 0
    found = 3 * (tag in _NEVER and tag != "form") or int(tag == "form")
    if tag == "header" and not in_article:
        found = 3
    for name, value in attrs:
        if name in ("class", "id"):
            found = found or _named(tag, value)
        elif name == "role":
            found = 3 if value.lower() in _ROLES else found
        elif name == "style":
            said = value.replace(" ", "").lower()
            found = 3 if "display:none" in said or "visibility:hidden" in said else found
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found = 3
    return found


class _Page:
    """Nodes by number, parents before children: parent, tag, mark, the block element that owns the node's text; and text blocks in page order. One pass, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.parent, self.tag, self.mark, self.owner, self.link, self.art = [-1], ["#root"], [0], [0], [False], [False]
        self.blocks: list[tuple[int, int, str, int]] = []  # node, owner, text, characters in links
        self.gone = [False]  # within a marked element that is no block
        self.open: dict[str, int] = {}
        self.none_left: set[str] = set()
        self.stack = [0]
        self.held: list[str] = []
        self.node = self.linked = 0
        self._read()
        self._flush()

    def _flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((self.node, self.owner[self.node], text, min(self.linked, len(text))))
            self.held, self.linked = [], 0

    def _say(self, text: str) -> None:
        node = self.stack[-1]
        if self.gone[node]:
            return
        if "&" in text:
            text = _html.unescape(text)
        if not self.held:
            self.node = node
        self.held.append(text)
        if self.link[node]:
            self.linked += len(text.strip())

    def _read(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self._say(page[at:])
                return
            if lt > at:
                self._say(page[at:lt])
            c = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                if end < 0:
                    return
                at = end + 3
            elif c and c in "!?":
                end = page.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            elif m := _NAME.match(page, lt + 2 if c == "/" else lt + 1):
                tag, (attrs, at, bare) = m[0].lower(), self._attributes(m.end())
                if at < 0:
                    return
                if tag in _BLOCK:
                    self._flush()
                if c == "/":
                    self._closed(tag)
                elif tag in _RAW:
                    m = _END[tag].search(page, at)
                    at = page.find(">", m.end()) + 1 if m else 0
                    if not at:
                        return
                elif tag not in _VOID:
                    self._opened(tag, attrs, bare)
            else:
                self._say("<")
                at = lt + 1

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Names and values from `at` on, where the tag ends (-1: nowhere), and whether it ends itself."""
        page, out = self.page, []
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= len(page):
                return out, -1, False
            if page[at] == ">":
                return out, at + 1, gap[0].endswith("/")
            m = _ATTR.match(page, at)
            name, at = m[0].lower(), m.end()
            sets, value = _SETS.match(page, at), ""
            if sets:
                at = sets.end()
                q = page[at : at + 1]
                end = page.find(q, at + 1) if q and q in "\"'" and q not in self.none_left else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if q and q in "\"'":
                        self.none_left.add(q)
                    m = _BARE.match(page, at)
                    value, at = m[0].strip("\"'"), m.end()
            out.append((name, value))

    def _opened(self, tag: str, attrs: list[tuple[str, str]], bare: bool) -> None:
        if tag in _CLOSES_P:
            self._close({"p"})
        if tag in _SIBLING:
            self._close(_SIBLING[tag])
        up, k = self.stack[-1], len(self.tag)
        self.parent.append(up)
        self.tag.append(tag)
        self.art.append(self.art[up] or tag in ("article", "main"))
        self.mark.append(_mark(tag, attrs, self.art[up]))
        self.gone.append(self.gone[up] or (self.mark[k] > 0 and tag not in _BLOCK))
        self.owner.append(k if tag in _BLOCK else self.owner[up])
        self.link.append(self.link[up] or tag == "a")
        if not bare or tag in _BLOCK:
            self.stack.append(k)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _closed(self, tag: str) -> None:
        if self.open.get(tag):
            d = len(self.stack) - 1
            while self.tag[self.stack[d]] != tag:
                d -= 1
            self._cut(d)

    def _cut(self, d: int) -> None:
        for node in self.stack[d:]:
            self.open[self.tag[node]] -= 1
        del self.stack[d:]

    def _close(self, tags: set[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for d in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[d]]
            if t in tags:
                self._cut(d)
                return
            if t in _SCOPE:
                return


def gain(text: str, linked: int) -> float:
    """A paragraph's points: for being one, its commas, and its length up to 300 characters; less the share in links."""
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def _left_out(p: _Page) -> list[bool]:
    """Whether each node is within something marked; marks on most of the page's prose are taken back."""
    n = len(p.tag)
    clean, remarks = [0.0] * n, [m == 2 for m in p.mark]  # prose under each node, but for what lies in other marked ones
    for i in range(1, n):
        remarks[i] = remarks[i] or remarks[p.parent[i]]
    for node, _, text, linked in p.blocks:
        clean[node] += gain(text, linked)
    for i in range(n - 1, 0, -1):
        if not p.mark[i]:
            clean[p.parent[i]] += clean[i]
    rest, taken_back = clean[0], set()
    # forms and names mislead more often than elements, roles and being hidden
    marked = [i for i in range(1, n) if p.mark[i] and clean[i] >= _PROSE and ((not remarks[i] and clean[i] > rest and (p.mark[i] == 1 or rest < 2)) or rest == 0)]
    if marked:
        i = max(marked, key=lambda i: (not remarks[i], clean[i], -i))
        while i > 0:
            taken_back.add(i)
            i = p.parent[i]
    out = [False] * n
    for i in range(1, n):
        out[i] = out[p.parent[i]] or (p.mark[i] > 0 and i not in taken_back)
    return out


def scored(p: _Page, out: list[bool]) -> tuple[list[float], list[int], list[float]]:
    """Of each node: the points passed to it, the characters of text under it, and the share of them in links; without what is left out."""
    n = len(p.tag)
    points, length, links = [0.0] * n, [0] * n, [0] * n
    for node, owner, text, linked in p.blocks:
        if out[node]:
            continue
        length[owner] += len(text)
        links[owner] += linked
        up, share = owner if p.tag[owner] in _CONTAINERS else p.parent[owner], 1
        while up > 0 and share <= 4:
            points[up] += gain(text, 0) / share
            up, share = p.parent[up], share + 1
    for i in range(n - 1, 0, -1):
        length[p.parent[i]] += length[i]
        links[p.parent[i]] += links[i]
    return points, length, [a / b if b else 0.0 for a, b in zip(links, length, strict=True)]


def main_text(page: str | None) -> str:
    """The main text of a page, empty if none."""
    p = _Page(page or "")
    if not p.blocks:
        return ""
    n, out = len(p.tag), _left_out(p)
    points, length, density = scored(p, out)
    value = [points[i] * _HINTS.get(p.tag[i], 1.0) * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (value[i], -i))
    kept = {best}
    if best == 0 or value[best] <= 0:
        kept = {0}
    else:
        up, path = best, {}
        while up > 0:
            path[p.parent[up]] = up
            up = p.parent[up]
        for i in range(1, n):
            beside = path.get(p.parent[i])
            if beside is None or beside == i or out[i] or not length[i]:
                continue
            t, level = p.tag[i], beside == best
            like = value[i] >= max(10.0, (0.2 if level else 0.3) * value[best])
            plain = t == "p" and density[i] < 0.25 and (length[i] > 80 or (level and density[i] == 0))
            title = level and t in ("h1", "h2", "h3") and i < best and density[i] == 0
            if like or plain or title:
                kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = not out[i] and (i in kept or (i > 0 and inside[p.parent[i]]))
    return " ".join(text for node, owner, text, _ in p.blocks if inside[node])


def _extractor(n_cols: int):
    @tidy
    def run(batches):
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[n_cols]):
                texts = [main_text(h) for h in batch.column(n_cols).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:n_cols], "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", keep=("page_id", "url")) -> DataFrame:
    """pages -> the columns `keep`, text and n_chars for every row.

    A null or empty page, and one without text, has an empty text. Of containers with equal
    scores the outermost, then first, is best. Rows are independent: no shuffle, repeated rows
    each come back, an empty table gives no rows. A kept column named like an output is dropped,
    other columns are ignored. Time grows in proportion to a page's length, however its
    elements are nested.
    """
    bounded_batches(pages.sparkSession)
    keep = kept_columns(pages, keep, ("text", "n_chars"))
    html = clean_name("_html", [*keep, "text", "n_chars"])
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(html))
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])
    return rows.mapInArrow(_extractor(len(keep)), schema)
