"""Main-text extraction by tree scoring (operator 5).

A page becomes a tree of elements.  Each paragraph gives points for its length
and commas to the elements above it, fewer the higher they are; an element's
points are discounted by the share of its text that lies in links.  The best
element (or the article it is in) and good siblings are kept, less the parts
that are page furniture by tag, role or name.

Edge cases: null or empty html gives an empty text; markup cut off in the
middle is read as far as it goes; a page whose text is all furniture gives an
empty text; repeated rows give repeated results; an empty table an empty one.
Only page_id, url and html are read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values of HTML and of common page templates
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math select object canvas audio video title xmp".split())
BLOCK = set("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul""".split())
PARAGRAPH = set("p pre td th li blockquote dd dt h1 h2 h3 h4 h5 h6 figcaption address".split())
LISTS = set("ul ol dl div section table menu".split())
FURNITURE_TAGS = set("nav footer aside form button fieldset dialog menu head input label".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# what is no part of an article, whatever it holds
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|"
    r"cookie|cookies|cookiebar|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|"
    r"recommended|recommendations|comment|comments|commentlist|disqus|reply|replies|respond|byline-share|outbrain|taboola)(?:$|[\s_-]|\d)", re.I)
# what page frames are named after, too
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:banner|sidebar|sidenav|nav|navbar|topnav|navigation|menu|mainmenu|breadcrumb|breadcrumbs|footer|masthead|topbar|"
    r"notice|notices|alert|widget|pager|pagination|toolbar|login|search|copyright|disclaimer|skip)(?:$|[\s_-]|\d)", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)
GOOD_NAMES = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
TAG_POINTS = {"article": 8.0, "main": 8.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0,
              "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -3.0}
# what an open element is closed by
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
P_CLOSERS = BLOCK - {"body", "html", "head", "button", "option", "optgroup", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "main", "td", "th", "button"}

# quotes hold a value only after "="; each part takes what it can and gives nothing back, so a cut tag costs one pass
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CUT_TAG = re.compile(r"<[a-zA-Z/!]")
SPACE = re.compile(r"\s+")


#: a named element is the page's frame if it holds this many other named parts and paragraphs beside them
FRAME_PARTS = 2
FRAME_PARAGRAPHS = 2


def _by_tag(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Furniture by element, role or being hidden."""
    return (tag in FURNITURE_TAGS or tag == "header" and not in_article or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in FURNITURE_ROLES)


def _apart(tag: str, attrs: dict[str, str]) -> bool:
    """Comments, adverts and the like by class or id."""
    return tag not in ("html", "body", "main") and bool(APART_NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def _by_name(tag: str, attrs: dict[str, str]) -> bool:
    """Furniture by class or id, unless it is the page's frame."""
    return tag not in ("html", "body", "main") and bool(FURNITURE_NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def _header(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """A page's header by class or id, unless it is the page's frame or all there is."""
    return not in_article and tag not in ("html", "body", "main") and bool(HEADER_NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


class _Tree:
    """Elements in page order (a child has a higher number than its parent) and pieces of text."""

    def __init__(self, page: str):
        self.tag, self.up, self.good = ["#"], [-1], [False]
        self.apart, self.by_name, self.header = [False], [False], [False]
        self.inside = [False]  # an article or main element
        self.pieces: list[tuple[int, int, str]] = []  # element, number of its block, text
        self._read(page)
        self.skip = self._skipped([a or b for a, b in zip(self.by_name, self.header)])
        if not any(not self.skip[element] and not text.isspace() for element, _, text in self.pieces):
            self.skip = self._skipped(self.by_name)  # where headers are all there is, they are the page

    def _skipped(self, by_name: list[bool]) -> list[bool]:
        """Furniture and all in it.  A name makes no furniture of what holds an article, or several other parts and paragraphs beside them."""
        n = len(self.tag)
        own, holds, parts, paragraphs = [False] * n, [False] * n, [0] * n, [0] * n
        for element, _, text in self.pieces:
            own[element] = own[element] or not text.isspace()
        for i in range(n - 1, 0, -1):
            up = self.up[i]
            if self.apart[i]:
                parts[up] += 1
                continue
            parts[up] += parts[i] or by_name[i]
            if not (by_name[i] and not self._frame(holds[i], parts[i], paragraphs[i])):
                holds[up] = holds[up] or holds[i] or self.tag[i] in ("article", "main")
                paragraphs[up] += paragraphs[i] + (own[i] and self.tag[i] in ("p", "pre", "blockquote"))
        skip = [False] * n
        for i in range(1, n):
            named = by_name[i] and not self._frame(holds[i], parts[i], paragraphs[i])
            skip[i] = skip[self.up[i]] or self.apart[i] or named
        return skip

    @staticmethod
    def _frame(holds: bool, parts: int, paragraphs: int) -> bool:
        return holds or parts >= FRAME_PARTS and paragraphs >= FRAME_PARAGRAPHS

    def _read(self, page: str) -> None:
        stack, block, at, end = [0], 0, 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if page[at: m.start() if m else end].strip():
                self._text(stack[-1], block, page[at: m.start() if m else end], last=m is None)
            if m is None:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            block += tag in BLOCK
            if m[1]:
                self._close(stack, tag)
                continue
            if tag == "br":
                self.pieces.append((stack[-1], block, " "))
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            self._make_room(stack, tag)
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTR.finditer(m[3])} if m[3].strip() else {}
            top = stack[-1]
            self.tag.append(tag)
            self.up.append(top)
            self.inside.append(self.inside[top] or tag in ("article", "main"))
            self.apart.append(_apart(tag, attrs) or _by_tag(tag, attrs, self.inside[top]))
            self.by_name.append(_by_name(tag, attrs))
            self.header.append(_header(tag, attrs, self.inside[top]))
            self.good.append(bool(GOOD_NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}")))
            stack.append(len(self.tag) - 1)

    def _text(self, element: int, block: int, text: str, last: bool) -> None:
        if last and (cut := CUT_TAG.search(text, text.rfind(">") + 1)):  # a tag that the end of the page cut off
            text = text[: cut.start()]
        self.pieces.append((element, block, htmllib.unescape(text)))

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if self.tag[stack[k]] in SCOPE and tag not in SCOPE:
                return

    def _make_room(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[k]]
            if open_tag == "p" and tag in P_CLOSERS or tag in CLOSED_BY.get(open_tag, ()):
                del stack[k:]
                return
            if open_tag in SCOPE:
                return


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by one line feed."""
    tree = _Tree(page or "")
    n, tag, up = len(tree.tag), tree.tag, tree.up
    size, linked, points = [0] * n, [0] * n, [0.0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[up[i]] or tag[i] == "a"
    blocks: list[tuple[int, str]] = []
    last = None
    for element, block, text in tree.pieces:
        if tree.skip[element]:
            last = None
            continue
        length = len(text.strip())
        size[element] += length
        linked[element] += length * in_link[element]
        if (block,) == last:
            blocks[-1] = (blocks[-1][0], blocks[-1][1] + text)
        else:
            blocks.append((element, text))
        last = (block,)
    for i in range(n - 1, 0, -1):
        size[up[i]] += size[i]
        linked[up[i]] += linked[i]
    for element, text in blocks:
        text = text.strip()
        gain = min(len(text) / 25, 1.0) + text.count(",") + min(len(text) / 100, 3.0)
        while element > 0 and tag[element] not in BLOCK:
            element = up[element]
        if tag[element] in PARAGRAPH:
            element = up[element]
        part = 1
        while element > 0 and part <= 5:
            points[element] += gain / part
            element, part = up[element], part + 1
    total = [0.0] * n
    for i in range(1, n):
        if points[i] and not tree.skip[i]:
            total[i] = (points[i] + TAG_POINTS.get(tag[i], 0.0) + 5.0 * tree.good[i]) * (1 - linked[i] / max(size[i], 1))
    best = max(range(n), key=lambda i: (total[i], -i))
    if best == 0 or total[best] <= 0:
        best = next((i for i in range(n) if tag[i] in ("article", "main") and not tree.skip[i] and size[i]), best)
    lifted = best
    while lifted > 0 and tag[lifted] not in ("article", "main"):
        lifted = up[lifted]
    chosen = {lifted or best}
    if not lifted and best:
        for i in range(1, n):
            if up[i] == up[best] and i != best and not tree.skip[i] and size[i]:
                density = linked[i] / size[i]
                if total[i] >= max(10.0, 0.2 * total[best]) or tag[i] in PARAGRAPH and tag[i] != "li" and density < 0.25:
                    chosen.add(i)
    keep, drop = [i in chosen for i in range(n)], list(tree.skip)
    for i in range(1, n):
        keep[i] = keep[i] or keep[up[i]]
        lists = tag[i] in LISTS and i not in chosen and size[i] and linked[i] > 0.5 * size[i]
        drop[i] = drop[i] or drop[up[i]] or bool(lists)
    out: list[str] = []
    last = None
    for element, block, text in tree.pieces:
        if not keep[element] or drop[element]:
            last = None
            continue
        if (block,) == last:
            out[-1] += text
        else:
            out.append(text)
        last = (block,)
    return "\n".join(filter(None, (SPACE.sub(" ", x).strip() for x in out)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
