"""HTML main text by tag-path ratios.

A page is cut into blocks of text, each under the root-to-leaf path of its tags and class names. What the standard
names as beside the text (nav, header, footer, aside, form, script ...) takes no part. Text length and punctuation
are added up for each path and for the path of each block's container; the ratio of a path is its text and
punctuation for each block. Ratios are smoothed among neighbours in a container, a path's own and its container's
are fused, and paths that reach a share of the page's highest are content. Names like `ad` or `comments` only mark a
part: each mark scales the ratios below it down, so a marked part loses beside an article, while a page whose whole
text stands under a marked name keeps it. What shares a container with content, or lies below one, goes with it
(a heading, a cell), unless it is marked or consists of links.

Defined results: a null or empty page, and one without content, has the empty text. Unclosed and stray tags,
comments and references are read as browsers do; work grows in proportion to the page, at any depth. Repeated rows
and null ids keep a row each. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text nodes under these take no part.
DROPPED = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "script", "style", "noscript", "template", "iframe", "object",
    "svg", "button", "select", "option", "textarea", "input", "title",
}
#: A part whose class, id or role has one of these words is marked.
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "notification", "alert", "sidebar", "sidenav", "menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs",
    "masthead", "header", "footer", "topbar", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "share", "sharing",
    "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "toolbar", "pagination", "pager",
    "complementary", "contentinfo", "search", "copyright",
}
#: These mark a part whatever else it is named, and whatever it holds; marks by the others end around an article.
STRICT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "sidebar", "sidenav",
    "footer", "contentinfo", "comment", "comments", "commentlist", "respond", "disqus", "newsletter", "subscribe",
}
#: These don't count on a part with one of OWN_WORDS, the others only not where one of OWN_WORDS is a name of its own.
AMBIGUOUS_WORDS = {"header", "masthead", "notice", "notices"}
OWN_WORDS = {"article", "post", "entry", "story", "content"}
BLOCKS = {
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead",
    "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "header", "footer", "nav", "aside",
    "form", "fieldset", "details", "summary", "center", "menu", "dialog", "hgroup", "search",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag closes an open one of these, within the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
#: Share of the page's highest ratio from which a path is content, neighbours on each side that smooth one.
THRESHOLD, SIDES = 0.1, 1
#: What a mark leaves of a ratio: below a strict one hardly anything stands beside other text.
LEFT = {"weak": 0.02, "strict": 1e-6}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: A quote means something only behind an equals sign.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Such names tell what is beside a part, not what it is.
_STATE = re.compile(r"(?:has|with|no|without)[-_]")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
#: Elements that hold a page: what lies below them doesn't go with their own content.
_PAGE = {"html", "body"}
_MAIN = {"article", "main"}
#: These keep a block within them from closing the paragraph around them.
_BARS = {"td", "th", "button", "caption"}


def _names(attributes: str) -> set[str]:
    return {x for v in _NAMES.findall(attributes) for x in v.lower().strip("\"'").split()} if attributes else set()


def _mark(tag: str, names: set[str]) -> str:
    """Empty, or how a part is marked by its names: strict or weak."""
    if not names or tag in _MAIN or tag in _PAGE:
        return ""
    names = {x for x in names if not _STATE.match(x)}
    words = {w for x in names for w in _WORD.findall(x)}
    if words & STRICT_WORDS:
        return "strict"
    found = words & DROPPED_WORDS
    return "weak" if found and not (names & OWN_WORDS or (found <= AMBIGUOUS_WORDS and words & OWN_WORDS)) else ""


class Page:
    """The blocks of a page. Paths and marks are numbered, a parent before what is below it."""

    def __init__(self, page: str) -> None:
        #: Of each path: its parent, tag and number by (parent, tag, names).
        self.parent, self.tag, self.numbers = [-1], [""], {}
        #: Of each mark: the mark around it (0: none) and its kind, empty if it doesn't hold.
        self.around, self.kinds = [0], [""]
        #: block: [(path, container, mark, in a link, text)].
        self.blocks: dict[int, list[tuple[int, int, int, bool, str]]] = defaultdict(list)
        self._read(page)

    def _path(self, parent: int, tag: str, names: set[str]) -> int:
        key = parent, tag, " ".join(sorted(names))
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
        return found

    def _read(self, page: str) -> None:
        #: Of each open element: tag, path, container, mark, whether it takes no part.
        stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]
        many: dict[str, int] = defaultdict(int)
        paragraphs, bars, off, links, block, at, end = [], [], 0, 0, 0, 0, len(page)

        def popped(to: int) -> None:
            nonlocal off, links
            for tag, _, _, _, gone in stack[to:]:
                many[tag] -= 1
                off -= gone
                links -= tag == "a"
            del stack[to:]
            for places in (paragraphs, bars):
                while places and places[-1] >= to:
                    places.pop()

        def text(raw: str) -> None:
            if raw and not off:
                _, path, container, mark, _ = stack[-1]
                self.blocks[block].append((path, container, mark, links > 0, _html.unescape(raw)))

        while at < end:
            m = _TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            block += tag in BLOCKS
            if m[1]:
                if many[tag]:
                    popped(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag in BLOCKS and tag != "html" and paragraphs and not (bars and bars[-1] > paragraphs[-1]):
                popped(paragraphs[-1])
            these, limits = CLOSES.get(tag, ((), ()))
            if any(many[t] for t in these):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in these or stack[k][0] in limits), 0)
                if k and stack[k][0] in these:
                    popped(k)
            if tag in VOID:
                if tag == "br":
                    text(" ")
                continue
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else end
                continue
            if m[3].endswith("/") and tag in ("svg", "path", "use"):
                continue
            names = _names(m[3])
            _, parent, container, mark, _ = stack[-1]
            path = self._path(parent, tag, names)
            if tag in BLOCKS:
                container = parent
            kind = _mark(tag, names)
            if kind:
                self.around.append(mark)
                self.kinds.append(kind)
                mark = len(self.around) - 1
            elif tag in _MAIN:
                self._end_marks(mark)
            gone = tag in DROPPED or (tag == "header" and not (many["article"] or many["main"]))
            many[tag] += 1
            off += gone
            links += tag == "a"
            if tag == "p":
                paragraphs.append(len(stack))
            elif tag in _BARS:
                bars.append(len(stack))
            stack.append((tag, path, container, mark, gone))

    def _end_marks(self, mark: int) -> None:
        """Weak marks around an article don't hold."""
        while mark and self.kinds[mark]:
            if self.kinds[mark] == "weak":
                self.kinds[mark] = ""
            mark = self.around[mark]


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by line feeds."""
    read = Page(page or "")
    shown = {b: s for b, parts in read.blocks.items() if (s := " ".join("".join(t for *_, t in parts).split()))}
    if not shown:
        return ""
    #: A block stands under the path of its longest text; it is a link if over half of its text is in links.
    place = {b: max(read.blocks[b], key=lambda x: len(x[4].strip())) for b in shown}
    linked = {b: 2 * sum(len(t.strip()) for _, _, _, a, t in read.blocks[b] if a) > len(shown[b]) for b in shown}
    left = [1.0]
    for around, kind in zip(read.around[1:], read.kinds[1:], strict=True):
        left.append(left[around] * LEFT.get(kind, 1.0))
    sums: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
    for b, s in shown.items():
        marks = len(PUNCTUATION.findall(s))
        for k in (0, 1):
            x = sums[k, place[b][k]]
            x[0] += len(s)
            x[1] += marks
            x[2] += 1
    ratio = {key: (n / c) * (1 + marks / c) for key, (n, marks, c) in sums.items()}
    order = list(shown)
    smooth: dict[int, list[float]] = defaultdict(list)
    for i, b in enumerate(order):
        near = [ratio[0, place[x][0]] for x in order[max(0, i - SIDES) : i + SIDES + 1] if place[x][1] == place[b][1]]
        smooth[place[b][0]].append(sum(near) / len(near))
    fused = {b: (sum(x := smooth[place[b][0]]) / len(x) * ratio[1, place[b][1]]) ** 0.5 * left[place[b][2]] for b in order}
    least = THRESHOLD * max(fused.values())
    chosen = {b for b in order if fused[b] >= least}
    #: Of each container with content, the least that marks leave of a ratio there; what is below a container goes with it.
    held: dict[int, float] = {}
    for b in chosen:
        _, container, mark, _, _ = place[b]
        held[container] = min(held.get(container, 1.0), left[mark])
    main = [False]
    for k in range(1, len(read.parent)):
        up = read.parent[k]
        main.append(main[up] or read.tag[k] in _MAIN)
        if k not in held and up in held and up and read.tag[up] not in _PAGE:
            held[k] = held[up]
    goes = lambda b: place[b][1] in held and left[place[b][2]] >= held[place[b][1]] and (main[place[b][1]] or not linked[b])
    inside = lambda b: place[b][1] and read.tag[place[b][1]] not in _PAGE
    return "\n".join(shown[b] for b in order if b in chosen or (inside(b) and goes(b)))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""

    @F.pandas_udf("string")
    def text_of(pages):
        return pages.map(main_text, na_action=None)

    p = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    return p.select(id_col, url_col, text_of("_html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
