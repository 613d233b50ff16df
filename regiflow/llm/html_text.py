"""Main text of web pages from streaming parser events.

The standard library's parser turns a page into lines, one per block element.
A line's text-to-tag ratio is its text length per tag; the ratios are smoothed
with a Gaussian kernel along the page and split by a threshold into two
clusters.  The regions (article, or else the enclosing container) that hold
lines of the upper cluster are the content, and with them all articles, or the
container around the parts of one text (sections, quotes, a div per
paragraph); every block of these is kept, so short paragraphs stay.  Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are told
by their element, role or class and are never content.

One pass per page, no shuffle; memory is one Arrow batch of pages.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg iframe object audio video canvas title annotation".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea dialog menu fieldset label option datalist".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike
    strong sub sup time tt u var img br wbr ruby rt rp nobr
    math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup munder mover munderover mfenced mstyle
    mpadded mphantom menclose mtable mtr mtd annotation""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
    menu breadcrumb breadcrumbs sidebar aside footer comment comments commentlist disqus cookie cookies consent notice notices alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets
    pagination toolbar""".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
#: What a class or id may hold beside words of the list and still name boilerplate (top-menu, cookie-bar, post-comments).
QUALIFIERS = frozenset("""top bottom left right upper lower main primary secondary global site page mobile desktop sticky fixed
    floating inner outer bar box block list items item links link button buttons icons icon wrapper wrap container inline area
    section panel column col row slot unit zone form text message region law info policy eu gdpr""".split())
PARTS_OF = frozenset("post posts entry article articles story stories user reader media google thread reply author".split())
#: Elements whose id may name boilerplate; ids of others, headings above all, are targets of links.
NAMED_BY_ID = frozenset("div section ul ol table".split())
#: What an open element ends when it starts again beside itself, and where the search stops.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
            "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
#: Elements whose content is text, where it ends at all.
RAW = frozenset("textarea title iframe noembed noframes xmp".split())
_COMMENT = re.compile(r"<!--(?:-?>|.*?--(?:!|\s*)>)", re.S)
_OPEN_TAG = re.compile(r"<[A-Za-z/!?]")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SIZE = re.compile(r"\d+x\d+")


def _names(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id as a whole is one of ``words`` or a compound of
    them and qualifiers; has-sidebar, no-comments or related-work are not."""
    if token.lower() in words:
        return True
    parts = [w.lower() for w in _TOKEN.findall(_SIZE.sub(" ", token))]
    if not WORDS.isdisjoint(parts):
        return all(w in words or w in QUALIFIERS or w in PARTS_OF for w in parts)
    return not words.isdisjoint(parts) and all(w in words or w in QUALIFIERS for w in parts)     # not the header of an article


# How far a block is from content.
CONTENT, WRAPPED, NAMED, MARKED = range(4)     # an article in a NAMED wrapper is WRAPPED; MARKED by its element or role


class PageLines(HTMLParser):
    """Collects (text, tags, region, path of regions, level, in article) per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], int, bool]] = []
        self.stack: list[tuple[str, bool, int, tuple[int, ...], bool]] = []   # name, hidden, level, regions, in article
        self.text: list[str] = []
        self.tags = 0
        self.unended: set[str] = set()
        self.regions: list[tuple[int, str, str]] = [(-1, "", "")]      # around it, element, name, by number; 0 is the page
        self.hidden = self.in_article = False
        self.level = CONTENT
        self.path: tuple[int, ...] = (0,)

    def _restore(self) -> None:
        _, self.hidden, self.level, self.path, self.in_article = \
            self.stack[-1] if self.stack else ("", False, CONTENT, (0,), False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append((text, self.tags, self.path[-1], self.path, self.level, self.in_article))
            self.tags = 0

    def _open_sibling(self, tag: str) -> None:
        """End an open p before a block, and an open li, td ... before the next."""
        stops = SIBLINGS.get(tag)
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" and stops is None or stops and (name == tag or {name, tag} == {"dt", "dd"} or {name, tag} == {"td", "th"}):
                if tag not in ("td", "th"):
                    self.flush()
                del self.stack[i:]
                return self._restore()
            if stops is None and name not in INLINE or stops and name in stops:
                return None
        return None

    def _level(self, tag: str, attrs) -> int:
        """The level of an element in its place."""
        level = self.level
        if tag == "main" and level == NAMED:
            level = CONTENT
        elif tag == "article" and level == NAMED:
            level = WRAPPED
        if tag == "form":                   # some sites wrap the whole page in one
            level = max(level, NAMED)
        elif tag in BOILERPLATE or tag == "header" and not self.in_article:
            return MARKED
        words = WORDS if self.in_article else WORDS | HEADER_WORDS
        for key, value in attrs:
            if not value:
                continue
            if key == "role" and value.strip().lower() in ROLES:
                return MARKED
            if tag in ("body", "html", "main") or tag == "article" and not self.in_article:
                continue                    # an article in an article may be a reader's comment
            # In an article the id of a section is the slug of its heading.
            by_id = key == "id" and tag in NAMED_BY_ID and not (tag == "section" and self.in_article)
            if (key == "class" or by_id) and any(_names(token, words) for token in value.split()):
                level = max(level, NAMED)
        return level

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self.text.append(" " if tag == "br" else "")
                return
        else:
            self._open_sibling(tag)
            if tag in ("td", "th"):
                self.text.append(" ")       # cells of a row make one line
            else:
                self.flush()
        if tag in VOID:
            return
        path = self.path
        if tag in CONTAINERS and not self.in_article:
            named = {k: v for k, v in attrs if k in ("class", "id") and v}
            self.regions.append((path[-1], tag, named.get("class") or named.get("id") or ""))
            path = (*path, len(self.regions) - 1)
        level = self._level(tag, attrs)
        if level != self.level:
            self.flush()
        self.stack.append((tag, self.hidden or tag in HIDDEN, level, path, self.in_article or tag in ("article", "main")))
        self._restore()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                around = self.stack[i - 1][2] if i else CONTENT
                if tag not in INLINE and tag not in ("td", "th") or around != self.level:
                    self.flush()
                del self.stack[i:]
                self._restore()
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return                      # a stray inline end tag ends nothing around it

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        tag = self.lasttag
        if end > 0 and tag in RAW and tag not in self.unended and self.rawdata[i + 1:i + 1 + len(tag)].lower() == tag:
            self.set_cdata_mode(tag)
            if not self.interesting.search(self.rawdata, end):
                self.clear_cdata_mode()
                self.unended.add(tag)
        return end

    def parse_comment(self, i, report=1):
        closed = _COMMENT.match(self.rawdata, i)        # an unclosed one goes to the end of the page
        return closed.end() if closed else len(self.rawdata)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:              # an unknown <![...: a comment to browsers
            return self.parse_bogus_comment(i)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; near the ends the kernel is renormalised."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    near = lambda x: np.convolve(x, kernel)[radius:radius + len(x)]
    return near(ratios) / near(np.ones(len(ratios)))


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """Two-means split of the values: the middle between the cluster means."""
    low, high = values.min(), values.max()
    cut = (low + high) / 2
    for _ in range(rounds):
        upper = values >= cut
        if upper.all() or not upper.any():
            break
        after = (values[upper].mean() + values[~upper].mean()) / 2
        if after == cut:
            break
        cut = after
    return float(cut)


def _finished(html: str) -> str:
    """The page without a tag that it breaks off in."""
    cut = _OPEN_TAG.search(html, html.rfind(">") + 1)
    return html[:cut.start()] if cut else html


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by two newlines; empty if none."""
    page = PageLines()
    page.feed(_finished(html or ""))
    page.close()
    page.flush()
    lines = page.lines
    # Articles in a wrapper named like boilerplate count where no other article has text.
    free = any(line[4] == CONTENT and line[5] for line in lines)
    own = [i for i, line in enumerate(lines) if line[4] == CONTENT or line[4] == WRAPPED and not free]
    if not own:
        return ""
    score = smoothed(np.array([len(t) / max(1, n) for t, n, *_ in lines]))
    cut = threshold(score)
    upper = [i for i in own if score[i] >= cut] or [max(own, key=lambda i: score[i])]
    content = {lines[i][2] for i in upper}
    # A block also belongs to a content region around its own; the page and its body are around everything.
    around = {r for r in content if page.regions[r][1] not in ("", "body")} | _lifted(lines, own, upper, page.regions)
    return "\n\n".join(lines[i][0] for i in own if lines[i][2] in content or around.intersection(lines[i][3]))


def _lifted(lines: list, own: list[int], upper: list[int], regions: list[tuple[int, str, str]]) -> set[int]:
    """The regions whose blocks are all content: the articles if most of the
    upper cluster's text is in them, else the smallest container with most of
    it, or, where that is only a part of a text (a section, a quote, a div
    around one block, unnamed, or of the same class as one beside it), the
    one around its parts."""
    weight: Counter = Counter()
    for i in upper:
        for r in lines[i][3]:
            weight[r] += len(lines[i][0])
    whole = weight[0]
    articles = {r for r, (_, tag, _) in enumerate(regions) if tag in ("article", "main")}
    if 2 * sum(weight[r] for r in articles) > whole:
        return articles
    region = max(r for r, n in weight.items() if 2 * n > whole)         # these are nested; inner ones have higher numbers
    blocks = Counter(lines[i][2] for i in own)
    beside = Counter(regions)
    inside = Counter(r[0] for r in regions)
    while region > 0:
        outer, tag, name = regions[region]
        part = tag in ("section", "blockquote") or tag == "div" and (
            not name or blocks[region] == 1 and not inside[region] or beside[regions[region]] > 1)
        if not part:
            break
        region = outer
    return {region}


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Defined results: null or empty html, and a page without a visible block
    outside boilerplate, give the empty text; broken markup is read as far as
    it goes; repeated rows stay repeated; null ids and urls stay null; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
