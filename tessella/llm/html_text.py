"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks; each has a root-to-leaf path of tags and classes.  For every
path of a page the text length, link text and punctuation of its blocks are added up and
divided by their number; the fused ratios are smoothed over the blocks in page order, and
paths whose mean stays above a share of the page's are content, with all their blocks.
What a page says about itself (navigation, forms, ``class="ad"``, an article element)
goes into the fusion as a factor.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Comments, declarations, tags; each reads to the end of the page if it is never closed.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PLAIN = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# Elements as HTML defines them.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "body": ("head", "html"),
}
_CLOSES = {tag: (frozenset(closed.split()), frozenset(stop.split())) for tag, (closed, stop) in _CLOSES.items()}
_P_LIMIT = frozenset("button td th table caption html template".split())
# Elements, roles and words of class and id that aren't an article's text.
_OTHER_TAGS = frozenset("applet aside audio button canvas datalist dialog fieldset footer form head iframe menu nav noembed noframes noscript object optgroup option progress script search select style svg template textarea title video".split())
_OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
_OTHER_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adbox adsense alert advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs captcha consent cookie cookies disclaimer dropdown footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification"
    " overlay pager pagination paywall popup promo promotion recommended related search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe teaser toast toolbar topbar topnav widget widgets".split()
)
_OTHER_PARTS = re.compile(r"(?:advert|breadcrumb|cookie|newsletter|sidebar)[a-z]*|[a-z]*(?:banner|comments|menu|navbar|sidebar)")
_STATES = ("has", "no", "with", "without", "is")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: What a block in an article or main element counts more than others.
MARKED = 16.0
#: Paths whose smoothed mean stays below this share of the page's mean over its characters aren't content.
SHARE = 0.3
#: Paths of which more than this share of the characters is link text are menus.
MOST_LINKED = 2 / 3
#: Pages whose blocks are weighed at once.
PAGES = 256


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(said)))}  # of repeated ones the first


def _is_other(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element says that it holds something beside the article."""
    if tag in _OTHER_TAGS:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in _OTHER_ROLES:
        return True
    if tag in ("html", "body", "main"):  # their classes tell of the whole page
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    # sideBar as two words and as one
    words = {w.lower() for name in names if (split := _WORDS.findall(name)) and split[0].lower() not in _STATES for w in (*split, *_PLAIN.findall(name))}
    if tag == "article":
        return bool(words & _COMMENT_WORDS)
    return bool(words & _OTHER_WORDS) or any(_OTHER_PARTS.fullmatch(w) for w in words)


_OUTSIDE = ("", 0, False, False, False)


class Blocks:
    """The blocks of one page: its open elements and the text that is gathered until a block ends."""

    def __init__(self, page: str) -> None:
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, beside the article, in an article, in its header
        self.found: list[tuple[str, int, int, bool]] = []  # text, path, characters of links, in an article
        self._count: Counter[str] = Counter()  # open elements by tag
        self._paths: dict[tuple[int, str], int] = {}  # the number of a path by that of its start and its last step
        self._pieces: list[str] = []
        self._links, self._in_link = 0, 0
        self._read(page)

    def _read(self, page: str) -> None:
        at = 0
        while m := _TOKEN.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._start(tag, m["attrs"])
                    if tag in _RAW:
                        stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                        at = stop.start() if stop else len(page)  # its text is never the article's
        self._text(page[at:])
        self._end_block()

    def _text(self, raw: str) -> None:
        if not raw or self.open and self.open[-1][2]:
            return
        if self.open and self.open[-1][4] and not any(e[0] in _HEADINGS for e in self.open):
            return
        text = html.unescape(raw)
        self._pieces.append(text)
        self._links += len(text) * (self._in_link > 0)

    def _end_block(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                _tag, path, _other, marked, _header = self.open[-1] if self.open else _OUTSIDE
                self.found.append((text, path, self._links, marked))
            self._pieces, self._links = [], 0

    def _cut(self, at: int) -> None:
        """Close the elements from the place ``at`` of the open ones."""
        for tag, *_ in self.open[at:]:
            if tag not in _INLINE:
                self._end_block()
            self._in_link -= tag == "a"
            self._count[tag] -= 1
        del self.open[at:]

    def _implied(self, closed: frozenset[str], stop: frozenset[str]) -> None:
        if not any(self._count[tag] for tag in closed):
            return
        first = None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in closed:
                first = at
            elif self.open[at][0] in stop:
                break
        if first is not None:
            self._cut(first)

    def _start(self, tag: str, said: str) -> None:
        inline = tag in _INLINE
        if tag == "br":
            self._text(" ")
            return
        if not inline:
            self._end_block() if tag not in _VOID or tag == "hr" else None
            if tag not in _VOID and tag not in _RAW:
                self._implied(frozenset(("p",)), _P_LIMIT)
            if tag in _CLOSES:
                self._implied(*_CLOSES[tag])
        elif tag == "a":
            self._implied(frozenset(("a",)), _P_LIMIT)
        if tag in _VOID:
            return
        _tag, path, other, marked, header = self.open[-1] if self.open else _OUTSIDE
        attrs = _attributes(said) if said and not said.isspace() else {}
        if not inline:
            step = tag + "".join(sorted(f".{c}" for c in attrs.get("class", "").split()))
            path = self._paths.setdefault((path, step), len(self._paths) + 1)
        marked_here = marked or tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        if tag == "header":
            header, other = header or marked, other or not marked
        self._in_link += tag == "a"
        self._count[tag] += 1
        self.open.append((tag, path, other or _is_other(tag, attrs), marked_here, header))

    def _close(self, tag: str) -> None:
        if tag in ("p", "br") or tag not in _INLINE:
            self._end_block() if tag != "br" else self._text(" ")
        if not self._count[tag]:
            return None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                return self._cut(at)
            if tag in _INLINE and self.open[at][0] not in _INLINE:  # left open in a block that has ended
                return None
            if tag not in ("html", "body") and self.open[at][0] in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return None
        return None


def content(pages: np.ndarray, paths: np.ndarray, chars: np.ndarray, punctuation: np.ndarray, links: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which blocks are content, by path; blocks lie page by page in their order, ``paths`` numbers (page, path) pairs."""
    n_pages, n_paths = pages.max(initial=-1) + 1, paths.max(initial=-1) + 1
    each = np.bincount(paths, minlength=n_paths)
    text = np.bincount(paths, np.maximum(chars - links, 0), n_paths) / each
    stops = np.bincount(paths, punctuation, n_paths) / each
    linked = np.bincount(paths, links, n_paths) / np.maximum(np.bincount(paths, chars, n_paths), 1)
    ratio = (np.log1p(text) * (1 + np.log1p(stops)) * np.where(linked > MOST_LINKED, 0.0, 1 - linked))[paths]
    # a page that marks its article has no text elsewhere
    has = np.bincount(pages, marked * np.maximum(chars - links, 0), n_pages) > 0
    ratio = np.where(has[pages] & ~marked, 0.0, ratio)
    mean = np.bincount(pages, ratio * chars, n_pages) / np.maximum(np.bincount(pages, chars * (ratio > 0), n_pages), 1)
    weighed = ratio * np.where(marked, MARKED, 1.0)
    smooth = weighed / 2
    for step in (1, -1):
        beside, there = np.roll(weighed, step), np.roll(pages, step)
        smooth += np.where(there == pages, beside, 0.0) / 4
    score = (np.bincount(paths, smooth, n_paths) / each)[paths]
    return (score >= SHARE * mean[pages]) & (ratio > 0)


def page_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    found = [Blocks(p or "").found for p in pages]
    page = np.repeat(np.arange(len(found)), [len(f) for f in found])
    blocks = [b for f in found for b in f]
    numbers: dict[tuple[int, int], int] = {}
    path = np.array([numbers.setdefault((int(i), b[1]), len(numbers)) for i, b in zip(page, blocks, strict=True)], np.int64)
    chars = np.array([len(b[0]) for b in blocks], np.float64)
    stops = np.array([len(_PUNCTUATION.findall(b[0])) for b in blocks], np.float64)
    kept = content(page, path, chars, stops, np.array([b[2] for b in blocks], np.float64), np.array([b[3] for b in blocks], bool))
    texts: list[list[str]] = [[] for _ in found]
    for i in np.flatnonzero(kept):
        texts[page[i]].append(blocks[i][0])
    return ["\n\n".join(t) for t in texts]


def extract_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) of every row: the page's main text, its blocks in order with an empty line between them.

    Works on whole pages, each on its own, so nothing is shuffled.  NULL and empty pages, and
    pages without an article, have the empty text and 0.  Keys and urls may be NULL, and
    repeated rows are rows of their own.  White space is what ``str.split`` takes for it, the
    no-break space included.  Headings count as text, also in an article's own header.
    Further columns are left out; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                texts = page_texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    rows = pages.select(key, "url", "html")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, url string, text string, n_chars long")
