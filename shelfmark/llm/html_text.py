"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags from the root. Text length without links and punctuation are
aggregated for each path, divided by the path's number of blocks, smoothed along the page and fused by their product. Each path
has a weight for what its elements say of themselves: an article's counts ARTICLE times, that of an element that is by its tag or role
a menu, footer, sidebar or form OTHER times, and each telling class or id NAMED times, or COMMENT times if it tells of comments. A path is content if its weighted ratio is
THRESHOLD or more of the page's text-weighted mean; nothing is content by a name alone. Short blocks beside content, such as headings
and lists in the same element, belong to it; blocks that are mostly links don't. A name or a form has no weight on what holds the
page's only article or most of its text.

Only what isn't text to read is left out before: scripts, styles, controls, and hidden elements.

Defined results: null and empty html, and pages without text, give an empty text; broken markup is read as far as it goes,
and a tag that never ends is text; equal ratios are treated alike; rows are kept, repeated or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.frames import map_arrow, small_batches

#: Share of a page's text without links that makes an element its wrapper, whatever its name.
MOST = 0.75
#: Share of the mean fused ratio that a path needs, and of a block's text that may be links.
THRESHOLD, LINKS = 0.4, 0.6
#: Weights of paths in an article, in a menu, footer, sidebar or form by tag or role, in an element of a telling class or id, and
#: in one whose class or id tells of readers' comments.
ARTICLE, OTHER, NAMED, COMMENT = 40.0, 0.01, 0.02, 0.0001

# Elements of HTML by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
UNREAD = {"button", "select", "option", "datalist", "svg", "canvas", "object", "head", "audio", "video", "map"}
OTHERS = {"nav", "footer", "aside", "form", "dialog", "menu"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog", "form", "toolbar"}
TELLING_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "disclaimer", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination",
    "pager", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget",
}
# How names of such elements start, and words that only say what stands beside.
TELLING_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "promo", "sidebar", "sponsor", "subscri")
BESIDE = {"has", "with", "no", "without"}
COMMENT_WORDS = ("comment", "disqus", "replies", "reply", "respond")
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CONTENT = {"article", "main"}
LISTS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "blockquote", "figure"}
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    tag: str
    path: str
    number: int
    content: bool = False
    linked: bool = False
    unread: bool = False
    weight: float = 1.0  # of the path down to here
    other: bool = False  # in an element that isn't content by its tag or role
    named: tuple[int, ...] = ()  # elements from the root to here that a name or being a form tells of


@dataclass
class Block:
    path: str
    beside: int  # the element whose other blocks it belongs to
    outer: int  # that around it
    text: str
    linked: int
    weight: float
    beside_weight: float
    listed: bool


def unread(tag: str, attributes: str) -> bool:
    """Whether an element holds nothing to read."""
    if tag in UNREAD:
        return True
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
            return True
    return False


def other(tag: str, attributes: str, inside_content: bool) -> bool:
    """Whether an element is by its tag or role no content; a form says less, since it may wrap a page."""
    if (tag in OTHERS and tag != "form") or (tag == "header" and not inside_content):
        return True
    return any(name.lower() == "role" and value.strip("\"'").lower() in OTHER_ROLES for name, value in (ATTRIBUTE.findall(attributes) if attributes else ()))


def telling(tag: str, attributes: str, inside_content: bool) -> bool:
    """Whether an element's class or id tells of something else than content."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").split():
                words = [w.lower() for w in WORD.findall(token)]
                said = {w for w in words if w in TELLING_WORDS or w.startswith(TELLING_STARTS)}
                if said and words[0] not in BESIDE and not (inside_content and said <= {"header", "tags"}):
                    return True
    return False


class Page:
    """The blocks of a page, in order."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset()) -> None:
        self.spared = spared
        # Of elements that a name or being a form tells of: their text without links, what content they hold, and which are of comments.
        self.seen, self.held, self.holds, self.comments = 0, Counter(), defaultdict(set), set()
        self.article_outside = False
        self.blocks: list[Block] = []
        self.stack = [Element("", "", 0)]
        self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            self._text(html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW:
                    closing = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
                    end = html.find(">", closing.start()) if closing else -1
                    at = end + 1 if end >= 0 else len(html)
                else:
                    self._start(tag, m[3])
        self._flush()

    def wrappers(self) -> frozenset[int]:
        """Elements with a telling name that hold the page's main element, its only article or most of its text."""
        if self.article_outside:
            return frozenset()
        return frozenset(k for k in self.holds.keys() | self.held.keys() if "main" in self.holds[k] or (k not in self.comments and ("article" in self.holds[k] or self.held[k] >= MOST * self.seen)))

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.unread:
            return
        if not top.linked and not top.other and (n := len(raw.strip())):
            self.seen += n
            for k in top.named:
                self.held[k] += n
        text = html_module.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if top.linked:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag not in INLINE)
            own = self.stack[k]
            # Text of a container itself lies beside its blocks; lists, quotes and the like are part of what holds them.
            around = [e for e in [self.stack[0], *self.stack[1:k]] if e.tag not in INLINE and e.tag not in LISTS and e.tag != "li"]
            beside = own
            if own.tag in CLOSES_P - {"div", "section", "article", "main"} or own.tag in ("li", "td", "th", "dd", "dt"):
                beside = around.pop()
            listed = any(e.tag in ("li", "td") for e in self.stack[1 : k + 1])
            self.blocks.append(Block(own.path, beside.number, around[-1].number if around else 0, text, self.linked, own.weight, beside.weight, listed))
        self.parts, self.linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            if tag in CLOSES_P:
                self._close("p", until={"div", "section", "article", "td", "li", "main", "body", "blockquote"})
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close(tag, until={"ul", "ol", "dl", "table", "select"})
        top = self.stack[-1]
        self.count += 1
        content = top.content or tag in CONTENT
        weight = top.weight
        no_content = other(tag, attributes, top.content)
        named = top.named
        if tag in CONTENT and not (top.content or top.other or top.named):
            weight *= ARTICLE
        if no_content:
            weight *= OTHER
        elif (tag == "form" or telling(tag, attributes, top.content)) and self.count not in self.spared:
            named = (*named, self.count)
            comment = any(w in attributes.lower() for w in COMMENT_WORDS)
            weight *= COMMENT if comment else OTHER if tag == "form" else NAMED
            if comment:
                self.comments.add(self.count)
        if tag in CONTENT and not (top.other or no_content):
            self.article_outside |= not named
            for k in named:
                self.holds[k].add(tag)
        path = top.path if tag in INLINE else f"{top.path}/{tag}"
        self.stack.append(Element(tag, path, self.count, content, top.linked or tag == "a", top.unread or unread(tag, attributes), weight, top.other or no_content, named))

    def _close(self, tag: str, until: set[str]) -> None:
        """An element that the next start tag ends; what is inline inside it ends as well."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in until:
                return

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and not any(e.tag == tag for e in self.stack):
            self.parts.append(" ")
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if tag not in INLINE:
                    self._flush()
                del self.stack[k:]
                return
            # An inline end tag doesn't end the blocks around it.
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return


def smoothed(values: np.ndarray) -> np.ndarray:
    """Each value with its neighbours, by a kernel of five that leaves most of it in place."""
    kernel = np.array([0.02, 0.13, 0.7, 0.13, 0.02])
    weights = np.convolve(np.ones(len(values)), kernel, "full")[2:-2]
    return np.convolve(values, kernel, "full")[2:-2] / weights


def path_ratios(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Each block's weighted ratio, that of its path, and the page's text-weighted mean of these before they are summed by path.

    Paths of the same tags whose elements say different things of themselves are different paths.
    """
    _, path = np.unique([f"{b.path} {b.weight:.6g}" for b in blocks], return_inverse=True)
    length = np.array([len(b.text) - b.linked for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    n = np.bincount(path)
    per = lambda x: (np.bincount(path, x) / n)[path]
    fused = smoothed(per(length)) * smoothed(per(marks) + 0.1) * np.array([b.weight for b in blocks])
    return per(fused), np.average(fused, weights=length + 1)


def main_text(html: str) -> str:
    """The page's content blocks, joined by one space."""
    page = Page(html)
    if spared := page.wrappers():
        page = Page(html, spared)
    # Links are content only where they are a part of a text, or stand in an article and in no list.
    blocks = [b for b in page.blocks if b.linked <= LINKS * len(b.text) or (b.weight >= ARTICLE and not b.listed)]
    if not blocks:
        return ""
    ratio, mean = path_ratios(blocks)
    chosen = ratio >= THRESHOLD * mean
    held = {b.beside for b, c in zip(blocks, chosen, strict=True) if c}
    # A block with a name of its own, which tells of something else, isn't part of what it stands in. Parts of an article go along with it.
    along = [(b.beside in held and b.weight >= b.beside_weight) or (b.outer in held and b.weight >= ARTICLE) for b in blocks]
    return " ".join(b.text for b, c, a in zip(blocks, chosen, along, strict=True) if c or a)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, "url", "text", "n_chars"])

    return map_arrow(rows, each, schema)
