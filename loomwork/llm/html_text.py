"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf tag path (tags with their class and id). Text length,
punctuation and link text are added up per path; the paths' ratios are smoothed along the page, fused into one score and
thresholded. Content is every accepted path's text with the headings next to it, without the parts that are no article by
their tag or name (navigation, forms, comments and such); of pages whose text is mostly in <article> or <main>, what is in those.
"""

from __future__ import annotations

import functools
import html
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# HTML's void, block and non-text elements, and what page parts that are no article are called.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video map head title textarea select option button datalist".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset label input".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "title", "legend", "summary", "dd", "dt", "li"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|footer|foot|header|masthead|comments?|comment-\w+|disqus|replies|reply|respond|discussion|"
    r"notice\w*|cookie\w*|consent|gdpr|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pager|pagination|copyright|legal|disclaimer|alert|form|search|tags|meta|byline)(?=$|[\s_-])",
    re.I,
)
#: Within an article these are parts of it.
OWN_PARTS = frozenset("header tags meta byline".split())
#: Articles of these classes are not the page's.
OTHER_ARTICLES = frozenset("comment reply ad advert advertisement sponsored promo".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
#: The score of 25 characters with a mark.
SENTENCE = 50.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article whose text is short by nature.
STRUCTURE = HEADINGS | frozenset("header li dt dd td th caption figcaption blockquote pre".split())
#: What the score of a part outside an article counts if it is called as boilerplate is.
NAMED = 0.1
#: Elements of ASIDE that may be around a whole page.
WRAPS = frozenset("form fieldset".split())
#: Elements nested deeper stand side by side, as browsers have it.
DEPTH = 512
_WHITE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Blocks of text in page order: (path, text, length of link text). A path is a tuple of (tag, name, element's number)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int]] = []
        self.blocks: list[tuple[tuple, str, int]] = []
        self.buffer: list[str] = []
        self.path: tuple = ()
        self.links, self.number, self.silent, self.anchors, self.begun = 0, 0, 0, 0, False

    def flush(self):
        text = _WHITE.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.blocks.append((self.path, text, self.links))
        self.buffer, self.links, self.begun = [], 0, False

    def block_path(self) -> tuple:
        at = max((k for k, x in enumerate(self.stack) if x[0] in BLOCKS), default=-1)
        return tuple(self.stack[: at + 1])

    def pop(self, at: int):
        for tag, _, _ in self.stack[at:]:
            self.silent -= tag in SILENT
            self.anchors -= tag == "a"
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_within("p", ("article", "section", "div", "td", "th", "li", "body", "button", "blockquote"))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_within(tag, ("ul", "ol", "dl", "table", "select"))
        if len(self.stack) >= DEPTH:
            self.pop(DEPTH - 1)
        own = dict(attrs)
        name = " ".join(own.get(k) or "" for k in ("class", "id", "role")).strip()
        self.number += 1
        self.stack.append((tag, name, self.number))
        self.silent += tag in SILENT
        self.anchors += tag == "a"

    def close_within(self, tag, limits):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                return
            if self.stack[k][0] in limits:
                return

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                return
            if self.stack[k][0] in ("article", "body", "section", "main", "td", "table") and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if self.silent:
            return
        if not self.begun and not data.isspace():
            self.path, self.begun = self.block_path(), True
        self.buffer.append(data)
        if self.anchors:
            self.links += len(data.strip())


def read_blocks(page: str) -> list[tuple[tuple, str, int]]:
    reader = _Reader()
    reader.feed(page)
    rest = reader.rawdata
    reader.rawdata = ""
    if rest and not rest.startswith("<"):  # a text that ends in the middle of a reference; an unfinished tag is dropped
        reader.handle_data(html.unescape(rest))
    reader.flush()
    return reader.blocks


def _aside(path: tuple, most: frozenset) -> bool:
    """Whether an element of the path is a part of the page that is no article by its tag. A form around most of the page is none."""
    inside = False
    for tag, name, number in path:
        inside = inside or tag in ("article", "main")
        if (tag in ASIDE and not (tag in WRAPS and number in most)) or (tag == "header" and not inside) or (tag == "article" and OTHER_ARTICLES & set(name.lower().split())):
            return True
    return False


def _named(path: tuple, most: frozenset) -> bool:
    """Whether an element of the path is called as parts are that are no article. Elements around most of the text, headings and an article's own parts may be called so."""
    inside = False
    for tag, name, number in path:
        inside = inside or tag in ("article", "main")
        if tag in ("html", "body", "article", "main") or tag in HEADINGS or number in most:
            continue
        if any(not (inside and x in OWN_PARTS) for x in _names(name)):
            return True
    return False


@functools.lru_cache(4096)
def _names(name: str) -> tuple[str, ...]:
    """Words of a name that boilerplate is called by."""
    return tuple(x.group().strip(" \t\n_-").lower() for x in NAMES.finditer(name))


def _spared(path: tuple) -> bool:
    return any(tag in STRUCTURE or OWN_PARTS & set(re.split(r"[\s_-]", name.lower())) for tag, name, _ in path)


def around_most(blocks, score: np.ndarray) -> frozenset:
    """Numbers of the elements that hold most of the accepted text."""
    weight: dict[int, int] = {}
    total = 0
    for (path, text, _), ok in zip(blocks, score >= threshold(score, blocks)):
        if ok:
            total += len(text)
            for _, _, number in path:
                weight[number] = weight.get(number, 0) + len(text)
    return frozenset(k for k, w in weight.items() if 2 * w > total)


def path_scores(blocks) -> np.ndarray:
    """A score for each block: its path's text and punctuation per block, smoothed along the page and fused."""
    key = {}
    at = np.array([key.setdefault(tuple((t, n) for t, n, _ in p), len(key)) for p, _, _ in blocks])
    count = np.bincount(at)
    total = np.bincount(at, [len(t) for _, t, _ in blocks])
    marks = np.bincount(at, [len(PUNCTUATION.findall(t)) for _, t, _ in blocks])
    links = np.bincount(at, [k for _, _, k in blocks])
    length, dots = (total / count)[at], (marks / count)[at]
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    free = 1 - (links / np.maximum(total, 1))[at]
    return np.sqrt(smooth(length) * length) * (1 + np.sqrt(smooth(dots) * dots)) * np.maximum(free, 0) ** 2


def middle(score: np.ndarray, blocks) -> float:
    """The score of the page's middle 40 characters."""
    return float(np.median(np.repeat(score, [1 + len(t) // 40 for _, t, _ in blocks])))


def threshold(score: np.ndarray, blocks) -> float:
    """A quarter of the middle score; that of a short sentence is always enough."""
    return min(SENTENCE, 0.25 * middle(score, blocks))


def in_article(path: tuple) -> bool:
    return any(tag in ("article", "main") for tag, _, _ in path)


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty for a null page or one without text."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    most = around_most(blocks, path_scores(blocks))
    blocks = [b for b in blocks if not _aside(b[0], most)]
    if not blocks:
        return ""
    score = path_scores(blocks)
    most = around_most(blocks, score)
    named = np.array([_named(path, most) for path, _, _ in blocks])
    inside = np.array([in_article(path) for path, _, _ in blocks])
    usual = middle(score[~named], [b for b, x in zip(blocks, named) if not x]) if not named.all() else middle(score, blocks)
    # Called as boilerplate is, a part outside an article has to stand out, and one within has to be as good as a sentence.
    good = np.where(named, np.where(inside, score >= min(SENTENCE, usual), NAMED * score >= 0.25 * usual), score >= min(SENTENCE, 0.25 * usual))
    size = np.array([len(t) for _, t, _ in blocks]) * good
    within = size @ inside * 2 >= size.sum() and bool(inside.any())
    # Within an article headings, its own parts, and lists, tables and quotes of plain text stay, however short.
    spared = np.array([_spared(path) and 2 * links < len(text) for path, text, links in blocks])
    keep = (good | inside & ~named & spared) if within else good.copy()
    if within:
        keep &= inside
    heads = [k for k, (path, _, _) in enumerate(blocks) if path and path[-1][0] in HEADINGS]
    for k in reversed(heads):  # a heading stays with what follows it
        if named[k] and not inside[k]:
            continue
        keep[k] |= k + 1 < len(blocks) and keep[k + 1]
    return "\n".join(text for (_, text, _), ok in zip(blocks, keep) if ok)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null or empty page, or one with nothing but boilerplate, has an empty text. Repeated rows get a row each; an empty table gives an empty
    table; extra columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            found = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, own.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
