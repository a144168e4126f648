"""Main text of HTML pages by two-pass block rules.

One scan over the tags cuts a page into blocks.  Pass 1 decides a block from its stop-word density, length and link
density; blocks inside navigation, headers, footers, asides, forms, notices, adverts or comment sections are
boilerplate by their place.  Pass 2 gives an ambiguous block, short or with few stop words, the label of its nearest
decided neighbours: that of both sides if they agree, else of the nearer side, the left one at equal distance; a heading
takes the label of what follows it.  Neighbours are looked for on the same side of the edges of a declared article or
main element.  Where these hold nothing that pass 1 found good, and where a page without them has nothing good, there is
no neighbour to inherit from, and what is not boilerplate counts as the text.

Null or empty html: empty text.  Tags left open, cut off pages, stray closing tags and unknown entities are read as
far as they make sense.  The whole page is read.  Equal pages give equal results, and other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowscope.llm.common import map_text, texts

# Frequent function words of the four languages of the pages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he in is it its not of on or she that the their they this to was we were which with you "
    "aber als am auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nicht noch oder sich sie sind und von war wie zu "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne nous ou par pas pour que qui sur un une vous "
    "al como con de del el ella en es esta la las lo los más no o para pero por que se su un una y".split()
)
# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("aside button dialog footer form head header iframe label menu nav noscript object option select svg template textarea title".split())
RAW = frozenset("script style textarea title xmp noscript".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of class, id and role attributes that name parts beside the main text.
BESIDE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal "
    "nav navbar navigation newsletter notice notices overlay popup promo related replies reply respond share sharing sidebar social sponsor sponsored "
    "subscribe subscription toolbar widget alert complementary contentinfo search alertdialog toc pagination pager login signup paywall".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_NAMED = frozenset(("class", "id", "role"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in RAW}
_WORD = re.compile(r"\w+")


def _beside(attrs: str, article: bool) -> bool:
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif key in _NAMED and any((x := w.lower()) in BESIDE and not (article and x == "header") for w in _NAME.findall(value)):
            return True  # the header of an article holds its title
    return False


@dataclass(frozen=True)
class Block:
    text: str
    linked: int  # characters inside links
    beside: bool  # beside the content by its place
    article: int  # which declared article or main element it is in, 0: none
    heading: bool


class _Open:
    """The open elements, with the places of each name and of blocks, so that no tag searches the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []  # name, beside, article
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, name: str) -> int:
        return own[-1] if (own := self.at.get(name)) else -1

    def push(self, name: str, beside: bool, article: int) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, beside, article))

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def count(self, name: str) -> int:
        return len(self.at.get(name, ()))


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    opened = _Open()
    text: list[str] = []
    linked = articles = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                _, beside, article = opened.stack[-1] if opened.stack else ("", False, 0)
                out.append(Block(joined, linked, beside, article, any(opened.count(h) for h in HEADING)))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            linked += (end - at) if opened.count("a") else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                text.append(_html.escape(page[m.start() + 9 : at - 3]))
            continue
        if m[1]:
            where = opened.last(name)
            if name in BLOCK or name in DROP and where >= 0:
                flush()
            # an end tag of text does not reach beyond the block it stands in
            if where >= 0 and (name in BLOCK or name in DROP or not opened.blocks or opened.blocks[-1] < where):
                opened.pop_to(where)
            continue
        if name in RAW:
            stop = _END[name].search(page, at)
            at = stop.end() if stop else n
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK or name in DROP:
            flush()
            if name in BLOCK and name not in ("dd", "dt", "li", "td", "th", "tr") and (where := opened.last("p")) >= 0 and opened.blocks[-1] == where:
                opened.pop_to(where)  # an open p ends before a block
            for other in CLOSES.get(name, ()):
                if opened.stack and opened.stack[-1][0] == other:
                    opened.pop_to(len(opened.stack) - 1)
        if name in VOID or m[0].endswith("/>") and name not in BLOCK:
            continue
        _, beside, article = opened.stack[-1] if opened.stack else ("", False, 0)
        if not article and name in ("article", "main"):
            articles += 1
            article = articles
        off = beside or (name in DROP and not (name == "header" and article)) or name not in ("html", "body", "article", "main") and _beside(m[3], bool(article))
        opened.push(name, off, article)
    flush()
    return out


GOOD, BAD, OPEN = 1, 0, None


def first_pass(b: Block, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.3, most_links: float = 0.5) -> int | None:
    """GOOD, BAD, or OPEN where length and stop words do not decide."""
    if b.beside or b.linked > most_links * len(b.text):
        return BAD
    if len(b.text) < short:
        return OPEN
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return GOOD if stop >= high or stop >= low and len(b.text) >= long else OPEN


def second_pass(found: list[Block], labels: list[int | None]) -> list[int]:
    """Open blocks take the labels of decided neighbours of their own article, or outside all."""
    out = list(labels)
    declared = any(b.article for b in found)
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        groups.setdefault(b.article, []).append(i)
    for article, own in groups.items():
        decided = [k for k, i in enumerate(own) if labels[i] is not None]
        if not any(labels[i] == GOOD for i in own):
            for i in own:
                if labels[i] is None:
                    out[i] = GOOD if article or not declared else BAD
            continue
        for k, i in enumerate(own):
            if labels[i] is not None:
                continue
            p = bisect_left(decided, k)
            left, right = (decided[p - 1] if p else None), (decided[p] if p < len(decided) else None)
            if left is None or right is None:
                side = right if left is None else left
            elif found[i].heading:
                side = right
            else:
                side = left if k - left <= right - k else right
            out[i] = labels[own[side]]
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    labels = second_pass(found, [first_pass(b) for b in found])
    return "\n".join(b.text for b, x in zip(found, labels, strict=True) if x == GOOD)


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns but ``html`` and any earlier ``out``, with the main text and its code points."""
    keep = [c for c in pages.columns if c not in (html, out, "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        got = [extract(x) for x in texts(batch, html).to_pylist()]
        return {out: pa.array(got, pa.string()), "n_chars": pa.array([len(x) for x in got], pa.int64())}

    return map_text(pages.select(*keep, html), html, run, schema)
