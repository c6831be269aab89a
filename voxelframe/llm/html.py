"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block; blank lines don't count.  Each line has a weight: its text
length.  Tags are evidence and change weights: lines in elements that never hold an article (menus, page
headers, footers, sidebars, forms, adverts, comments by readers) and lines that are mostly link text weigh
nothing; where a page marks its article (article or main), a line in it weighs MARKED more and a line
outside only OUTSIDE of its length.

The weight of each window of WINDOW lines gives the distribution.  A surge is where it reaches the
threshold, a dive where it falls below; a block runs from a surge to its dive.  At its edges a line goes
when the window from it outward stays below the threshold, so a short notice beside long text goes too;
headings that lead a block stay.  Blocks with no empty line between them are one.  The threshold is
THRESHOLD, or PEAK_SHARE of the fullest window where that is less (short pages).  On unmarked pages short
lines at the edges of the text or between empty lines can be lost, and notices between long paragraphs
stay, as in the method.

Edge cases: null or empty html gives the empty text, an empty table an empty one; rows are independent, so
repeated rows repeat their result; pages are taken whole at any length; a column that has the name of the
result is replaced, others stay.  Unclosed or stray tags are tolerated: head, option, select and svg end
where later tags imply it, a link that is not closed ends with its block, an anchor without href is no
link, an article or main of white space marks nothing, a quote in a tag that is never closed is a
character.  Only a script, style, textarea, title or iframe that is never closed takes the rest of the
page, as in HTML.  A cut-off tag at the end is markup and dropped.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window that only running text has.
THRESHOLD = 86
PEAK_SHARE = 0.1
#: What a line in a marked article weighs besides its length, and the share of its length that a line
#: outside it weighs.
MARKED = 1000
OUTSIDE = 0.1
#: Share of link text above which a line outside a marked article is a menu line.
LINK_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*(?![\"'])[^\s>]+|[=\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements of plain text: nothing in them is markup but their own end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in "script style textarea title iframe".split()}
#: Elements whose text is never shown as such; they break no line.
_HIDDEN = frozenset("head noscript template svg select datalist option".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_IN_SELECT = frozenset("option optgroup hr script template".split())
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var article aside footer form header main nav section".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr del label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav header footer aside form button menu dialog".split())
#: Names of elements that hold no article: alone, or as the first or last part of a longer name.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu sidebar breadcrumb "
    "breadcrumbs footer header masthead comments disqus cookie cookies newsletter popup modal".split()
)
#: Names that mean it alone, or with one of _TAILS after them.
_WEAK = frozenset("comment replies consent notice share sharing social related subscribe widget widgets".split())
_TAILS = frozenset("area bar block box button buttons container form icons item items links list media panel posts section stories widget widgets wrapper".split())
#: First parts of names that tell how a page is laid out, not what an element holds.
_LAYOUT = frozenset("with has no without is show hide layout page".split())
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[-_:]+")


def _names_chrome(names: str) -> bool:
    """Whether a class, id or role says that an element holds no article."""
    for name in names.lower().split():
        parts = [p for p in _SPLIT.split(name) if p]
        if not parts or parts[0] in _LAYOUT:
            continue
        if parts[0] in _PARTS or parts[-1] in _PARTS:
            return True
        if parts[0] in _WEAK and all(p in _TAILS or p in _WEAK for p in parts[1:]):
            return True
    return False


_BY_NAME, _BY_TAG = 1, 2


class Line:
    __slots__ = ("parts", "linked", "article", "heading", "dropped")

    def __init__(self, article: bool, heading: bool = False):
        self.parts, self.linked, self.article, self.heading = [], 0, article, heading
        self.dropped = False  # it had text in an element that never holds an article


def _implied(stack: list, tag: str) -> None:
    """Ends hidden elements that this start tag cannot be in."""
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if (
            (name == "head" and tag not in _IN_HEAD and k == len(stack) - 1)
            or (name == "option" and tag in ("option", "optgroup"))
            or (name in ("select", "datalist", "option") and tag not in _IN_SELECT and tag not in _INLINE)
            or (name == "svg" and tag in _ENDS_SVG and not any(x[0] == "foreignobject" for x in stack[k:]))
        ):
            del stack[k:]


def _lines(page: str) -> list[Line]:
    # Tag; chrome by tag or by name, article, hidden: these of it or of an element around it.
    stack: list[tuple[str, int, bool, bool]] = []
    lines, at, links, closed = [Line(False)], 0, 0, False

    def text(upto: int):
        if upto > at and stack and stack[-1][0] == "head" and page[at:upto].strip():
            stack.pop()
        if upto > at and not (stack and (stack[-1][1] or stack[-1][3])):
            piece = page[at:upto]
            lines[-1].parts.append(piece)
            lines[-1].linked += len(piece.strip()) if links else 0
        elif upto > at and not stack[-1][3] and page[at:upto].strip():
            lines[-1].dropped = True

    def fresh():
        lines.append(Line(bool(stack) and stack[-1][2], any(x[0] in _HEADINGS for x in stack)))

    while m := _TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag, end, alone = tag.lower(), bool(m.group(1)), m.group(3).endswith("/")
        if not end:
            _implied(stack, tag)
        if tag in _RAW:
            if not end and not (alone and any(x[0] == "svg" for x in stack)):
                stop = _RAW[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag == "a":
            links = 0 if end else int(bool(_HREF.search(m.group(3))))
            # A link that no end tag closes before the next one ends with its block.
            closed = bool(links) and (after := _ANCHOR.search(page, at)) is not None and bool(after.group(1))
        if tag in _INLINE:
            continue
        if links and not closed and tag not in _HIDDEN:
            links = 0
        was = bool(stack) and stack[-1][3]
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID and not alone:
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                stack.pop()
            chrome, article, hidden = stack[-1][1:] if stack else (0, False, False)
            names = " ".join("".join(n) for n in _NAMES.findall(m.group(3)))
            inside = tag in ("article", "main") or "article" in names.lower().split()
            if inside and chrome == _BY_NAME:
                chrome = 0  # a wrapper's name does not decide on the article in it
            if tag in _CHROME and not (tag == "header" and (article or inside)):
                chrome = _BY_TAG
            elif not chrome and not inside and tag not in ("body", "html") and _names_chrome(names):
                chrome = _BY_NAME
            stack.append((tag, chrome, article or inside, hidden or tag in _HIDDEN))
        if tag not in _HIDDEN and not (was and stack and stack[-1][3]):
            fresh()
    text(len(page))
    return lines


def main_text(page: str | None) -> str:
    """The main text, blocks joined by one line feed."""
    if not page:
        return ""
    lines = _lines(page)
    raws = ["".join(x.parts) for x in lines]
    plain = [_SPACE.sub(" ", entities.unescape(raw)).strip() for raw in raws]
    marked = any(x.article and t for x, t in zip(lines, plain))
    texts, weights, heads = [], [], []
    for x, raw, t in zip(lines, raws, plain):
        if t or x.dropped:
            n = len(t)
            if marked:
                n = n and (n + MARKED if x.article else OUTSIDE * n)
            if not (marked and x.article) and x.linked > LINK_SHARE * len(raw.strip()):
                n = 0
            texts.append(t)
            weights.append(n)
            heads.append(x.heading)
    return "\n".join(texts[k] for k in running_text(weights, heads))


def running_text(lengths: list[float], heads: list[bool]) -> list[int]:
    """The lines between surges and dives of the distribution over windows of WINDOW lines."""
    n = len(lengths)
    sums = [0]
    for x in lengths:
        sums.append(sums[-1] + x)

    def window(first: int) -> int:
        return sums[max(0, min(n, first + WINDOW))] - sums[max(0, first)]

    least = min(THRESHOLD, PEAK_SHARE * max(map(window, range(1 - WINDOW, n)), default=0))
    kept, surge = [], None
    for i in range(1 - WINDOW, n + 1):
        full = i < n and least and window(i) >= least
        if full and surge is None:
            surge = i
        elif not full and surge is not None:
            lo, hi = max(0, surge), min(n, i + WINDOW - 1)
            while lo < hi and window(lo - WINDOW + 1) < least and not (lengths[lo] and heads[lo]):
                lo += 1
            while lo < hi and window(hi - 1) < least:
                hi -= 1
            if kept and all(lengths[kept[-1] + 1 : lo]):
                lo = kept[-1] + 1  # nothing empty lies between the blocks: they are one
            kept.extend(k for k in range(lo, hi) if lengths[k] and (not kept or k > kept[-1]))
            surge = None
    return kept


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the column ``text``."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py()) for v in column], pa.string())

    return pages.withColumn(text, text_of(F.col(html)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
