"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Per page and path, text length and punctuation are added up and divided by the number
of nodes; both ratios are smoothed along the page, multiplied, and paths above a threshold are content. The element that holds
most of the content is the article; its other blocks (headings, short lines) belong to it. Elements whose tag or class names a
menu, header, footer, sidebar, notice, advert, form, script, style or comment section weigh nothing anywhere.

Pages are handled one by one inside tasks; nothing is gathered.

Defined results: null, empty or textless pages give an empty text; unclosed and stray tags are closed as browsers do it for
paragraphs, items and cells, and never end the page except for script, style and textarea; repeated rows each keep their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table
from foldwise.llm.registry import query

# Self-closed raw elements end at once (a slash that ends an unquoted value closes nothing). Without an end tag only script, style and
# textarea reach to the end of the page; of the others the start tag is a tag like any other. Buttons and the like do not nest.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template|iframe|svg|textarea|select|button)(?:\s(?:[^>]*[\s\"'])?)?/>"
    r"|<(?P<raw>script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<part>template|svg)(?=[\s/>])[^>]*>.*?</(?P=part)\s*>"
    r"|<(?P<flat>noscript|iframe|select|button)(?=[\s/>])[^>]*>(?:(?!<(?P=flat)[\s/>]).)*?</(?P=flat)\s*>"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s[^>]*?|/)?)>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
# A start tag ends these open elements, up to the nearest element that bounds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_OFF_TAGS = frozenset("head title nav footer aside form menu dialog header".split())
_OFF_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|footer|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
    r"share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|replies|reply|login|search|toolbar|masthead|pagination|pager)(?:$|[\s_-])", re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡]")


class _Block:
    __slots__ = ("parts", "path", "holders", "off")

    def __init__(self, stack: list[tuple[str, int, bool]]):
        self.parts: list[str] = []
        blocks = [x for x in stack if x[0] not in _INLINE]
        self.path = "/".join(x[0] for x in blocks)
        self.holders = [x[1] for x in blocks]
        self.off = any(x[2] for x in stack)


def blocks_of(page: str) -> list[_Block]:
    """Text blocks in page order, each with its tag path and the elements that hold it."""
    stack: list[tuple[str, int, bool]] = []
    out: list[_Block] = []
    current: _Block | None = None
    at = number = 0

    def text(raw: str) -> None:
        nonlocal current
        if current is None:
            if not raw.strip():
                return
            current = _Block(stack)
            out.append(current)
        current.parts.append(raw)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if tag in _VOID:
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag == "hr":
                current = None
            continue
        off_inside = False
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    off_inside = any(x[2] for x in stack[k:])
                    del stack[k:]
                    break
        else:
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(m["attrs"] or "")) if m["attrs"] else ""
            inside = any(x[0] in ("article", "main") for x in stack)
            # A header inside an article carries its heading; a page's header does not.
            off = (tag in _OFF_TAGS and not (tag == "header" and inside)) or bool(names and tag not in ("html", "body", "article", "main") and _OFF_NAMES.search(names))
            if tag in _P_ENDS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif tag in _ENDS:
                ends, bounds = _ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
            number += 1
            stack.append((tag, number, off))
            off_inside = off
        if not inline or off_inside:
            current = None
    if at < len(page):
        text(page[at:])
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one line each."""
    if not page:
        return ""
    blocks = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks_of(page)]
    blocks = [(b, t) for b, t in blocks if t and not b.off]
    if not blocks:
        return ""
    totals: dict[str, list[float]] = {}
    for b, t in blocks:
        x = totals.setdefault(b.path, [0, 0, 0])
        x[0] += 1
        x[1] += len(t)
        x[2] += len(_PUNCTUATION.findall(t))
    ratios = np.array([[totals[b.path][1] / totals[b.path][0], 1 + totals[b.path][2] / totals[b.path][0]] for b, _ in blocks])
    if len(blocks) > 2:
        weights = np.array([0.25, 0.5, 0.25])
        padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
        ratios = sum(w * padded[k : k + len(blocks)] for k, w in enumerate(weights))
    fused = ratios[:, 0] * ratios[:, 1]
    # Above half of the length-weighted mean minus the spread: robust where a page has one kind of block only.
    lengths = np.array([len(t) for _, t in blocks], float)
    centre = np.average(fused, weights=lengths)
    content = fused >= min(centre / 4, fused.max())
    # The innermost element that holds nine tenths of the content's text is the article.
    held: dict[int, float] = {}
    for (b, _), n, c in zip(blocks, lengths, content):
        for h in b.holders if c else ():
            held[h] = held.get(h, 0) + n
    enough = 0.9 * lengths[content].sum()
    article = max((h for h, n in held.items() if n >= enough), default=None)
    single = [b for (b, _), c in zip(blocks, content) if c]
    if article is not None and len(single) == 1 and single[0].holders[-1] == article and len(single[0].holders) > 1:
        article = single[0].holders[-2]
    if article is not None:
        return "\n".join(t for b, t in blocks if article in b.holders)
    return "\n".join(t for (_, t), c in zip(blocks, content) if c)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text), one row per page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
