"""Operator 2: main text of web pages by tag-path ratios.

Text nodes are grouped by their path of tags from the root. A path's text ratio is its characters per node, its punctuation ratio the
marks per node. Along the page both ratios are smoothed over neighbouring nodes, fused by multiplication, and averaged for each
path; paths whose value reaches a share of the standard deviation over the page's nodes are content.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ensure_importable
from .arrow import over_pieces

SIGMA, RADIUS, LAMBDA = 1.0, 2, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(/?)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the key closes an open element of the named kinds, unless one of the walls lies between.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
} | {b: (("p",), ("table", "td", "th", "button")) for b in _BLOCKS}
_MARKS = re.compile(r"[,.;:!?\"'()…–—“”‘’«»¿¡、。，！？]")
_BLANK = re.compile(r"\s+")


def text_nodes(page: str) -> list[tuple[str, str]]:
    """(path, text) of every text node outside head, script, style and the like, in order; white space is collapsed and blank nodes are left out.
    Tags that aren't closed are closed as browsers do in common cases; an end tag without a start tag is ignored."""
    stack: list[str] = []
    out: list[tuple[str, str]] = []
    at = 0

    def add(raw: str) -> None:
        text = _BLANK.sub(" ", _html.unescape(raw)).strip()
        if text and "head" not in stack:
            out.append(("/".join(stack), text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            continue
        if tag in _VOID or m.group(4):
            continue
        if tag == "body" and "head" in stack:
            del stack[stack.index("head") :]
        if tag in _CLOSES:
            kinds, walls = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in walls:
                    break
                if stack[i] in kinds:
                    del stack[i:]
                    if tag not in ("tr",):
                        break
        stack.append(tag)
    if at < len(page):
        add(page[at:])
    return out


def content(page: str, sigma: float = SIGMA, radius: int = RADIUS, lam: float = LAMBDA) -> tuple[list[str], int]:
    """The texts of the content nodes of a page, in order, and the number of its text nodes."""
    nodes = text_nodes(page)
    if not nodes:
        return [], 0
    ids: dict[str, int] = {}
    path = np.array([ids.setdefault(p, len(ids)) for p, _ in nodes])
    chars = np.array([len(t) for _, t in nodes], float)
    marks = np.array([len(_MARKS.findall(t)) for _, t in nodes], float)
    count = np.bincount(path)
    text_ratio = (np.bincount(path, chars) / count)[path]
    mark_ratio = (np.bincount(path, marks) / count)[path]
    fused = smooth(text_ratio, sigma, radius) * smooth(mark_ratio, sigma, radius)
    value = np.bincount(path, fused) / count
    good = value >= lam * fused.std()
    if not (value > 0).any():  # no punctuation at all: text alone decides
        plain = np.bincount(path, smooth(text_ratio, sigma, radius)) / count
        good = plain >= plain.max() * 0.5
    return [t for (_, t), p in zip(nodes, path.tolist()) if good[p]], len(nodes)


def smooth(x: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian average over neighbours; at the ends over those that exist."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[radius : radius + len(x)] / np.convolve(np.ones(len(x)), kernel)[radius : radius + len(x)]


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sigma: float = SIGMA, radius: int = RADIUS, lam: float = LAMBDA) -> DataFrame:
    """(id_col, text, n_nodes, n_content) of every row of df: the content nodes' texts, one a line.

    A null page has nulls; an empty page, and one without text, has the empty text and no content nodes. On a page without punctuation the
    paths with at least half the longest text ratio are content. Equal ratios are treated alike, since paths are chosen, not ranks. Repeated rows and
    null ids are kept; other columns are ignored; an empty table gives no rows. Pages are parsed whole; there is no shuffle.
    """
    ensure_importable(df.sparkSession)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nodes, good = [], [], []
        for page in batch.column(1).to_pylist():
            if page is None:
                texts.append(None)
                nodes.append(None)
                good.append(None)
                continue
            found, n = content(page, sigma, radius, lam)
            texts.append("\n".join(found))
            nodes.append(n)
            good.append(len(found))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(nodes, pa.int32()), pa.array(good, pa.int32())], names=["_id", "text", "n_nodes", "n_content"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("_id"), df[html_col].cast("string").alias("_html"))
    return rows.mapInArrow(over_pieces(piece, 1), f"_id {kind}, text string, n_nodes int, n_content int").withColumnRenamed("_id", id_col)
