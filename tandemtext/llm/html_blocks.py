"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tandemtext.llm.block_labels import LABELLED
from tandemtext.llm.common import chunks, table

#: Depth of the tree and least examples on either side of a split.
DEPTH, LEAST = 6, 2
FEATURES = ("words before", "link density before", "words", "link density", "words after", "link density after")
#: Word count of the neighbour that the first and last block don't have.
EDGE = -1.0

#: A value in quotes after = may hold < and >; a quote that isn't closed is a character like others.
_ATTRIBUTES = r"""(?:[^<>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TAG = re.compile(rf"<!--|<[!?/]?[a-zA-Z]{_ATTRIBUTES}>|<[!?]{_ATTRIBUTES}>")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_SKIPPED = frozenset("script style noscript template title textarea select svg iframe object".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_END = {t: re.compile(rf"</{t}\b[^<>]*>?", re.IGNORECASE) for t in _SKIPPED}


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words inside links) of each flat text block, in order.

    A block ends at every tag that isn't inline. Comments, scripts, styles, titles and the like are left out; one that
    is never closed reaches to the end. A < that begins no tag is text. Values of attributes in quotes may hold < and >.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = words = 0
    in_link = False
    at, n = 0, len(page)

    def text(s: str) -> None:
        nonlocal linked, words
        if s:
            s = html.unescape(s)
            k = len(s.split())
            words += k
            linked += k * in_link
            parts.append(s)

    def flush() -> None:
        nonlocal linked, words
        if words:
            out.append((" ".join("".join(parts).split()), words, min(linked, words)))
        parts.clear()
        linked = words = 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        tag = m.group()
        at = m.end()
        if tag == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(tag)
        if name is None:
            continue
        t = name.group(1).lower()
        closing = tag[1] == "/"
        if t in _SKIPPED and not closing and not tag.endswith("/>"):
            end = _END[t].search(page, at)
            at = n if end is None else end.end()
        elif t == "a":
            in_link = not closing
        elif t not in _INLINE:
            flush()
            if closing:
                in_link = False
    flush()
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """A row of FEATURES for each block."""
    w = np.array([EDGE, *[b[1] for b in found], EDGE])
    d = np.array([0.0, *[b[2] / b[1] for b in found], 0.0])
    return np.stack([w[:-2], d[:-2], w[1:-1], d[1:-1], w[2:], d[2:]], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST) -> tuple | float:
    """A classification tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or the share of content at a leaf.

    Thresholds lie halfway between neighbouring values. Of equally good splits the first feature and least threshold win.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        cost = np.where(ok, k * left * (1 - left) + (len(y) - k) * right * (1 - right), np.inf)
        i = int(cost.argmin())
        if best is None or cost[i] < best[0] - 1e-12:
            best = (float(cost[i]), f, float((v[i] + v[i + 1]) / 2))
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=1)
def trained_tree() -> tuple | float:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def content(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """Whether each row of `x` is content: the share of content at its leaf is at least a half."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, t, low, high = tree
    at = x[:, f] <= t
    out = np.zeros(len(x), bool)
    out[at], out[~at] = content(low, x[at]), content(high, x[~at])
    return out


def extract(pages: DataFrame, tree: tuple | float | None = None) -> DataFrame:
    """(page_id, n_blocks, n_content, text) of each row of `pages`: its blocks, those kept, and their text, one block a line.

    Whole pages are read, very long ones too. A null page has null text and no blocks; an empty one, one without content and
    one of broken markup without text, empty text. A null page_id is a value as others. Repeated rows are repeated; other
    columns are ignored. A table without rows gives none. A leaf with as many examples of either kind counts as content.
    """
    tree = trained_tree() if tree is None else tree
    schema = T.StructType([pages.schema["page_id"], T.StructField("n_blocks", T.LongType()), T.StructField("n_content", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                found = [blocks(p) if p else [] for p in b.column(1).to_pylist()]
                sizes = [len(f) for f in found]
                x = np.concatenate([features(f) for f in found if f] + [np.zeros((0, 6))])
                keep = content(tree, x)
                texts, kept, at = [], [], 0
                for p, f in zip(b.column(1), found, strict=True):
                    k = keep[at : at + len(f)]
                    at += len(f)
                    texts.append("\n".join(t for (t, _, _), yes in zip(f, k, strict=True) if yes) if p.is_valid else None)
                    kept.append(int(k.sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, with its blocks and those kept."""
    return extract(table(spark, sf_dir, "pages"))
