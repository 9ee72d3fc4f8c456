"""Operator 12: main text of HTML pages by two-pass block rules.

Pass 1 decides each block by itself: text set apart (menus, headers, footers, sidebars, notices, adverts, forms, comments)
and blocks mostly of links are out; long blocks with a share of stop words are in; long blocks without are out, unless the
page as a whole holds so few stop words that it is in a language the list does not know.  Short blocks stay ambiguous.
Pass 2 gives every ambiguous block the label of the nearest decided block, where a block that is not a sibling counts as two
places further; in an article element only blocks of that element count, and where none is decided the block is in.  On a
tie the block is in inside an article element; a heading goes with the decided block after it if that is in.  Where a page has an article element with at least as much text as the rest, blocks
outside of it are out.

Results: null, empty and wordless pages give an empty text and 0; repeated rows give a row each; very long pages are
processed whole, one at a time; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import column, schema_of
from tillbook.llm.html_blocks import Block, blocks

LONG = 70                  # characters from which a block is decided by its words
STOP_SHARE = 0.10          # share of stop words from which a long block is prose
LINK_SHARE = 0.5           # share of linked characters above which a block is a list of links
FURTHER = 2                # places that a decided block of another parent element counts as further away
SLICE = 1 << 22            # characters of text in one batch of results
WORD = re.compile(r"[^\W\d_]+")
# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were
which will with you
aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch oder sich
sie sind über um und von war wie wir zu zum zur
au aux avec ce cette dans de des du elle en est et il ils je la le les mais ne nous ou par pas pour que qui sa se son sont sur un une
vous
al como con del el ella ellos era las lo los más me mi no nos o para pero por se si sin sobre son su sus también una uno y ya
""".split())


def _stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _decide(found: list[Block]) -> list[bool | None]:
    """Pass 1: in, out or (None) ambiguous."""
    inside = sum(len(b.text) - b.linked for b in found if b.container and not b.apart)
    outside = sum(len(b.text) - b.linked for b in found if not b.container and not b.apart)
    by_container = inside > 0 and inside >= outside
    free = [b for b in found if not b.apart and b.linked <= LINK_SHARE * len(b.text)]
    shares = {id(b): _stop_share(b.text) for b in free if len(b.text) >= LONG}
    prose = sum(len(b.text) * shares[id(b)] for b in free if id(b) in shares)
    known_language = prose >= STOP_SHARE / 2 * sum(len(b.text) for b in free if id(b) in shares)
    labels: list[bool | None] = []
    for b in found:
        if b.apart or b.linked > LINK_SHARE * len(b.text) or (by_container and not b.container):
            labels.append(False)
        elif len(b.text) < LONG:
            labels.append(None)
        elif shares[id(b)] >= STOP_SHARE or not known_language:
            labels.append(True)
        else:
            # no running text by itself; in an article element it goes with its neighbours
            labels.append(None if b.container else False)
    return labels


def _before(found: list[Block], first: list[bool | None], order: range) -> list[tuple[int, int] | None]:
    """For each block (distance, index) of the nearest decided block of its article element that comes earlier in
    ``order``.  Blocks set apart inside an article element say nothing about their neighbours."""
    any_last: dict[int, int] = {}
    sibling_last: dict[tuple[int, int], int] = {}
    out: list[tuple[int, int] | None] = [None] * len(found)
    for i in order:
        b = found[i]
        near = []
        if b.container in any_last:
            near.append((abs(i - any_last[b.container]) + FURTHER, any_last[b.container]))
        if (b.container, b.parent) in sibling_last:
            near.append((abs(i - sibling_last[b.container, b.parent]), sibling_last[b.container, b.parent]))
        out[i] = min(near, default=None)
        if first[i] is not None and not (b.container and b.apart):
            any_last[b.container] = sibling_last[b.container, b.parent] = i
    return out


def _inherit(found: list[Block], first: list[bool | None]) -> list[bool]:
    """Pass 2: ambiguous blocks take the label of the nearest decided block."""
    n = len(found)
    before, after = _before(found, first, range(n)), _before(found, first, range(n - 1, -1, -1))
    labels = []
    for b, label, p, q in zip(found, first, before, after):
        if label is not None:
            labels.append(label)
        elif p is None and q is None:
            labels.append(bool(b.container))
        elif b.heading and q is not None and first[q[1]]:
            labels.append(True)
        elif p is not None and q is not None and p[0] == q[0]:
            labels.append(bool(first[p[1]] and first[q[1]]) or bool(b.container))
        else:
            labels.append(bool(first[min(x for x in (p, q) if x is not None)[1]]))
    return labels


def main_text(page: str | None) -> str:
    """Kept blocks in page order, one line each."""
    found = blocks(page) if page else []
    return "\n".join(b.text for b, keep in zip(found, _inherit(found, _decide(found))) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        ids, urls, texts, size = [], [], [], 0
        for page_id, url, html in zip(column(batch, "page_id"), column(batch, "url"), column(batch, "html")):
            text = main_text(html.as_py())
            ids.append(page_id.as_py())
            urls.append(url.as_py())
            texts.append(text)
            size += len(text)
            if size >= SLICE:
                yield batch_of(ids, urls, texts)
                ids, urls, texts, size = [], [], [], 0
        if ids:
            yield batch_of(ids, urls, texts)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return named.mapInArrow(_extract, schema_of("page_id long, url string, text string, n_chars long"))
