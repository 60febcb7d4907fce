"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each
block by its length, the density of stop words and the density of linked text:
*good*, *near good*, *short* or *bad*.  In the second pass short and near good
blocks, which are ambiguous, inherit the label of the nearest good or bad blocks
before and after them.  The good blocks are the page's text.

Stop words are a parameter, lists by language; four are given.  A page that declares another
language, or of whose long blocks most words aren't in Latin letters where no list has such
words either, is judged by length and links alone.
A page is read once from left to right, however broken its tags are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, whole_id

#: Characters of a short and of a long block; stop word densities of near good and good blocks; most linked share.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKED = 70, 200, 0.08, 0.18, 0.2
SCHEMA = "page_id long, url string, n_blocks int, n_good int, text string"

STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more most my no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur ob oder sich sie sind so um und uns unter von vor war was wenn wer wie wir zu zum zur über",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui ma mais me même mes mon ne nos notre nous on ont ou par pas pour plus qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y été être",
    "es": "a al algo ante como con de del desde donde el ella en entre era es esa ese eso esta este esto fue ha hasta la las le les lo los me mi más muy no nos o para pero por porque que qué se si sin sobre son su sus también te tiene tu un una uno y ya",
}
_STOPS = {k: frozenset(x.split()) for k, x in STOP_WORDS.items()}
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SKIPPED = frozenset("script style noscript template textarea iframe svg".split())
IN_HEAD = frozenset("head title".split())
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)
_NAME = re.compile(r"/?([a-zA-Z][\w:-]*+)")
_INSIDE = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
_ENDS = {x: re.compile(rf"</{x}\s*+>", re.I) for x in SKIPPED}
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    label: str = ""


def _pieces(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """(text, None, False) or ("", tag in lower case, whether it ends), without comments and skipped elements.

    A tag ends at the first ``>`` outside quotes.  Where quotes don't close, tags up to
    there end at their first ``>``; a ``<`` with no ``>`` behind it is text.  So no part is
    searched more than a fixed number of times.
    """
    at, n, broken, last = 0, len(page), 0, page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield page[at : lt if lt >= 0 else n], None, False
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            to = page.find("-->", lt + 4)
            if to < 0:
                return
            at = to + 3
            continue
        name = _NAME.match(page, lt + 1)
        if lt > last or (name is None and page[lt + 1 : lt + 2] not in ("!", "?", "/")):
            yield "<", None, False
            at = lt + 1
            continue
        if name is None:
            at = page.find(">", lt) + 1
            continue
        to = -1
        if lt >= broken:
            to = _INSIDE.match(page, name.end()).end()
            if to >= n or page[to] != ">":
                broken, to = to, -1
        at = (to if to >= 0 else page.find(">", name.end())) + 1
        tag, ends = name[1].lower(), page[lt + 1] == "/"
        if tag in SKIPPED and not ends:
            m = _ENDS[tag].search(page, at)
            if m is None:
                return
            at = m.end()
            continue
        yield "", tag, ends


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    text: list[str] = []
    linked, link, heading = 0, 0, 0

    def close() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(Block(whole, linked, heading > 0))
        text.clear()
        linked = 0

    head = False
    for piece, tag, ends in _pieces(page):
        if tag is None:
            if not head:
                text.append(piece)
                if link:
                    linked += len("".join(html.unescape(piece).split()))
            continue
        if tag == "head":
            head = not ends
        elif tag == "body" or (tag in BLOCK_TAGS and tag not in IN_HEAD):
            head = False  # the end tag of a head may be left out
        if tag in BLOCK_TAGS:
            close()
            if tag in HEADINGS:
                heading = max(0, heading + (-1 if ends else 1))
            if tag not in HEADINGS and not ends:
                heading = 0
            link = 0 if ends else link
        elif tag == "a":
            link = max(0, link - 1) if ends else 1
        elif tag == "br":
            text.append("\n")
    close()
    return out


def _density(words: list[str], stops: Sequence[frozenset[str]]) -> float:
    return max((sum(w in s for w in words) for s in stops), default=0) / max(len(words), 1)


def first_pass(b: Block, stops: Sequence[frozenset[str]] = tuple(_STOPS.values()), foreign: bool = False) -> str:
    n = len(b.text)
    if b.linked > LINKED * len("".join(b.text.split())) or "©" in b.text:
        return "bad"
    if n < SHORT:
        return "bad" if b.linked else "short"
    if foreign:
        return "good" if n > LONG else "near good"
    density = _density([w.lower() for w in _WORD.findall(b.text)], stops)
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near good"
    return "near good" if density >= STOP_LOW else "bad"


def second_pass(labels: list[str], headings: list[bool]) -> list[str]:
    """Labels of ambiguous blocks from the nearest decided ones.

    Where those before and behind differ, the nearer one counts; at equal distance
    a near good block and a heading are good, a short block bad.  Without any
    decided block near good ones are good, short ones bad.
    """
    n = len(labels)
    before: list[int] = []
    last = -1
    for k, x in enumerate(labels):
        before.append(last)
        last = k if x in ("good", "bad") else last
    after = [0] * n
    last = -1
    for k in range(n - 1, -1, -1):
        after[k] = last
        last = k if labels[k] in ("good", "bad") else last
    out = []
    for k, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x)
            continue
        p, q = before[k], after[k]
        lean = "good" if x == "near good" or headings[k] else "bad"
        if p < 0 and q < 0:
            out.append("good" if x == "near good" else "bad")
        elif p < 0 or q < 0:
            out.append(labels[max(p, q)])
        elif labels[p] == labels[q]:
            out.append(labels[p])
        elif k - p == q - k:
            out.append(lean)
        else:
            out.append(labels[p] if k - p < q - k else labels[q])
    return out


def foreign(page: str, found: list[Block], languages: Collection[str], stops: Sequence[frozenset[str]]) -> bool:
    """Whether a page is in a language that has no stop words."""
    at = page.find("<html")
    declared = _LANG.search(page[at : page.find(">", at) + 1]) if at >= 0 else None
    if declared:
        return declared[1].lower() not in languages
    words = [w.lower() for b in found if len(b.text) >= SHORT for w in _WORD.findall(b.text)]
    other = sum(any(c.isalpha() and ord(c) > 0x24F for c in w) for w in words)
    return 2 * other > len(words) and _density(words, stops) < STOP_LOW


def extract(page: str, stop_words: Mapping[str, frozenset[str]] = _STOPS) -> tuple[int, int, str]:
    """Blocks, good blocks and the text, a line for each good block."""
    found, stops = blocks(page), list(stop_words.values())
    other = foreign(page, found, stop_words, stops)
    labels = second_pass([first_pass(b, stops, other) for b in found], [b.heading for b in found])
    good = [b.text for b, x in zip(found, labels, strict=True) if x == "good"]
    return len(found), len(good), "\n".join(good)


def main_text(pages: DataFrame, stop_words: Mapping[str, str] = STOP_WORDS) -> DataFrame:
    """page_id, url, n_blocks, n_good and text of every page; no shuffle.

    A null html gives a null text and no blocks, an empty one an empty text.
    Repeated rows are repeated; null ids and urls stay null, an id that is no whole number is null. Other columns aren't
    read; an empty table gives no row.
    """
    stops = {k: frozenset(x.split()) for k, x in stop_words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = [(0, 0, None) if x is None else extract(x, stops) for x in part.column(2).to_pylist()]
                n, good, text = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(good, pa.int32()), pa.array(text, pa.string())], ["page_id", "url", "n_blocks", "n_good", "text"])

    return pages.select(whole_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(frugal(run), SCHEMA)


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_blocks": op2_html_blocks}
SQL: dict[str, str] = {}
