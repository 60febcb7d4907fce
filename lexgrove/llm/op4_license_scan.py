"""Licence scans by patience alignment with templates.

Texts and templates are sequences of words.  A window of a text is aligned with a
template so: words that occur once in both are anchors; the longest increasing
subsequence of anchors is kept; the gaps between them, after equal ends are
matched, are aligned in the same way.  The share of the template's words that is
matched is the coverage; from ``least`` on it is reported.

Windows come from cue words: as many of a template's words, the longest first,
that no part with the least coverage can be without all of them.  So texts
without a cue are passed over without loss.  Windows as long as the template and a
quarter more come first.  In what is left of the text between the occurrences found, the
length of the longest common subsequence, which no alignment exceeds, says whether there
can be another one, with an insertion of any length; if so, the shortest run of words
that reaches the least coverage, ended at the first word where it can, is aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import frugal, table, whole_id
from .licenses import TEMPLATES

LEAST = 0.9
SCHEMA = "doc_id long, license string, coverage double, anchors int, begin_word int, end_word int"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second numbers rise; the first ones do."""
    ends: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(ends, y)
        back.append(piles[at - 1] if at else -1)
        if at == len(ends):
            ends.append(y)
            piles.append(k)
        else:
            ends[at], piles[at] = y, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> tuple[list[tuple[int, int]], int]:
    """(matched places, number of anchors at the first level)."""
    out: list[tuple[int, int]] = []
    first = -1
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        top = first < 0
        if not top:
            while alo < ahi and blo < bhi and a[alo] == b[blo]:
                out.append((alo, blo))
                alo, blo = alo + 1, blo + 1
            while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
                ahi, bhi = ahi - 1, bhi - 1
                out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            first = max(first, 0)
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {w: k for k, w in enumerate(b[blo:bhi], blo) if cb[w] == 1}
        found = increasing([(k, place[w]) for k, w in enumerate(a[alo:ahi], alo) if ca[w] == 1 and w in place])
        if top:
            first = len(found)
        if not found:
            if top:
                stack.append((alo, ahi, blo, bhi))
            continue
        x, y = alo, blo
        for p, q in found:
            stack.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        stack.append((x, ahi, y, bhi))
    return sorted(out), first


class Template:
    def __init__(self, name: str, text: str, least: float):
        data, off = B.buffers(pa.array([text]))
        h, starts, ends, _ = B.words(data, off)
        self.name, self.words = name, h.tolist()
        size = (ends - starts).tolist()
        count = self.count = Counter(self.words)
        self.bits: dict[int, int] = {}
        self.back: dict[int, int] = {}
        for k, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << k
            self.back[w] = self.back.get(w, 0) | 1 << (len(self.words) - 1 - k)
        spare = len(self.words) - int(np.ceil(least * len(self.words) - 1e-9))
        self.cues: dict[int, int] = {}
        covered = 0
        for k in sorted(range(len(self.words)), key=lambda k: (-size[k], k)):
            if self.words[k] not in self.cues:
                self.cues[self.words[k]] = k
                covered += count[self.words[k]]
                if covered > spare:
                    break
        self.places = {w: [k for k, v in enumerate(self.words) if v == w] for w in self.cues}


def _reaches(words: Sequence[int], bits: Mapping[int, int], m: int, need: int, at: range) -> int:
    """The first place, in the order of ``at``, by which the words have a common subsequence of ``need`` words with the template, or -1.

    One step a word, on a bit vector of the template's length.
    """
    full = (1 << m) - 1
    v = full
    for k in at:
        x = bits.get(words[k])
        if x is not None:
            u = v & x
            v = ((v + u) | (v - u)) & full
            if m - v.bit_count() >= need:
                return k
    return -1


def _scattered(words: Sequence[int], lo: int, hi: int, t: Template, need: int) -> Iterator[tuple[float, int, int, int]]:
    """Occurrences with long insertions among the words from lo to hi."""
    m = len(t.words)
    while hi - lo >= need:
        end = _reaches(words, t.bits, m, need, range(lo, hi))
        if end < 0:
            return
        begin = _reaches(words, t.back, m, need, range(end, lo - 1, -1))
        stop = min(hi, end + 1 + m - need)
        start = max(lo, begin - m + need)
        pairs, anchors = align(words[start:stop], t.words)
        if len(pairs) < need:  # the words around may hide the anchors
            start, stop = begin, end + 1
            pairs, anchors = align(words[start:stop], t.words)
        if len(pairs) >= need:
            begin, end = start + pairs[0][0], start + pairs[-1][0]
        # if repeated words keep the anchors from it, the common subsequence itself is the alignment
        yield max(len(pairs), need) / m, anchors, begin, end + 1
        lo = end + 1


def matches(words: Sequence[int], hits: Sequence[int], templates: list[Template], least: float) -> list[tuple[str, float, int, int, int]]:
    """(licence, coverage, anchors, first word, word after the last) in one text; hits: places of cue words of any template."""
    out = []
    for t in templates:
        m, done, found = len(t.words), -1, []
        need = int(np.ceil(least * m - 1e-9))
        own = [p for p in hits if words[p] in t.cues]
        for p in own:
            if p <= done:
                continue
            best: tuple[float, int, int, int] | None = None
            for q in t.places[words[p]]:
                slack = max(2, m // 4)
                lo, hi = max(0, done + 1, p - q - slack), min(len(words), p - q + m + slack)
                part = words[lo:hi]
                # no alignment matches more than the common words, counted
                if sum((Counter(part) & t.count).values()) < need:
                    continue
                pairs, anchors = align(part, t.words)
                if len(pairs) >= need and (best is None or len(pairs) / m > best[0]):
                    best = (len(pairs) / m, anchors, lo + pairs[0][0], lo + pairs[-1][0] + 1)
            if best:
                found.append(best)
                done = best[3] - 1
        edges = [0, *(x for f in found for x in f[2:]), len(words)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            if any(lo <= p < hi for p in own):
                found += _scattered(words, lo, hi, t, need)
        out += [(t.name, *f) for f in sorted(found, key=lambda f: f[2])]
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, coverage, anchors, begin_word and end_word of every occurrence of a template.

    Words are runs of letters, digits and non-ASCII characters, without case,
    counted from 0.  Occurrences of one template don't overlap; those of several
    may.  Words of other text may stand between a template's words, however many.
    Null and empty texts and empty tables give no row; repeated rows give repeated results; a
    doc_id that is null or no whole number is null.  Only doc_id and text are read; nothing is shuffled.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    given = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t for t in (Template(n, x, least) for n, x in given.items()) if t.words]
        cues = np.array(sorted({w for t in known for w in t.cues}), np.uint64)
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            ids, rows = batch.column(0), []
            for a, b in B.pieces(off):
                h, _, _, row = B.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if not len(h) or not len(cues):
                    continue
                at = np.searchsorted(cues, h)
                hit = np.flatnonzero(cues[np.minimum(at, len(cues) - 1)] == h)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                for r in np.unique(row[hit]):
                    lo, hi = bounds[r], bounds[r + 1]
                    own = hit[np.searchsorted(hit, lo) : np.searchsorted(hit, hi)] - lo
                    rows += [(ids[int(a + r)].as_py(), *x) for x in matches(h[lo:hi].tolist(), own.tolist(), known, least)]
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "license", "coverage", "anchors", "begin_word", "end_word"])

    return docs.select(whole_id().alias("doc_id"), "text").where("text is not null").mapInArrow(frugal(run), SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
SQL: dict[str, str] = {}
