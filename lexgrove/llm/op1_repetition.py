"""Quality rules on repetition inside a document, from a suffix array.

Of each document's words, the suffixes whose first ``least`` words occur again in
the document are sorted into a suffix array by prefix doubling; all documents of
an Arrow batch are sorted together.  The longest common prefixes of neighbours
give, for each suffix, the longest repeated substring that starts there (the
widest interval of the array that holds it with that prefix).  The union of these
spans is the covered part.  Words in later occurrences of a run of words, the first
left out, are there again.  A document is kept if the covered fraction, the share of
words that are there again and the longest repeat are within the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import frugal, table, whole_id

#: Words of the shortest repeat that counts; most covered share of the words; most words of a repeat.
LEAST, MOST_COVERED, MOST_REPEAT = 6, 0.85, 30
#: Words of the shortest run that counts as there again; most such share of the words.
AGAIN, MOST_AGAIN = 2, 0.5
SCHEMA = "doc_id long, n_words long, covered_fraction double, longest_repeat long, again_fraction double"


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks by several keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeats(h: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, length of the longest repeat from there) for repeats of ``least`` words or more."""
    m = len(h)
    none = np.zeros(0, np.int64)
    if m <= least:
        return none, none
    g, at, _ = B.ngrams(h, row, least)
    fits = row[np.minimum(at + least - 1, m - 1)] == row[at]
    fits &= at + least <= m
    g, at = g[fits], at[fits]
    if len(g) < 2:
        return none, none
    key = B.mix(g ^ (row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.r_[False, same] | np.r_[same, False]
    pos = np.sort(at[order[twice]])
    if not len(pos):
        return none, none
    # Suffixes to sort: these, and those just behind them, which end a repeat and settle the order of equal beginnings.
    ext = pos + least
    ext = ext[ext < m]
    ext = ext[row[ext] == row[ext - least]]
    pos = np.union1d(pos, ext)
    back = np.full(m + 1, -1, np.int64)
    back[pos] = np.arange(len(pos))
    begin = [row[pos]]
    for k in range(least):
        to = np.minimum(pos + k, m - 1)
        begin.append(np.where((pos + k < m) & (row[to] == row[pos]), h[to], np.uint64(0)))
    # ranks by the first least * 2**k words
    level = _ranks(*begin)
    levels, step = [level], least
    while True:
        to = np.minimum(pos + step, m)
        other = back[to]
        ok = (other >= 0) & (row[np.minimum(to, m - 1)] == row[pos])
        new = _ranks(level, np.where(ok, level[other], -1))
        if new.max() == level.max():
            break
        level = new
        levels.append(level)
        step *= 2
    sa = np.argsort(level, kind="stable")
    # longest common prefix of neighbours: descend the levels, then compare the last words one by one
    a, b = pos[sa[:-1]].copy(), pos[sa[1:]].copy()
    lcp = np.zeros(len(a), np.int64)
    fit = row[a] == row[b]
    for k in range(len(levels) - 1, -1, -1):
        ia, ib = back[np.minimum(a, m)], back[np.minimum(b, m)]
        eq = fit & (ia >= 0) & (ib >= 0)
        eq &= levels[k][ia] == levels[k][ib]
        a[eq] += least << k
        b[eq] += least << k
        lcp[eq] += least << k
        np.minimum(a, m, out=a)
        np.minimum(b, m, out=b)
    live = np.flatnonzero(fit & (lcp > 0))
    own = row[pos[sa[:-1]]]
    while len(live):
        x, y = a[live], b[live]
        ok = (x < m) & (y < m)
        x, y = np.minimum(x, m - 1), np.minimum(y, m - 1)
        ok &= (h[x] == h[y]) & (row[x] == own[live]) & (row[y] == own[live])
        live = live[ok]
        a[live] += 1
        b[live] += 1
        lcp[live] += 1
    best = np.zeros(len(pos), np.int64)
    best[sa[:-1]] = lcp
    best[sa[1:]] = np.maximum(best[sa[1:]], lcp)
    long = best >= least
    return pos[long], best[long]


def measure(h: np.ndarray, row: np.ndarray, n_rows: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, covered words and longest repeat of each row."""
    n_words = np.bincount(row, minlength=n_rows)
    pos, length = repeats(h, row, least)
    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, row[pos], length)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + length, -1)
    covered = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n_rows)
    return n_words, covered, longest


def repeated(h: np.ndarray, row: np.ndarray, n_rows: int, least: int = AGAIN) -> np.ndarray:
    """Words of each row in runs of ``least`` words or more that the row had before."""
    edge = np.zeros(len(h) + 1, np.int64)
    if len(h) >= least:
        g, at, of = B.ngrams(h, row, least)
        to = at + least - 1
        fits = (to < len(h)) & (row[np.minimum(to, len(h) - 1)] == of)
        g, at, of = g[fits], at[fits], of[fits]
        key = B.mix(g ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")  # the first occurrence stays first
        later = at[order[1:][key[order][1:] == key[order][:-1]]]
        np.add.at(edge, later, 1)
        np.add.at(edge, later + least, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def _run(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            for a, b in B.pieces(off):
                h, _, _, row = B.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                n, covered, longest = measure(h, row, b - a, least)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(covered / np.maximum(n, 1)), pa.array(longest, pa.int64()), pa.array(repeated(h, row, b - a) / np.maximum(n, 1))], ["doc_id", "n_words", "covered_fraction", "longest_repeat", "again_fraction"])

    return run


def scores(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, covered_fraction, longest_repeat and again_fraction of every row with a text.

    A word is a run of letters, digits and non-ASCII characters, without case.
    Empty texts, and texts without a repeat of ``least`` words, have 0 for the first two
    measures; again_fraction counts runs of AGAIN words or more.
    Rows with a null text are left out; a doc_id that is null or no whole number is null.  Repeated rows
    give repeated results.  Only doc_id and text are read.  Words are compared by 64-bit hashes
    within their document.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    return docs.select(whole_id().alias("doc_id"), "text").where("text is not null").mapInArrow(frugal(_run(least)), SCHEMA)


def _passes(most_covered: float, most_repeat: int, most_again: float = MOST_AGAIN) -> F.Column:
    return (F.col("covered_fraction") <= most_covered) & (F.col("longest_repeat") <= most_repeat) & (F.col("again_fraction") <= most_again)


def keep_rows(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT, most_again: float = MOST_AGAIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the limits; no shuffle.

    A null text has no repetition and passes, so does an empty one.  Repeated rows are
    judged alike; other columns are kept whatever their names; an empty table stays empty.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.buffers(batch.column(batch.schema.get_field_index("text")))
            for a, b in B.pieces(off, 1 << 22):
                good = np.ones(b - a, bool)
                for x, y in B.pieces(off[a : b + 1]):
                    h, _, _, row = B.words(data[off[a + x] : off[a + y]], off[a + x : a + y + 1] - off[a + x])
                    n, covered, longest = measure(h, row, y - x, least)
                    good[x:y] = (covered / np.maximum(n, 1) <= most_covered) & (longest <= most_repeat) & (repeated(h, row, y - x) / np.maximum(n, 1) <= most_again)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(frugal(run), docs.schema)


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with their measures."""
    return scores(table(spark, sf_dir, "documents")).where(_passes(MOST_COVERED, MOST_REPEAT))


QUERIES = {"op1_repetition_rules": op1_repetition_rules}
SQL: dict[str, str] = {}
