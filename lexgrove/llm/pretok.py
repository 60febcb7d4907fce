"""Pre-tokens of byte-level BPE, found with array operations on whole batches.

Splits as the public pattern of the rank files does:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa

from . import bytesops as B

#: Where the vocabulary's ranks are; a parameter of every operator, never copied here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@cache
def _classes() -> np.ndarray:
    """Class of each code point, as the tokenizer's own regular expressions see it."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1]) + 1
            out[a:b] = kind
    out[0xD800:0xE000] = OTHER
    return out


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the pre-tokens, in order, and how many each row has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    lead = (data & 0xC0) != 0x80
    ascii_only = bool(lead.all())
    if ascii_only:
        points, first = data, None
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.flatnonzero(lead)
    kind = _classes()[points]
    m = len(kind)
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    begin = np.zeros(m, bool)
    begin[row_starts if ascii_only else np.searchsorted(first, row_starts)] = True
    end = np.r_[begin[1:], True]  # last of its row
    new = begin.copy()
    new[1:] |= kind[1:] != kind[:-1]  # first of a run
    space = kind == SPACE
    # the last space character of a run that doesn't end its row is a token, or goes before the next token if it is U+0020
    last = space & np.r_[new[1:], True] & ~end
    joins = last & (points == 32)
    cut = new | last
    cut[1:] &= ~joins[:-1] | begin[1:]
    # contractions: an apostrophe that begins a token, and the letters after it
    quote = np.flatnonzero(cut & (points == 39))
    if len(quote):
        own = np.cumsum(begin)
        for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            k = len(tail)
            q = quote[quote + k < m]
            ok = own[q + k] == own[q]
            for j, c in enumerate(tail):
                ok &= points[q + 1 + j] == c
            q = q[ok]
            cut[q + 1] = False
            for j in range(1, k):
                cut[q + 1 + j] = False
            after = q + k + 1
            after = after[after < m]
            cut[after] = True
            # what follows a contraction starts anew, but for a U+0020 that keeps its own cut
    at = np.flatnonzero(cut)
    if not ascii_only:
        at = first[at]
    return at, np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


def distinct(data: np.ndarray, at: np.ndarray, hashes: np.ndarray | None = None, by_count: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The distinct pre-tokens (binary), if asked the most frequent first, and the number of each place's."""
    ends = np.r_[at[1:], len(data)]
    h = B.hash_spans(data, at, ends) if hashes is None else hashes
    number = pa.array(h).dictionary_encode().indices.to_numpy()
    count = np.bincount(number)
    some = np.empty(len(count), np.int64)
    some[number] = np.arange(len(number))
    if by_count:
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        number, some = rank[number], some[order]
    return take_spans(data, at[some], ends[some]), number


def spans_index(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all spans one after another, and the bounds of each."""
    length = hi - lo
    bounds = np.r_[0, np.cumsum(length)]
    return np.arange(bounds[-1]) + np.repeat(lo - bounds[:-1], length), bounds


def take_spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    index, bounds = spans_index(lo, hi)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))])


class Vocabulary:
    """Merge ranks: pieces to ids by tiktoken, ids to bytes by arrays."""

    def __init__(self, path: str = RANKS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        items = sorted((i, t) for t, i in ranks.items())
        self.size = items[-1][0] + 1
        length = np.zeros(self.size, np.int64)
        for i, t in items:
            length[i] = len(t)
        self.bounds = np.r_[0, np.cumsum(length)]
        self.bytes = np.frombuffer(b"".join(t for _, t in items), np.uint8)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another and each piece's bounds."""
        one, many = self.ranks.get, self.coder._encode_single_piece
        ids: list[int] = []
        length = []
        for p in pieces:
            i = one(p)
            if i is None:
                x = many(p)
                ids += x
                length.append(len(x))
            else:
                ids.append(i)
                length.append(1)
        return np.array(ids, np.int32), np.r_[0, np.cumsum(length, dtype=np.int64)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another and each id's bounds: a join with the token-byte table."""
        index, bounds = spans_index(self.bounds[ids], self.bounds[ids + 1])
        return self.bytes[index], bounds


@cache
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(path)


def encode_rows(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows one after another and each row's bounds; each distinct pre-token is encoded once."""
    at, many = starts(data, offsets)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    pieces, number = distinct(data, at)
    ids, bounds = vocab.encode(pieces.to_pylist())
    index, own = spans_index(bounds[number], bounds[number + 1])
    row = np.r_[0, np.cumsum(many)]
    return ids[index], own[row]
