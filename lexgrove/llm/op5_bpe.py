"""Byte-level BPE over a global shuffle of distinct words, and its inverse.

Encoding:

1. Each run of documents of a few megabytes (a *chunk*) is exploded into pre-tokens with
   their positions.  Positions are held as numbers of the chunk's distinct
   words, which stand for the (word, position) rows without repeating a word.
2. The chunks' distinct words are shuffled by the word's hash; where equal words
   meet, each is encoded once for all the corpus.
3. The ids are joined back to their chunks, where the positions put each
   document's ids together.

A task holds one batch of rows and the distinct words of its bucket, not their
occurrences in all chunks.

Decoding joins the ids with the token-byte table, a table of the vocabulary's
fixed size, and joins each document's bytes in order.

Rows move in packed binary form: one row per chunk and word bucket, not per word.
The steps from documents to chunks run twice, once for the words and once for the
positions; a chunk's name is a digest of what is in it, so if rows came in another
order the second time, the join would find no words, and the job stops rather
than return other ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from . import pretok as P
from .common import by_key, frugal, table, whole_id

#: Bytes of text in a chunk; one document may be longer.
CHUNK = 8 << 20
_NAMES = ["key", "chunk", "kind", "a", "b", "c"]
_PACKED = "key long, chunk long, kind int, a binary, b binary, c binary"


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _expand(x: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack(x: np.ndarray, kind: type) -> bytes:
    return np.array([len(x)], np.int64).tobytes() + _squeeze(np.ascontiguousarray(x, kind))


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return _expand(x[8:], kind, int(np.frombuffer(x[:8], np.int64)[0]))


def _varint(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**28 in one to four bytes, seven bits each, low bits first."""
    length = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    at = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    for k in range(4):
        has = length > k
        more = length[has] > k + 1
        out[at[has] + k] = ((x[has] >> (7 * k)) & 127) | (more.astype(np.uint8) << 7)
    return out


def _from_varint(b: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(b < 128)
    first = np.r_[0, ends[:-1] + 1]
    length = ends - first + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = length > k
        out[has] |= (b[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(name, doc ids, bytes, offsets, distinct words, numbers of all positions, positions of each row)."""
    for batch in batches:
        whole, offsets = B.buffers(batch.column(1))
        for lo, hi in B.pieces(offsets, CHUNK):
            data, off = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            pieces, hashes, many = [], [], []
            for a, b in B.pieces(off):
                part = data[off[a] : off[b]]
                at, m = P.starts(part, off[a : b + 1] - off[a])
                hashes.append(B.hash_spans(part, at, np.r_[at[1:], len(part)][: len(at)]))
                pieces.append(at + off[a])
                many.append(m)
            at, many = np.concatenate(pieces), np.concatenate(many)
            words, number = P.distinct(data, at, np.concatenate(hashes), by_count=True) if len(at) else (pa.array([], pa.binary()), np.zeros(0, np.int32))
            ids = batch.column(0).slice(lo, hi - lo)
            name = hashlib.blake2b(data, digest_size=8)
            name.update(np.ascontiguousarray(off))
            name.update(repr(ids.to_pylist()).encode())
            yield int.from_bytes(name.digest(), "little", signed=True), ids, data, off, words, number, many


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, words, _, _ in _chunks(batches):
            data, off = B.buffers(words)
            h = (B.hash_spans(data, off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(h, kind="stable")
            cuts = np.searchsorted(h[order], np.arange(buckets + 1))
            keys, local, length, text = [], [], [], []
            for k in range(buckets):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    index, bounds = P.spans_index(off[own], off[own + 1])
                    keys.append(k)
                    local.append(_pack(np.diff(own, prepend=0), np.int32))
                    length.append(_pack(np.diff(bounds), np.int32))
                    text.append(_pack(data[index], np.uint8))
            n = len(keys)
            if n:
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([name] * n, pa.int64()), pa.array([0] * n, pa.int32()), *(pa.array(x, pa.binary()) for x in (local, length, text))], _NAMES)

    return run


class _Words:
    """The words of a bucket that have been met, each encoded once."""

    def __init__(self, vocab: P.Vocabulary):
        self.vocab, self.known = vocab, {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            ids, bounds = self.vocab.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids, self.bounds = np.concatenate([self.ids, ids]), np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _encode(path: str):
    """Where a bucket's words of all chunks meet, batch by batch: each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = P.vocabulary(path)
        bucket, met = None, _Words(vocab)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a in range(0, batch.num_rows, 256):
                cuts = a + np.flatnonzero(np.r_[True, keys[a + 1 : a + 256] != keys[a : a + 255][: len(keys[a + 1 : a + 256])], True])
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if keys[lo] != bucket:
                        bucket, met = keys[lo], _Words(vocab)
                    part = batch.slice(lo, hi - lo)
                    lengths = [_unpack(x.as_py(), np.int32) for x in part.column(4)]
                    data = np.concatenate([_unpack(x.as_py(), np.uint8) for x in part.column(5)])
                    ends = np.cumsum(np.concatenate(lengths), dtype=np.int64)
                    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(data)]).dictionary_encode()
                    number = met.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
                    at, many, flat = 0, [], []
                    for x in lengths:
                        own = number[at : at + len(x)]
                        at += len(x)
                        index, b = P.spans_index(met.bounds[own], met.bounds[own + 1])
                        many.append(_pack(np.diff(b), np.int32))
                        flat.append(_pack(met.ids[index], np.int32))
                    chunk = part.column(1)
                    yield pa.record_batch([chunk, chunk, pa.array([0] * (hi - lo), pa.int32()), part.column(3), pa.array(many, pa.binary()), pa.array(flat, pa.binary())], _NAMES)

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents: ids, positions and a check sum of each text."""
    for name, ids, data, off, _, number, many in _chunks(batches):
        raw = data.tobytes()
        sums = np.array([zlib.crc32(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint32)
        known = np.array([x is not None for x in ids.to_pylist()], np.int64)
        doc = np.array([0 if x is None else x for x in ids.to_pylist()], np.int64)
        yield pa.record_batch([pa.array([name] * 1, pa.int64()), pa.array([name], pa.int64()), pa.array([1], pa.int32()), pa.array([_pack(np.r_[doc, known, many, np.diff(off)], np.int64)], pa.binary()), pa.array([_pack(_varint(number), np.uint8)], pa.binary()), pa.array([sums.tobytes()], pa.binary())], _NAMES)


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = P.vocabulary(path)
        for tab in by_key(batches, "key"):
            keys = tab["key"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = tab.slice(lo, hi - lo)
                kind = part["kind"].to_numpy()
                words, docs = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
                a, b, c = (part[x].to_pylist() for x in "abc")
                local = [np.cumsum(_unpack(a[k], np.int32)) for k in words]
                length = [_unpack(b[k], np.int32) for k in words]
                flat = np.concatenate([_unpack(c[k], np.int32) for k in words]) if len(words) else np.zeros(0, np.int32)
                local, length = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (local, length))
                n = int(local.max()) + 1 if len(local) else 0
                start, size = np.zeros(n, np.int64), np.full(n, -1, np.int64)
                start[local], size[local] = np.cumsum(length) - length, length
                if not len(docs):
                    raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
                for k in docs:
                    doc, known, many, n_bytes = _unpack(a[k], np.int64).reshape(4, -1)
                    number = _from_varint(_unpack(b[k], np.uint8))
                    if len(number) and (number.max() >= n or (size < 0).any()):
                        raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
                    sums, at = np.frombuffer(c[k], np.uint32), np.r_[0, np.cumsum(many)]
                    for x in range(0, len(doc), 1024):
                        y = min(len(doc), x + 1024)
                        own = number[at[x] : at[y]]
                        index, bounds = P.spans_index(start[own], start[own] + size[own])
                        ids, cut = flat[index], bounds[at[x : y + 1] - at[x]]
                        raw, token = vocab.decode(ids)
                        back = raw.tobytes()
                        cut_bytes = token[cut]
                        same = [q - p == m and zlib.crc32(back[p:q]) == s for p, q, m, s in zip(cut_bytes[:-1], cut_bytes[1:], n_bytes[x:y], sums[x:y], strict=True)]
                        yield pa.record_batch([pa.array(doc[x:y], mask=known[x:y] == 0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids)), pa.array(np.diff(cut)), pa.array(n_bytes[x:y]), pa.array(same)], ["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"])

    return run


def encode(docs: DataFrame, ranks: str = P.RANKS, buckets: int | None = None) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_bytes and round_trip for every row with a text.

    The ids are those of the merge ranks' own tokenizer; special tokens' strings
    are ordinary text.  ``round_trip`` says whether decoding the ids gave the
    text's length and CRC-32 back.  Empty texts have no ids.  Rows with a null text
    are left out; a null doc_id stays null, repeated rows are repeated.  Only
    doc_id and text are read.  ``buckets``, by default the session's shuffle
    partitions, says into how many parts the distinct words are shuffled.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(whole_id().alias("doc_id"), "text").where("text is not null")
    words = source.mapInArrow(frugal(_words(buckets)), _PACKED)
    ids = words.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(frugal(_encode(ranks)), _PACKED)
    packed = ids.unionByName(source.mapInArrow(frugal(_positions), _PACKED))
    out = packed.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(frugal(_assemble(ranks)), "doc_id long, token_ids array<int>, n_tokens long, n_bytes long, round_trip boolean")
    return out


def token_bytes(spark: SparkSession, ranks: str = P.RANKS) -> DataFrame:
    """The token-byte table: token_id and bytes of every token of the vocabulary; it has no nulls and no repeated rows."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in P.vocabulary(ranks).ranks.items()], "token_id int, bytes binary")


def decode(encoded: DataFrame, ranks: str = P.RANKS) -> DataFrame:
    """doc_id and text of rows with token_ids.

    The token-byte table, of the vocabulary's fixed size, is broadcast and joined by id where
    the documents are, a batch of ids at once; nothing is shuffled.  Bytes that aren't UTF-8 become
    U+FFFD; null ids give a null text; an id outside the vocabulary raises.  A doc_id that is no whole number is
    null; repeated rows are repeated; other columns aren't read; an empty table gives no row.
    """
    spark = encoded.sparkSession
    known = token_bytes(spark, ranks).orderBy("token_id").collect()  # as large as the vocabulary
    index = np.full(known[-1].token_id + 2, -1, np.int64)
    index[[r.token_id for r in known]] = np.arange(len(known))
    joined = spark.sparkContext.broadcast((index, np.r_[0, np.cumsum([len(r.bytes) for r in known])], b"".join(bytes(r.bytes) for r in known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bounds, raw = joined.value
        raw = np.frombuffer(raw, np.uint8)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                col = part.column(1)
                ids = col.flatten().to_numpy(zero_copy_only=False)
                row = index[np.clip(np.nan_to_num(ids, nan=-1), -1, len(index) - 1).astype(np.int64)]
                if len(row) and row.min() < 0:
                    raise ValueError("a token id is outside the vocabulary")
                many = np.array([len(x) if x is not None else 0 for x in col.to_pylist()], np.int64)
                at, own = P.spans_index(bounds[row], bounds[row + 1])
                back, cut = raw[at].tobytes(), own[np.r_[0, np.cumsum(many)]]
                texts = [None if not ok else back[p:q].decode("utf-8", "replace") for p, q, ok in zip(cut[:-1], cut[1:], col.is_valid().to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(whole_id().alias("doc_id"), F.col("token_ids").cast("array<int>")).mapInArrow(frugal(run), "doc_id long, text string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
SQL: dict[str, str] = {}
