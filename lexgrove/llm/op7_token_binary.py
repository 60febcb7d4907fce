"""Token ids in binary shards with Elias-Fano encoded document boundaries.

A shard is a run of documents of one input partition: their token ids one after
another, two bytes each if the vocabulary allows, else four, little-endian.  The
documents' first places in that array, a rising sequence, are Elias-Fano encoded:
of each number the low bits in a packed array and the high bits in unary in a bit
vector, about 2 + log2(ids / documents) bits a document in all.  Places of every
64th one bit are sampled, so an offset is found by a select in the bit vector
without a table of 64-bit offsets.  Shards are made where the documents are read:
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from . import pretok as P
from .common import frugal, table, whole_id

SAMPLE = 64
#: A shard is closed once it has so many ids; a single document may be longer.
SHARD_TOKENS = 1 << 20
SCHEMA = "part int, shard int, first_doc_id long, n_docs long, n_tokens long, low_bits int, ids binary, high binary, low binary, samples binary, doc_ids array<long>"


class EliasFano:
    """A sequence of whole numbers that doesn't fall, from 0 to ``top``."""

    def __init__(self, n: int, low_bits: int, high: bytes, low: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.high, self.low = np.frombuffer(high, np.uint64), np.frombuffer(low, np.uint64)
        self.samples = np.frombuffer(samples, np.uint32)

    @staticmethod
    def build(values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        values = np.asarray(values, np.uint64)
        bits = max(0, (int(top) // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(top) >> bits) // 64 + n // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        return EliasFano(n, bits, high.tobytes(), low.tobytes(), place[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """Number i: from the sample before it, count one bits word by word, then within the word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        value = (place - i) << self.low_bits
        if self.low_bits:
            start = i * self.low_bits
            pair = int(self.low[start >> 6]) | int(self.low[(start >> 6) + 1]) << 64
            value |= pair >> (start & 63) & ((1 << self.low_bits) - 1)
        return value

    def values(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            at = np.arange(self.n, dtype=np.int64) * self.low_bits
            shift = (at & 63).astype(np.uint64)
            part = self.low[at >> 6] >> shift
            over = shift + np.uint64(self.low_bits) > 64
            part[over] |= self.low[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
            out |= (part & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out


def document(shard, k: int) -> np.ndarray:  # noqa: ANN001
    """Ids of document k of a shard row."""
    ef = EliasFano(shard["n_docs"] + 1, shard["low_bits"], shard["high"], shard["low"], shard["samples"])
    kind = np.dtype("<u2" if len(shard["ids"]) == 2 * shard["n_tokens"] else "<u4")
    return np.frombuffer(shard["ids"], kind)[ef.select(k) : ef.select(k + 1)]


def _shards(ranks: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = P.vocabulary(ranks)
        kind = "<u2" if vocab.size <= 1 << 16 else "<u4"
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        length: list[int] = []
        total = 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, kind)
            bounds = np.r_[0, np.cumsum(length)]
            ef = EliasFano.build(bounds, len(flat))
            row = {"part": part, "shard": number, "first_doc_id": docs[0], "n_docs": len(docs), "n_tokens": len(flat), "low_bits": ef.low_bits, "ids": flat.tobytes(), "high": ef.high.tobytes(), "low": ef.low.tobytes(), "samples": ef.samples.tobytes(), "doc_ids": docs}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            data, off = B.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in B.pieces(off, 1 << 22):
                flat, bounds = P.encode_rows(vocab, data[off[a] : off[b]], off[a : b + 1] - off[a])
                flat = flat.astype(kind)
                x = a
                while x < b:
                    room = bounds[x - a] + max(shard_tokens - total, 0)
                    y = a + max(int(np.searchsorted(bounds, room, "right")) - 1, x - a + (not docs))
                    y = min(y, b)
                    if y > x:
                        ids.append(flat[bounds[x - a] : bounds[y - a]])
                        docs += names[x:y]
                        length += np.diff(bounds[x - a : y - a + 1]).tolist()
                        total += int(bounds[y - a] - bounds[x - a])
                    if y < b:
                        yield shard()
                        number += 1
                        ids, docs, length, total = [], [], [], 0
                    x = y
        if docs:
            yield shard()

    return run


def shards(docs: DataFrame, ranks: str = P.RANKS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per shard: its ids, the Elias-Fano parts of its documents' bounds, and its doc_ids in order.

    Bounds are n_docs + 1 numbers, from 0 to n_tokens; ``document`` gets the ids of
    one document by two selects.  An empty text is a document of no ids.  Rows with
    a null text are left out; a null doc_id stays null in doc_ids; repeated rows are
    repeated.  Only doc_id and text are read.
    """
    if shard_tokens < 1:
        raise ValueError("a shard has one id at least")
    return docs.select(whole_id().alias("doc_id"), "text").where("text is not null").mapInArrow(frugal(_shards(ranks, shard_tokens)), SCHEMA)


def save(docs: DataFrame, path: str, ranks: str = P.RANKS, shard_tokens: int = SHARD_TOKENS, ordered: bool = False) -> None:
    """Writes shards to a folder of any file system, a Parquet row a shard; what is there is replaced.

    Columns of ids aren't compressed, so a reader maps them as they are.  Shards follow
    the input's partitions; ``ordered`` sorts documents by doc_id first, which shuffles
    the texts, so that shards don't depend on how the input was split.  Nulls and
    repeated rows are treated as in ``shards``.
    """
    if ordered:
        docs = docs.select(whole_id().alias("doc_id"), "text").orderBy("doc_id", "text")
    shards(docs, ranks, shard_tokens).write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder."""
    return spark.read.schema(SCHEMA).parquet(path)


def tokens(saved: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of each document of that number, by two selects in its shard."""
    out = []
    for r in saved.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).toLocalIterator():
        out += [document(r, k) for k, i in enumerate(r["doc_ids"]) if i == doc_id]
    return out


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_binary": op7_token_binary}
SQL: dict[str, str] = {}
