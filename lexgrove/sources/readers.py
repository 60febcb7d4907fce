"""Readers that are kept: snapshots by version, and stored indexes by strategy."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgument, StorageError
from .files import Files

if TYPE_CHECKING:
    from .store import DocumentStore, Snapshot

V = TypeVar("V")


class Kept(Generic[V]):
    """The values used last, by key; ``dropped`` is told of those that have to go."""

    def __init__(self, most: int, dropped: Callable[[V], None] = lambda _: None):
        self.most, self.dropped, self.hits, self.misses = most, dropped, 0, 0
        self.values: OrderedDict[object, V] = OrderedDict()

    def get(self, key: object, make: Callable[[], V]) -> V:
        if key in self.values:
            self.values.move_to_end(key)
            self.hits += 1
            return self.values[key]
        self.misses += 1
        value = make()
        if self.most:
            self.values[key] = value
            while len(self.values) > self.most:
                self.dropped(self.values.popitem(last=False)[1])
        return value

    def invalidate(self, key: object) -> bool:
        value = self.values.pop(key, None)
        if value is not None:
            self.dropped(value)
        return value is not None

    def clear(self) -> None:
        for key in list(self.values):
            self.invalidate(key)

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.values), "hits": self.hits, "misses": self.misses}


class ReaderPool:
    """Snapshots of versions, the ``most`` used last.

    A segment whose folder is missing makes a reader fail, or is left out and counted
    with ``skip_missing``.
    """

    def __init__(self, store: DocumentStore, most: int = 10, skip_missing: bool = False):
        self.store, self.skip_missing, self.failures = store, skip_missing, 0
        self.kept: Kept[Snapshot] = Kept(most)

    def reader(self, version: int | None = None) -> Snapshot:
        version = self.store.versions()[-1] if version is None else version
        return self.kept.get(version, lambda: self._open(version))

    def _open(self, version: int) -> Snapshot:
        from dataclasses import replace

        snapshot = self.store.snapshot(version)
        missing = [s for s in snapshot.manifest.segments if not self.store.files.exists(f"docs/{s.id}")]
        if missing and not self.skip_missing:
            raise StorageError(f"segments {[s.id for s in missing]} are missing")
        self.failures += len(missing)
        if missing:
            snapshot.manifest = replace(snapshot.manifest, segments=tuple(s for s in snapshot.manifest.segments if s not in missing))
        return snapshot


PARTS = {
    "postings": "field string, term string, doc_id long, tf long, positions array<int>, field_norm double",
    "dictionary": "field string, term string, doc_freq long, total_freq long, idf double",
    "lengths": "doc_id long, field string, dl long",
}


@dataclass
class IndexParts:
    postings: DataFrame
    dictionary: DataFrame
    lengths: DataFrame
    strategy: str

    def close(self) -> None:
        for part in (self.postings, self.dictionary, self.lengths):
            part.unpersist()


class IndexReader:
    """A stored index's parts.

    "eager" keeps them in the executors' memory and on their disks once read, "lazy" reads the row groups of
    the terms that a query has, "adaptive" is eager below ``eager_below`` bytes.  A part
    that isn't there is empty.
    """

    def __init__(self, spark: SparkSession, files: Files, strategy: str = "adaptive", eager_below: int = 50 << 20, most: int = 10):
        if strategy not in ("eager", "lazy", "adaptive"):
            raise InvalidArgument(f"no way of reading an index is {strategy!r}")
        self.spark, self.files, self.strategy, self.eager_below = spark, files, strategy, eager_below
        self.kept: Kept[IndexParts] = Kept(most, IndexParts.close)

    def load(self, base: str, strategy: str | None = None) -> IndexParts:
        """The parts in a folder; those loaded last are kept."""
        return self.kept.get((base, strategy or self.strategy), lambda: self._open(base, strategy or self.strategy))

    def _open(self, base: str, strategy: str) -> IndexParts:
        if strategy == "adaptive":
            small = self.files.exists(base) and self.files.size(base) < self.eager_below
            strategy = "eager" if small or not self.files.exists(base) else "lazy"
        parts = []
        for name, schema in PARTS.items():
            there = self.files.exists(f"{base}/{name}")
            df = self.spark.read.schema(schema).parquet(self.files.at(f"{base}/{name}")) if there else self.spark.createDataFrame([], schema)
            parts.append(df.persist() if strategy == "eager" and there else df)
        return IndexParts(*parts, strategy)
