"""Reading and writing handles over one index; executors do the scaling out."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame

from .errors import InvalidArgument
from .plans.ast import Node
from .search_index import SearchIndex
from .sources.store import Manifest


class ReadHandle:
    def __init__(self, index: SearchIndex):
        self._index = index

    def search(self, q: str | Node, limit: int = 10, **options) -> DataFrame:
        return self._index.search(q, limit, **options)

    def stats(self) -> dict:
        return self._index.stats()


class WriteHandle:
    def __init__(self, index: SearchIndex):
        self._index = index

    def add(self, df: DataFrame) -> Manifest:
        return self._index.add(df)

    def delete(self, ids: DataFrame) -> Manifest:
        return self._index.delete(ids)

    def commit(self) -> Manifest:
        return self._index.commit()


class RoundRobin:
    """Takes readers in turn."""

    def __init__(self, readers: Sequence[ReadHandle]):
        if not readers:
            raise InvalidArgument("there are no readers to choose from")
        self._readers, self._turn = list(readers), count()

    def next(self) -> ReadHandle:
        return self._readers[next(self._turn) % len(self._readers)]


class Cluster:
    """One writer and several readers of an index."""

    def __init__(self, index: SearchIndex, replicas: int = 1):
        self.writer = WriteHandle(index)
        self.readers = RoundRobin([ReadHandle(index) for _ in range(replicas)])

    def search(self, q: str | Node, limit: int = 10, **options) -> DataFrame:
        return self.readers.next().search(q, limit, **options)
