"""Query nodes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

Value = float | datetime | str


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    boost: float = 1.0


@dataclass(frozen=True)
class Term(Node):
    field: str
    value: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Node):
    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Range(Node):
    field: str
    gt: Value | None = None
    gte: Value | None = None
    lt: Value | None = None
    lte: Value | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    value: str
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Node):
    field: str
    pattern: str
    anchored: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str
    value: str
    max_edits: int = 2
    prefix_length: int = 0
    transpositions: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    filter: tuple[Node, ...] = ()
    minimum_should_match: int | None = None
    boost: float = 1.0

    def with_must(self, q: Node) -> Bool:
        return replace(self, must=(*self.must, q))

    def with_should(self, q: Node) -> Bool:
        return replace(self, should=(*self.should, q))

    def with_must_not(self, q: Node) -> Bool:
        return replace(self, must_not=(*self.must_not, q))

    def with_filter(self, q: Node) -> Bool:
        return replace(self, filter=(*self.filter, q))


def children(q: Node) -> tuple[Node, ...]:
    return (*q.must, *q.should, *q.must_not, *q.filter) if isinstance(q, Bool) else ()
