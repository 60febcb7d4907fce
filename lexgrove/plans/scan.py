"""Queries as boolean Columns over the documents: no shuffle, no Python.

A predicate on an absent field or a null is false, so that NOT has two values.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedQuery
from ..functions import distance, text
from .ast import Bool, Fuzzy, MatchAll, Node, Phrase, Prefix, Range, Term, Wildcard

ALL = "_all"


@dataclass(frozen=True)
class Fields:
    """What a query's fields are: Columns' types by name, and the analyzers of text fields."""

    types: Mapping[str, T.DataType]
    analyzers: Mapping[str, text.Analyzer] | None = None
    default_analyzer: text.Analyzer = text.SIMPLE

    @staticmethod
    def of(schema: T.StructType, **options) -> Fields:
        return Fields({f.name: f.dataType for f in schema.fields}, **options)

    def is_text(self, name: str) -> bool:
        return isinstance(self.types.get(name), T.StringType)

    def texts(self) -> list[str]:
        return sorted(n for n in self.types if self.is_text(n))

    def analyzer(self, name: str) -> text.Analyzer:
        return (self.analyzers or {}).get(name, self.default_analyzer)


def matches(q: Node, fields: Fields) -> Column:
    """The predicate of a query."""
    return F.coalesce(_predicate(q, fields), F.lit(False))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _over(name: str, fields: Fields, predicate) -> Column:  # noqa: ANN001
    names = fields.texts() if name == ALL else [name] if fields.is_text(name) else []
    return _any([F.coalesce(predicate(F.col(f"`{n}`"), n), F.lit(False)) for n in names])


def _predicate(q: Node, fields: Fields) -> Column:
    if isinstance(q, MatchAll):
        return F.lit(True)
    if isinstance(q, Term):
        return _over(q.field, fields, lambda c, n: F.contains(F.lower(c), F.lower(F.lit(q.value))))
    if isinstance(q, Phrase):
        return _over(q.field, fields, lambda c, n: phrase_in(fields.analyzer(n), c, q.terms, q.slop))
    if isinstance(q, Prefix):
        return _over(q.field, fields, lambda c, n: F.exists(text.whitespace_words(c), lambda w: F.startswith(w, F.lit(q.value))))
    if isinstance(q, Wildcard):
        pattern = wildcard_regex(q.pattern, q.anchored)
        if pattern is None:
            return F.lit(False)
        if q.anchored:
            return _over(q.field, fields, lambda c, n: F.exists(text.whitespace_words(c), lambda w: F.rlike(w, F.lit(pattern))))
        return _over(q.field, fields, lambda c, n: F.rlike(c, F.lit(pattern)))
    if isinstance(q, Fuzzy):
        return _over(q.field, fields, lambda c, n: fuzzy_in(c, q))
    if isinstance(q, Range):
        return _range(q, fields)
    if isinstance(q, Bool):
        parts = [matches(c, fields) for c in (*q.must, *q.filter)]
        parts += [~matches(c, fields) for c in q.must_not]
        if q.should:
            should = [matches(c, fields) for c in q.should]
            if q.minimum_should_match is None:
                parts.append(_any(should))
            else:
                parts.append(reduce(lambda a, b: a + b, [s.cast("int") for s in should]) >= q.minimum_should_match)
        return _all(parts)
    raise UnsupportedQuery(f"no predicate for {type(q).__name__}")


def wildcard_regex(pattern: str, anchored: bool = False) -> str | None:
    """``*`` and ``?`` as regular expressions; nothing else is escaped unless anchored.  None if it isn't one."""
    if anchored:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        return f"(?d)^{body}$"
    body = pattern.replace("*", ".*").replace("?", ".")
    try:
        re.compile(body)
    except re.error:
        return None
    return f"(?d){body}"  # the full stop takes anything but a line feed


def fuzzy_in(c: Column, q: Fuzzy) -> Column:
    """Whether a white-space word, without marks at its ends, is near the query."""
    found = F.transform(text.whitespace_words(F.lower(c)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.exists(found, lambda w: (w != "") & distance.within(w, q.value.lower(), q.max_edits))


def phrase_in(analyzer: text.Analyzer, c: Column, terms: tuple[str, ...], slop: int = 0) -> Column:
    """Whether the analyzed terms follow each other, each at most ``slop`` places late.

    The next place is always the first that fits; there is no going back.
    """
    wanted = analyzer.plain(" ".join(terms))
    if not wanted:
        return F.lit(False)
    # a text that lacks one of the words, even as part of another, isn't analyzed
    possible = _all([F.contains(F.lower(c), F.lit(w)) for w in dict.fromkeys(wanted)]) if analyzer.verbatim else F.lit(True)
    tokens = analyzer.placed(c)
    if slop == 0 and analyzer.positions == "closed":
        # one pass: how many of the words the last tokens agree with, for each length at once
        n = len(wanted)
        start = F.struct(*[F.lit(k == 0).alias(f"m{k}") for k in range(n + 1)])

        def step(acc: Column, w: Column) -> Column:
            going = [F.lit(True), *[acc[f"m{k}"] & (w == F.lit(wanted[k])) for k in range(n)]]
            going[n] = acc[f"m{n}"] | going[n]
            return F.struct(*[g.alias(f"m{k}") for k, g in enumerate(going)])

        return possible & F.aggregate(analyzer.terms(c), start, step)[f"m{n}"]

    def places(term: str) -> Column:
        return F.transform(F.filter(tokens, lambda t: t["text"] == term), lambda t: t["position"])

    first = places(wanted[0])
    rest = F.array(*[places(w) for w in wanted[1:]]) if len(wanted) > 1 else F.array().cast("array<array<int>>")

    def follow(cur: Column, ps: Column) -> Column:
        near = F.filter(ps, lambda p: (p >= cur + 1) & (p <= cur + slop + 1))
        return F.when(cur < 0, F.lit(-1)).otherwise(F.coalesce(F.get(near, F.lit(0)), F.lit(-1)))

    return possible & F.exists(first, lambda p: F.aggregate(rest, p, follow) >= 0)


def _range(q: Range, fields: Fields) -> Column:
    kind = fields.types.get(q.field)
    c = F.col(f"`{q.field}`")
    if isinstance(kind, T.NumericType):
        usable = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        lit = F.lit
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        usable = lambda v: isinstance(v, datetime)

        def lit(v: datetime) -> Column:
            if v.tzinfo is not None:
                from datetime import UTC

                v = v.astimezone(UTC).replace(tzinfo=None)
            return F.lit(v.isoformat(sep=" ")).cast(kind)
    else:
        return F.lit(False)
    parts = [c.isNotNull()]
    for value, op in ((q.gt, "__gt__"), (q.gte, "__ge__"), (q.lt, "__lt__"), (q.lte, "__le__")):
        if value is not None and usable(value):
            parts.append(getattr(c, op)(lit(value)))
    return _all(parts)
