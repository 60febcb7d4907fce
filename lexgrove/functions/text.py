"""Text analysis as Column expressions: a tokenizer and filters make an analyzer.

A token is a struct (text, position, offset, length, token_type), an analyzer
a function from a text Column to an array of tokens.  Matching and indexing use
``placed`` and ``terms``, which stay in the JVM but for stemming, an Arrow function
that keeps the stems of words it has met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound

#: Words with inner apostrophes, full stops, colons and middle dots kept, near the Unicode word rules.
UNICODE_WORDS = r"[\p{L}\p{M}\p{N}_]+(?:['’.·:][\p{L}\p{M}\p{N}_]+)*"
SIMPLE_WORDS = r"[\p{L}\p{N}_]+"
ENGLISH_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with")
MOST_BYTES = 255

Tokens = Column


@dataclass(frozen=True)
class Filter:
    """A step on token Columns, and the same on a list of a query's own words."""

    column: Callable[[Tokens], Tokens]
    plain: Callable[[list[str]], list[str]]
    #: whether the words that are left are parts of the lower-cased text
    verbatim: bool = True

    def __call__(self, tokens: Tokens) -> Tokens:
        return self.column(tokens)


def words(text: Column, pattern: str = SIMPLE_WORDS, lower: bool = True) -> Column:
    """Plain array of words; null for a null text."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0))


@dataclass(frozen=True)
class Tokenizer:
    """Words by a pattern; those of over 255 bytes are dropped and take no position."""

    pattern: str = SIMPLE_WORDS
    lower: bool = True
    #: what an offset counts between words
    gap: int = 0

    def words(self, text: Column) -> Column:
        return F.filter(words(text, self.pattern, self.lower), lambda w: F.octet_length(w) <= MOST_BYTES)

    def plain(self, text: str) -> list[str]:
        import regex

        found = regex.findall(self.pattern, text.lower() if self.lower else text)
        return [w for w in found if len(w.encode()) <= MOST_BYTES]

    def placed(self, text: Column) -> Tokens:
        """Structs of text and position alone, which is what matching and indexing need."""
        return F.transform(self.words(text), lambda w, i: F.struct(w.alias("text"), i.alias("position")))

    def __call__(self, text: Column) -> Tokens:
        """Whole tokens; an offset is the sum of the lengths (and gaps) before."""
        found = self.words(text)
        lengths = F.transform(found, lambda w: F.octet_length(w))
        return F.zip_with(
            F.transform(found, lambda w, i: F.struct(w.alias("text"), i.alias("position"))),
            running_sums(F.transform(lengths, lambda n: n + self.gap)),
            lambda t, o: F.struct(t["text"].alias("text"), t["position"].alias("position"), o.alias("offset"), F.octet_length(t["text"]).alias("length"), F.lit("word").alias("token_type")),
        )


def _lists(of: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists of an Arrow array and the bounds of each list; null lists have none."""
    counts = pc.fill_null(of.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return of.flatten(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _as_lists(items: pa.Array, bounds: np.ndarray, like: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items, mask=like.is_null() if like.null_count else None)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_sums(lengths: pa.Array) -> pa.Array:
    """Sum of the items before each; arrays have no running fold, and growing one item by item is quadratic."""
    items, bounds = _lists(lengths)
    before = np.concatenate([[0], np.cumsum(items.to_numpy(zero_copy_only=False), dtype=np.int64)])
    sums = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
    return _as_lists(pa.array(sums, pa.int32()), bounds, lengths)


standard_tokenizer = Tokenizer(UNICODE_WORDS)
simple_tokenizer = Tokenizer()
vietnamese_tokenizer = Tokenizer(UNICODE_WORDS, lower=False, gap=1)


def whitespace_words(text: Column) -> Column:
    """Words between white space; an empty array for blank and null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


lowercase = Filter(lambda tokens: F.transform(tokens, lambda t: t.withField("text", F.lower(t["text"]))), lambda ws: [w.lower() for w in ws])


def stop_words(stop: Iterable[str] = ENGLISH_STOP_WORDS) -> Filter:
    """Drops the words; positions of the others keep their gaps."""
    listed = list(stop)
    return Filter(lambda tokens: F.filter(tokens, lambda t: ~t["text"].isin(listed)), lambda ws: [w for w in ws if w not in listed])


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(found: pa.Array) -> pa.Array:
    """Stems of lists of words; only a batch's distinct words become Python strings."""
    from .porter2 import stem

    items, bounds = _lists(found)
    coded = items.dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], items.type)
    return _as_lists(stems.take(coded.indices), bounds, found)


@F.pandas_udf(T.StringType())
def stem_word(word: pd.Series) -> pd.Series:
    from .porter2 import stem

    known = {w: stem(w) for w in word.dropna().unique()}
    return word.map(known)


def _stem_tokens(tokens: Tokens) -> Tokens:
    stems = stem_words(F.transform(tokens, lambda t: t["text"]))
    return F.zip_with(tokens, stems, lambda t, s: t.withField("text", s))


def _stem_plain(found: list[str]) -> list[str]:
    from .porter2 import stem

    return [stem(w) for w in found]


stemmer = Filter(_stem_tokens, _stem_plain, verbatim=False)


def ngrams_of(word: Column, least: int, most: int) -> Column:
    """Character n-grams of a word, shorter ones first."""
    top = F.least(F.lit(most), F.length(word))
    sizes = F.when(F.length(word) >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, n))))


def ngram_filter(least: int, most: int) -> Filter:
    """Each token as its character n-grams, at the token's position."""

    def apply(tokens: Tokens) -> Tokens:
        return F.flatten(F.transform(tokens, lambda t: F.transform(ngrams_of(t["text"], least, most), lambda g: t.withField("text", g))))

    def plain(found: list[str]) -> list[str]:
        return [w[i : i + n] for w in found for n in range(least, min(most, len(w)) + 1) for i in range(len(w) - n + 1)]

    return Filter(apply, plain)


def closed_positions(tokens: Tokens) -> Tokens:
    """Positions numbered anew, so that removed words leave no gap."""
    return F.transform(tokens, lambda t, i: t.withField("position", i))


@dataclass(frozen=True)
class Analyzer:
    name: str
    tokenizer: Tokenizer
    filters: tuple[Filter, ...] = ()
    #: "closed" numbers the words that are left, "gaps" keeps their first positions
    positions: str = "closed"

    def _filtered(self, tokens: Tokens) -> Tokens:
        for f in self.filters:
            tokens = f(tokens)
        return closed_positions(tokens) if self.positions == "closed" and self.filters else tokens

    def __call__(self, text: Column) -> Tokens:
        """Whole tokens."""
        return self._filtered(self.tokenizer(text))

    def placed(self, text: Column) -> Tokens:
        """Tokens of text and position alone."""
        return self._filtered(self.tokenizer.placed(text))

    @property
    def verbatim(self) -> bool:
        return all(f.verbatim for f in self.filters)

    def plain(self, text: str) -> list[str]:
        """Terms of a query's own text, on the driver."""
        found = self.tokenizer.plain(text)
        for f in self.filters:
            found = f.plain(found)
        return found

    def terms(self, text: Column) -> Column:
        return F.transform(self._filtered(self.tokenizer.placed(text)), lambda t: t["text"]) if self.filters else self.tokenizer.words(text)


STANDARD = Analyzer("standard", standard_tokenizer, (lowercase, stop_words(), stemmer))
VIETNAMESE = Analyzer("vietnamese", vietnamese_tokenizer, (lowercase,))
SIMPLE = Analyzer("simple", simple_tokenizer)


@dataclass
class Registry:
    """Analyzers by name."""

    known: dict[str, Analyzer] = field(default_factory=lambda: {a.name: a for a in (STANDARD, VIETNAMESE, SIMPLE)})

    def register(self, analyzer: Analyzer) -> None:
        self.known[analyzer.name] = analyzer

    def get(self, name: str) -> Analyzer:
        if name not in self.known:
            raise NotFound(f"no analyzer is named {name!r}")
        return self.known[name]

    def analyze(self, name: str, text: Column) -> Tokens:
        return self.get(name)(text)
