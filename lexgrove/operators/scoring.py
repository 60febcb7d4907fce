"""Scores as Columns, and their explanations."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    name: str

    def score(self, tf: Column, dl: Column, avgdl: Column, idf: Column, boost: float = 1.0) -> Column: ...


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75
    name: str = "bm25"

    def score(self, tf: Column, dl: Column, avgdl: Column, idf: Column, boost: float = 1.0) -> Column:
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl)) * boost


@dataclass(frozen=True)
class TfIdf:
    normalized: bool = True
    name: str = "tfidf"

    def score(self, tf: Column, dl: Column, avgdl: Column, idf: Column, boost: float = 1.0) -> Column:
        return (tf / dl if self.normalized else tf) * idf * boost


@dataclass(frozen=True)
class Constant:
    name: str = "none"

    def score(self, tf: Column, dl: Column, avgdl: Column, idf: Column, boost: float = 1.0) -> Column:
        return F.lit(1.0)


def explanation(value: Column, description: str, details: list[tuple[Column, str]] = ()) -> Column:  # type: ignore[assignment]
    """A struct of value, description and details."""
    parts = [F.struct(v.cast("double").alias("value"), F.lit(d).alias("description")) for v, d in details]
    inner = F.array(*parts) if parts else F.array().cast("array<struct<value:double,description:string>>")
    return F.struct(value.cast("double").alias("value"), F.lit(description).alias("description"), inner.alias("details"))
