"""Term expansion over the dictionary, and set algebra over postings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import distance


def prefix(terms: DataFrame, start: str, min_length: int = 0) -> DataFrame:
    """Terms that begin so, in order; none for a prefix of fewer bytes than ``min_length``."""
    if len(start.encode()) < min_length:
        return terms.limit(0)
    return terms.where(F.col("term").startswith(start)).orderBy("term")


def wildcard(terms: DataFrame, pattern: str) -> DataFrame:
    """Terms that match a pattern of ``*`` alone, from end to end."""
    like = re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%")
    return terms.where(F.col("term").like(like)).orderBy("term")


def regex(terms: DataFrame, pattern: str) -> DataFrame:
    """Terms in which a regular expression is found."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidInput(f"not a pattern: {e}") from e
    return terms.where(F.col("term").rlike(pattern)).orderBy("term")


def fuzzy(terms: DataFrame, word: str, max_edits: int = 2, prefix_length: int = 0, transpositions: bool = False) -> DataFrame:
    """Terms near ``word`` with their distance, the nearest first; the first ``prefix_length`` characters must agree."""
    head, tail = word[:prefix_length], word[prefix_length:]
    near = terms.where(F.col("term").startswith(head)) if head else terms
    rest = F.substring("term", prefix_length + 1, 1 << 20)
    near = near.where(F.abs(F.length(rest) - len(tail)) <= max_edits)
    if transpositions:
        near = near.withColumn("distance", distance.osa_distance(tail)(rest)).where(F.col("distance") <= max_edits)
    else:
        near = near.withColumn("distance", F.levenshtein(rest, F.lit(tail), max_edits)).where("distance >= 0")
    return near.orderBy("distance", "term")


def _of(postings: DataFrame, field: str | None) -> DataFrame:
    return postings if field is None else postings.where(F.col("field") == field)


def intersect(postings: DataFrame, terms: Sequence[str], field: str | None = None) -> DataFrame:
    """doc_id of documents that have all terms; none for no terms."""
    terms = sorted(set(terms))
    rows = _of(postings, field).where(F.col("term").isin(terms))
    return rows.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == max(len(terms), 1)).select("doc_id")


def union(postings: DataFrame, terms: Sequence[str], field: str | None = None) -> DataFrame:
    """doc_id of documents that have any of the terms."""
    return _of(postings, field).where(F.col("term").isin(list(terms))).select("doc_id").distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "doc_id", "left_anti")


def intersect_all(sets: Sequence[DataFrame]) -> DataFrame:
    """doc_id that are in each of several sets, the first of which may repeat none."""
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets)


def phrase(postings: DataFrame, terms: Sequence[str], slop: int = 0, field: str | None = None) -> DataFrame:
    """doc_id of documents in which the terms follow each other, each at most ``slop`` places late.

    Documents that lack a term fall out of a grouping on doc_id; places are then
    followed within a row, always to the first that fits.
    """
    if not terms:
        return postings.select("doc_id").limit(0)
    distinct = sorted(set(terms))
    rows = _of(postings, field).where(F.col("term").isin(distinct))
    by_doc = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).where(F.size("at") == len(distinct))
    first = F.col("at")[F.lit(terms[0])]
    rest = F.array(*[F.col("at")[F.lit(t)] for t in terms[1:]]) if len(terms) > 1 else F.array().cast("array<array<int>>")

    def follow(cur, ps):  # noqa: ANN001, ANN202
        near = F.filter(ps, lambda p: (p >= cur + 1) & (p <= cur + slop + 1))
        return F.when(cur < 0, F.lit(-1)).otherwise(F.coalesce(F.get(near, F.lit(0)), F.lit(-1)))

    return by_doc.where(F.exists(first, lambda p: F.aggregate(rest, p, follow) >= 0)).select("doc_id")
