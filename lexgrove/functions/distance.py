"""Edit distances between words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def within(word: Column, query: str, most: int) -> Column:
    """Whether a word is at most so many single-character edits from ``query``; lengths are compared first."""
    return (F.abs(F.length(word) - len(query)) <= most) & (F.levenshtein(word, F.lit(query), most) >= 0)


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours counted as one, each part edited once."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def osa_distance(query: str) -> Callable[[Column], Column]:
    """An Arrow function for the distance to ``query``; meant for the dictionary's distinct terms, not for postings."""

    @F.pandas_udf("int")
    def distance(word: pd.Series) -> pd.Series:
        return word.map(lambda w: osa(w, query), na_action="ignore").astype("Int32")

    return distance
