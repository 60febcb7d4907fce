"""How rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs up to this size are shuffled once so that all cores analyze their texts.
SMALL = 256 << 20


#: Bytes of stored documents whose postings a task sorts in memory.
PIECE = 16 << 20


def pieces(docs: DataFrame, size: int, each: int = PIECE) -> DataFrame:
    """Stored documents of ``size`` bytes over as many tasks as there are pieces, and over all cores if there are fewer."""
    n = max(-(-size // each), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    return docs.repartition(n, "doc_id")


def spread(docs: DataFrame, most: int = SMALL) -> DataFrame:
    """A small input over all cores, however few row groups its files have; a larger one as it is.

    The size is the optimizer's estimate, from file sizes; nothing is run.  Large
    inputs have row groups enough, and aren't shuffled.
    """
    if docs.isStreaming:
        return docs
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size <= most else docs
