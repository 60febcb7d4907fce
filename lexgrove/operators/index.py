"""The inverted index as DataFrames: postings, dictionary, document lengths and totals.

Postings are rows (field, term, doc_id, tf, positions, field_norm).  A document's tokens
are grouped within its row, so nothing is shuffled but the rows of ids that come again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIMPLE, Analyzer

#: Bytes of a row group of postings.
ROW_GROUP = 16 << 20
POSTINGS = "field string, term string, doc_id long, tf long, positions array<int>, field_norm double"


def by_term(tokens: Column) -> Column:
    """Tokens of text and position as structs of term, rising positions and the number of all tokens, ordered by term."""

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a value that is worked out once, not once an element."""
        return F.transform(F.array(value), body)[0]

    def runs(found: Column, starts: Column) -> Column:
        def run(at: Column, k: Column) -> Column:
            upto = F.coalesce(F.get(starts, k + 1), F.size(found))
            return F.struct(F.get(found, at)["text"].alias("term"), F.slice(found, at + 1, upto - at)["position"].alias("positions"), F.size(found).alias("n"))

        return F.transform(starts, run)

    def starts_of(found: Column) -> Column:
        at = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: ~F.get(found, i)["text"].eqNullSafe(F.get(found, i - 1)["text"]))

    return bound(F.sort_array(tokens), lambda found: bound(starts_of(found), lambda starts: runs(found, starts)))


def postings(docs: DataFrame, fields: Iterable[str], analyzers: dict[str, Analyzer] | None = None, default: Analyzer = SIMPLE, id_column: str = "doc_id") -> DataFrame:
    """Postings of the given text fields; positions rise within a row.

    Rows of one id and length count together.  Whether any id comes again is asked first,
    by a job that reads ids alone; only the postings of such ids are shuffled.
    """
    key = F.col(id_column).cast("long")
    repeated = docs.groupBy(key.alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    again = not repeated.isEmpty()
    parts = []
    for name in sorted(fields):
        analyzer = (analyzers or {}).get(name, default)

        def of(rows: DataFrame, name: str = name, analyzer: Analyzer = analyzer) -> DataFrame:
            rows = rows.select(key.alias("doc_id"), F.explode(by_term(analyzer.placed(F.col(f"`{name}`")))).alias("t"))
            return rows.select("t.term", "doc_id", F.size("t.positions").cast("long").alias("tf"), "t.positions", "t.n")

        rows = of(docs)
        if again:
            same = key.eqNullSafe(F.col("__id"))
            shared = of(docs.join(repeated, same, "left_semi")).groupBy("doc_id", "n", "term").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
            rows = of(docs.join(repeated, same, "left_anti")).unionByName(shared)
        parts.append(rows.select(F.lit(name).alias("field"), "term", "doc_id", "tf", "positions", (1.0 / F.sqrt("n")).alias("field_norm")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_fields(rows: DataFrame) -> DataFrame:
    """Postings of all fields of a document as one field ``_all``; fields follow each other by name."""
    spans = rows.groupBy("doc_id", "field").agg((F.max(F.array_max("positions")) + 1).alias("span"))
    order = Window.partitionBy("doc_id").orderBy("field").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("before", (F.sum("span").over(order) - F.col("span")).cast("int"))
    moved = rows.join(spans, ["doc_id", "field"]).select("doc_id", "term", F.explode(F.transform("positions", lambda p: p + F.col("before"))).alias("p"))
    return moved.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("p")).alias("positions")).select(F.lit("_all").alias("field"), "term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")


def doc_lengths(docs: DataFrame, field: str, analyzer: Analyzer = SIMPLE, id_column: str = "doc_id") -> DataFrame:
    """doc_id and dl, the number of tokens, of every document."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.size(analyzer.terms(F.col(f"`{field}`"))), F.lit(0)).cast("long").alias("dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0))


def dictionary(rows: DataFrame, n_docs: int) -> DataFrame:
    """field, term, doc_freq, total_freq and idf."""
    stats = rows.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_freq"))
    return stats.withColumn("idf", idf(F.col("doc_freq"), F.lit(float(n_docs))))


def index_stats(lengths: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n_docs, total_tokens, unique_terms and avgdl."""
    of_docs = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    of_terms = rows.agg(F.count_distinct("term").alias("unique_terms"))
    both = of_docs.crossJoin(F.broadcast(of_terms))  # one row each
    return both.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs")).otherwise(0.0))


def write_postings(rows: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    """Each file ordered by term, so a term's row groups and pages are found by their statistics.

    Files hold whole documents: a frequent term is spread over all of them, and no posting is shuffled.
    """
    rows.sortWithinPartitions("term", "doc_id").write.mode(mode).option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
