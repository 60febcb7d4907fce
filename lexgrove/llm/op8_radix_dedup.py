"""Exact duplicates by distributed MSD radix partitioning on the documents' bytes.

Level k splits each open group by the next digit of its documents.  A digit is a
run of successive bytes, 64 at level 0 and eight times more at each level, so
that 2 GB, the most a text can have, are used up after nine levels.  A group of
one document is closed; documents whose bytes end within the digit and that are
in one group are equal, byte for byte: no digest is taken anywhere.  A level
shuffles the digits of open documents only; those that differ early, nearly all,
cost 64 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, discard, keys, may_be_among, rows_of, split, table, written

FIRST, GROW = 64, 8
#: Rows that one array stands for where repeated rows are listed.
AT_ONCE = 1 << 20


def _groups(docs: DataFrame, first: int, grow: int) -> DataFrame:
    """KEY and grp, the KEY of the row that stays, of every row whose text another row has; a written table."""
    if first < 1 or grow < 1:
        raise ValueError("digits have one byte at least")
    source = docs.select(*keys(), F.encode("text", "utf-8").alias("bytes")).where("doc_id is not null and text is not null")
    rows = source.select(*KEY, F.substring("bytes", 1, first).alias("digit"), (F.octet_length("bytes") < first).alias("over"))
    at, width, ended, levels, rest, by = first + 1, first * grow, [], [], None, ["digit", "over"]
    while True:
        # equal digits are combined before the shuffle; only groups of several go back to their rows
        several = rows.groupBy(*by).agg(F.min(F.struct(*KEY)).alias("next"), F.count("*").alias("many")).where("many > 1").drop("many")
        rows = written(rows.join(several.hint("merge"), by).select(*KEY, F.col("next").alias("grp"), "over"), f"radix-{len(levels)}")
        levels.append(rows)
        ended.append(rows.where("over").select(*KEY, "grp"))
        going = rows.where("not over").select(*KEY, "grp").distinct()
        if going.isEmpty():
            break
        if rest is None:  # texts of open documents, cut from the rest once
            among = may_be_among(going.select(F.xxhash64(*KEY).alias("key")))
            rest = written(source.where(among(F.xxhash64(*KEY))).join(going.select(*KEY).hint("merge"), list(KEY), "left_semi"), "radix-open")
        digits = rest.where(F.octet_length("bytes") >= at - 1).select(*KEY, F.substring("bytes", at, width).alias("digit"), (F.octet_length("bytes") < at + width - 1).alias("over"))
        rows, by = digits.join(going.hint("merge"), list(KEY)), ["grp", "digit", "over"]
        at, width = at + width, width * grow
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    out = written(out, "radix-groups")
    discard(rest, *levels)
    return out


def _again(groups: DataFrame) -> DataFrame:
    """KEY of rows that stay and are there several times, and how often; no task holds a group."""
    return groups.where(F.struct(*KEY) == F.col("grp")).groupBy(*KEY).agg(F.count("*").alias("many")).where("many > 1")


def copies(docs: DataFrame, first: int = FIRST, grow: int = GROW) -> DataFrame:
    """(doc_id, keep_doc_id) of each row whose text is that of another row, but for the row that stays.

    The row of the least doc_id stays.  A repeated row of one doc_id is a copy of
    itself and listed as (id, id).  Rows that share a doc_id but not their text
    are told apart, by the doc_id and 128 bits of the text; equality between rows of
    different doc_ids is decided by all bytes.  Empty texts are equal to each other.
    Rows with a null text, or a doc_id that is null or no whole number, are no
    copies and aren't listed.  Other columns aren't read; an empty table gives no row.
    """
    groups = _groups(docs, first, grow)
    other = groups.where(F.struct(*KEY) != F.col("grp")).select("doc_id", F.col("grp.doc_id").alias("keep_doc_id"))
    again = _again(groups).withColumn("at", F.explode(F.expr(f"sequence(1L, many - 1, {AT_ONCE}L)")))
    again = again.withColumn("nth", F.explode(F.expr(f"sequence(at, least(many - 1, at + {AT_ONCE - 1}L))")))
    return other.unionByName(again.select("doc_id", F.col("doc_id").alias("keep_doc_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: that of the least doc_id.

    Of repeated rows of one doc_id and text one stays, the least by all columns as
    JSON; where one doc_id has several texts, each of them is treated on its own and no
    text is lost.  Rows with a null text, or a doc_id that is null or no whole
    number, all stay.  Any other columns are kept, whatever their names.
    """
    groups = _groups(docs, FIRST, GROW)
    again = _again(groups).select(*KEY)
    special = written(groups.where(F.struct(*KEY) != F.col("grp")).select(*KEY, F.lit(False).alias("stays")).distinct().unionByName(again.withColumn("stays", F.lit(True))), "radix-special")
    discard(groups)
    clear, rest = split(docs, special)
    rest = rest.join(special.hint("merge"), list(KEY), "left").where("stays is null or stays")
    once = rest.where("stays").groupBy(*KEY).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows_of(clear.select("row").unionByName(rest.where("stays is null").select("row")).unionByName(once.select("row")), docs)


def op8_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


QUERIES = {"op8_radix_dedup": op8_radix_dedup}
SQL = {
    "op8_radix_dedup": """
WITH r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_doc_id,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, keep_doc_id FROM r WHERE nth > 1"""
}
