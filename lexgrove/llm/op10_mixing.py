"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree of domain, language and source.  A token budget goes
down the tree: among the children of a node it is shared by weight, but no child
gets more than the tokens below it times the epochs allowed.  What a child can't
take goes to its siblings by their weights, so a shortage leaves a subtree only
once that subtree is used up.  All shares are whole numbers, in exact arithmetic.

Each leaf takes whole passes over its documents, then a prefix of the tokens of
one more pass, whose order is the documents' hash under the seed and the number
of the pass.  Where the prefix ends is found by sums over hash buckets: of 256, then
of 65,536 within the one in which the budget ends; only what is in the last one is
sorted, so a hot source isn't a hot task.  The documents themselves are then taken
by comparison with their leaf's end, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, discard, rows_of, table, whole_id, written

LEVELS = ("domain", "lang", "source")
#: Weights of nodes by name, 1 where none is given; the sum of siblings' weights times the tokens must fit in 63 bits.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 4, "src10": 3, "src19": 2}
SEED, EPOCHS, SHARE, BUCKET_HEX = "mix-1", 2, (9, 10), 2
_NONE = "(none)"


def domain_of(source: Column) -> Column:
    """The domain of the driver tables' sources: by number, ten of the web, five of books, the rest forums."""
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number < 15, "books").otherwise("forum")


def _weight(level: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(level == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """``nodes`` (parents, name, cap, budget of the parent) with each node's share as budget."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", name)
    df = nodes.withColumn("w", weight).where("w > 0").withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    df = df.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    df = df.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("full", (F.col("cap") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("w")).cast("int"))
    df = df.withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the first node that isn't filled up has the largest rest of weights
    rest = F.max(F.when(F.col("full") == 0, F.col("rest"))).over(by)
    first = F.max(F.when(F.col("full") == 0, F.col("budget") - F.col("before"))).over(by)
    share = F.when(F.col("full") == 1, F.col("cap")).otherwise(F.least("cap", F.expr("left_ * w div rest_")))
    df = df.withColumn("left_", first).withColumn("rest_", rest).withColumn("budget", share)
    return df.select(*parents, name, "budget")


def budgets(leaves: DataFrame, total: Column, epochs: int = EPOCHS, weights: tuple[Mapping[str, int], ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """Leaves (domain, lang, source, supply) with their budgets; ``total`` is a Column over the sum of supplies."""
    caps = leaves.withColumn("cap", F.col("supply") * epochs)
    up = caps.agg(F.sum("supply").alias("supply")).select(total.cast("long").alias("budget"))
    out = None
    for k, name in enumerate(LEVELS):
        parents = list(LEVELS[:k])
        nodes = caps.groupBy(*parents, name).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(out, parents) if parents else nodes.crossJoin(F.broadcast(up))  # one row
        out = _share(nodes, parents, name, _weight(F.col(name), weights[k]))
    return leaves.join(out, list(LEVELS))


_Weights = tuple[Mapping[str, int], ...]
_WEIGHTS = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
#: Order within a pass: the hash, then what settles ties.
_ORDER = ("key", "doc_id", "tokens", "tie")


def _bucket_ends(rows: DataFrame, bucket: Column) -> DataFrame:
    """The bucket of each leaf in which ``part`` tokens end, with what is left of part at its start."""
    sums = rows.groupBy(*LEVELS, bucket.alias("bucket")).agg(F.sum("tokens").alias("size"), F.first("part").alias("part"))
    upto = F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("before", upto - F.col("size")).where("before < part and part <= before + size")
    return sums.select(*LEVELS, F.col("bucket").alias("end_bucket"), (F.col("part") - F.col("before")).alias("left"))


def _taken(docs: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: _Weights = _WEIGHTS, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as ``row``, with their leaf, epoch, tokens and take."""
    if epochs < 1 or share[0] < 0 or share[1] < 1:
        raise ValueError("epochs and the share must be positive")
    domain = domain_of(F.col("source")) if domain is None else domain
    tokens = F.ceil(F.octet_length("text") / 4) if tokens is None else tokens
    rows = beside(docs, whole_id().alias("doc_id"), *[F.coalesce(c, F.lit(_NONE)).alias(n) for c, n in ((domain, "domain"), (F.col("lang"), "lang"), (F.col("source"), "source"))], F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), F.xxhash64("text").alias("tie")).where("tokens > 0")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")), "mix-leaves")
    plan = budgets(leaves, F.expr(f"supply * {share[0]} div {share[1]}"), epochs, weights)
    plan = plan.select(*LEVELS, F.expr("budget div supply").alias("whole"), F.expr("budget % supply").alias("part")).where("whole > 0 or part > 0")
    plan = written(plan, "mix-plan")  # a file of known size: Catalyst broadcasts it only if it is small
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = rows.join(plan, list(LEVELS)).withColumn("key", key)
    bare = keyed.where("part > 0").select(*LEVELS, "part", *_ORDER)
    ends = _bucket_ends(bare, F.substring("key", 1, BUCKET_HEX))
    near = written(bare.join(ends, list(LEVELS)).where(F.substring("key", 1, BUCKET_HEX) == F.col("end_bucket")).select(*LEVELS, F.col("left").alias("part"), *_ORDER), "mix-near")
    inner = F.substring("key", 1 + BUCKET_HEX, 2 * BUCKET_HEX)
    last = near.join(_bucket_ends(near, inner), list(LEVELS)).where(inner == F.col("end_bucket"))
    order = Window.partitionBy(*LEVELS).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("tokens").over(order)).where("upto - tokens < left and left <= upto")
    last = last.select(*LEVELS, F.struct(*_ORDER).alias("last"), (F.col("left") - F.col("upto") + F.col("tokens")).alias("last_take"))
    ties = near.join(last, list(LEVELS)).where(F.struct(*_ORDER) == F.col("last")).groupBy(*LEVELS).agg(F.count("*").alias("ties"))
    full = written(plan.join(last.join(ties, list(LEVELS)), list(LEVELS), "left"), "mix-ends")
    discard(leaves, plan)
    out = rows.join(full, list(LEVELS)).withColumn("key", key)
    place = F.struct(*_ORDER)
    before, at = F.coalesce(place < F.col("last"), F.lit(False)), F.coalesce(place == F.col("last"), F.lit(False))
    names = ["row", "doc_id", *LEVELS, "epoch", "tokens", "take"]
    some = out.where(~at | (F.col("ties") == 1)).withColumn("epoch", F.explode(F.expr("sequence(0L, whole)"))).where((F.col("epoch") < F.col("whole")) | before | at)
    some = some.withColumn("take", F.when((F.col("epoch") == F.col("whole")) & at, F.col("last_take")).otherwise(F.col("tokens"))).select(*names)
    if full.where("ties > 1").isEmpty():
        return some
    # rows that the order can't tell from the last one, so repeated rows of one doc_id
    equal = out.where(at & (F.col("ties") > 1))
    passes = equal.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, whole - 1)"))).withColumn("take", F.col("tokens")).select(*names)
    more = _equal_takes(equal, near, last).select(*names)
    return some.unionByName(passes).unionByName(more)


def _equal_takes(equal: DataFrame, near: DataFrame, last: DataFrame) -> DataFrame:
    """What the prefix takes of repeated rows at its end: whole ones, then the rest of the budget."""
    earlier = near.join(last, list(LEVELS)).where(F.struct(*_ORDER) < F.col("last")).groupBy(*LEVELS).agg(F.sum("tokens").alias("used"))
    room = near.select(*LEVELS, "part").distinct().join(earlier, list(LEVELS), "left").select(*LEVELS, (F.col("part") - F.coalesce("used", F.lit(0))).alias("room"))
    nth = F.row_number().over(Window.partitionBy(*LEVELS).orderBy(F.to_json("row")))
    out = equal.join(room, list(LEVELS)).withColumn("start", (nth - 1) * F.col("tokens")).where("start < room")
    return out.withColumn("epoch", F.col("whole")).withColumn("take", F.least("tokens", F.col("room") - F.col("start")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens and take, a row for each pass in which a document is taken.

    Options: ``share`` (numerator, denominator) of all tokens is the budget; a document's
    tokens are its UTF-8 bytes over four, rounded up, unless ``tokens`` is given;
    ``epochs``, ``seed``, ``weights`` by level, and ``domain``, a Column.
    ``take`` is less than ``tokens`` only for the last document of a leaf's
    prefix.  Null languages and sources form nodes named (none).  Rows without
    tokens (null or empty text) aren't taken.  Repeated rows count as often as
    they are there; equal hashes are ordered by doc_id, nulls first, then tokens, then the
    text's hash.  A doc_id that is no whole number counts as null.  An empty table gives no row.
    """
    return _taken(docs, **options).drop("row")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, whole and with all columns, as often as ``mix`` takes them; their texts aren't shuffled.

    Each row is taken on its own, rows that share a doc_id too; columns may have any names.
    """
    return rows_of(_taken(docs, **options), docs)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(level: str, weights: Mapping[str, int]) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _sql() -> str:
    steps, up = [], "top"
    for k, (name, weights) in enumerate(zip(LEVELS, (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), strict=True)):
        cols = ", ".join(LEVELS[: k + 1])
        part = f"PARTITION BY {', '.join(LEVELS[:k])}" if k else ""
        using = f"JOIN {up} USING ({', '.join(LEVELS[:k])})" if k else f"CROSS JOIN {up}"
        steps.append(f"""
n{k} AS (SELECT *, {_case(name, weights)} AS w FROM (SELECT {cols}, CAST(sum(supply) * {EPOCHS} AS BIGINT) AS cap FROM leaf GROUP BY {cols}) {using}),
o{k} AS (SELECT *, CAST(sum(cap) OVER q - cap AS BIGINT) AS bef, CAST(sum(w) OVER r AS BIGINT) AS rest
  FROM (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM n{k})
  WINDOW q AS ({part} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING), r AS ({part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p{k} AS (SELECT *, min(CASE WHEN cap * rest <= (budget - bef) * w THEN 1 ELSE 0 END) OVER ({part} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS filled FROM o{k}),
b{k} AS (SELECT {cols}, CASE WHEN filled = 1 THEN cap ELSE least(cap,
  max(CASE WHEN filled = 0 THEN budget - bef END) OVER ({part}) * w // max(CASE WHEN filled = 0 THEN rest END) OVER ({part})) END AS budget FROM p{k})""")
        up = f"b{k}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '{_NONE}') AS lang, coalesce(source, '{_NONE}') AS source,
  CASE WHEN TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) < 10 THEN 'web'
       WHEN TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) < 15 THEN 'books' ELSE 'forum' END AS domain,
  CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE strlen(text) > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
top AS (SELECT CAST(sum(supply) * {SHARE[0]} // {SHARE[1]} AS BIGINT) AS budget FROM leaf),{','.join(steps)},
plan AS (SELECT domain, lang, source, budget // supply AS whole, budget % supply AS part FROM leaf JOIN b2 USING (domain, lang, source)),
l AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{SEED}', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(e.epoch AS BIGINT) AS epoch, tokens, tokens AS take FROM d JOIN plan USING (domain, lang, source) JOIN range(0, {EPOCHS}) AS e(epoch) ON e.epoch < whole
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), tokens, CAST(least(tokens, part - start) AS BIGINT) FROM l WHERE start < part"""


QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": _sql()}
