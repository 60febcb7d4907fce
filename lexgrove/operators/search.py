"""Execution of queries: match set, scores, top-k.

The match set is a predicate over the documents' scan.  Scores come from one of
two places: from the scan itself, where a term's frequency is counted in the row
that is matched anyway, so only the collection's totals need another pass; or
from stored postings, read only for the query's terms and joined on doc_id.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidArgument, UnsupportedQuery
from ..functions.text import Analyzer
from ..plans import scan
from ..plans.ast import Bool, Node, Term
from ..plans.validate import Limits, rewrite, validate
from .scoring import BM25, Constant, Scorer, TfIdf, explanation


@dataclass(frozen=True)
class Config:
    scorer: Scorer = BM25()
    scoring: bool = True
    optimize: bool = True
    explain: bool = False
    cache: bool = True
    #: "tokens" or, as an alternative, "tf"
    doc_length: str = "tokens"
    limits: Limits = Limits()
    #: "scan" finds terms as parts of the text, "index" as analyzed words of a stored index
    match: str = "scan"
    timeout_ms: int | None = None


DEFAULT = Config()
SIMPLE = Config(optimize=False, cache=False, scoring=False, scorer=Constant())
DEBUG = Config(explain=True, cache=False)
WITH_BM25 = Config()
WITH_TFIDF = Config(scorer=TfIdf())


@dataclass(frozen=True)
class Leaf:
    """A scoring term (None: a constant) with the product of the boosts above it."""

    term: tuple[str, str] | None
    weight: float


def leaves(q: Node, weight: float = 1.0) -> list[Leaf]:
    """A query's score is a weighted sum over these: must and should count, filters and must_not don't."""
    if isinstance(q, Bool):
        return [x for c in (*q.must, *q.should) for x in leaves(c, weight * q.boost)]
    if isinstance(q, Term):
        return [Leaf((q.field, q.value), weight * q.boost)]
    return [Leaf(None, weight)]


def _frequency(analyzer: Analyzer, value: str, column: str) -> Column:
    """How often the analyzed words of a term are in an array column of the same row."""
    wanted = analyzer.plain(value)
    return F.size(F.filter(F.col(column), lambda t: t.isin(wanted))).cast("double") if wanted else F.lit(0.0)


def scored(docs: DataFrame, q: Node, config: Config = DEFAULT, default_fields: scan.Fields | None = None, known: dict | None = None) -> DataFrame:
    """All matching rows of ``docs`` with a score column (and explanation).

    Totals (documents, lengths, document frequencies) are taken over all documents
    by one aggregation without a shuffle of rows; ``known`` keeps them for further
    queries of the same documents.
    """
    fields = default_fields or scan.Fields.of(docs.schema)
    q = validate(rewrite(q) if config.optimize else q, config.limits)
    predicate = scan.matches(q, fields)
    parts = leaves(q)
    if not config.scoring or isinstance(config.scorer, Constant):
        out = docs.where(predicate).withColumn("_score", F.lit(1.0))
        return out.withColumn("_explanation", explanation(F.col("_score"), "constant")) if config.explain else out
    names = sorted({n for x in parts if x.term for n in (fields.texts() if x.term[0] == scan.ALL else [x.term[0]]) if fields.is_text(n)})
    tokens = {n: f"__tokens_{k}" for k, n in enumerate(names)}
    wide = docs.withColumns({tokens[n]: F.coalesce(fields.analyzer(n).terms(F.col(f"`{n}`")), F.array().cast("array<string>")) for n in names})
    wanted: list[tuple[str, str]] = []
    for x in parts:
        if x.term:
            for n in fields.texts() if x.term[0] == scan.ALL else [x.term[0]]:
                if fields.is_text(n) and (n, x.term[1]) not in wanted:
                    wanted.append((n, x.term[1]))
    tf = {key: _frequency(fields.analyzer(key[0]), key[1], tokens[key[0]]) for key in wanted}
    aggs = [F.count("*").alias("n")]
    aggs += [F.coalesce(F.sum(F.size(tokens[n])), F.lit(0)).alias(f"len_{tokens[n]}") for n in names]
    aggs += [F.count_if(tf[key] > 0).alias(f"df_{k}") for k, key in enumerate(wanted)]
    known = {} if known is None else known
    totals = (tuple(names), tuple(wanted))
    stats = known[totals] if totals in known else known.setdefault(totals, wide.agg(*aggs).first())
    n_docs = float(stats["n"])
    rows = wide.where(predicate)
    total, details = F.lit(0.0), []
    for x in parts:
        if x.term is None:
            total = total + F.lit(x.weight)
            continue
        for n in fields.texts() if x.term[0] == scan.ALL else [x.term[0]]:
            if not fields.is_text(n):
                continue
            key = (n, x.term[1])
            f, length = tf[key], F.size(tokens[n]).cast("double")
            avgdl = stats[f"len_{tokens[n]}"] / n_docs if n_docs else 0.0
            value = F.log(F.lit((n_docs + 1.0) / (stats[f"df_{wanted.index(key)}"] + 1.0)))
            dl = f if config.doc_length == "tf" else length
            s = F.when(f > 0, config.scorer.score(f, dl, F.lit(avgdl), value, x.weight)).otherwise(0.0)
            total = total + s
            details.append((value, f"idf({n}:{x.term[1]})"))
    out = rows.withColumn("_score", total)
    if config.explain:
        out = out.withColumn("_explanation", explanation(F.col("_score"), f"{config.scorer.name}, sum of the parts", details if isinstance(q, Term) else []))
    return out.drop(*tokens.values())


def scored_by_postings(docs: DataFrame, postings: DataFrame, dictionary: DataFrame, lengths: DataFrame, n_docs: int, avgdl: float, q: Node, config: Config = DEFAULT, fields: scan.Fields | None = None) -> DataFrame:
    """As ``scored``, from a stored index: of postings and dictionary only the query's terms are read.

    ``dictionary`` rows of the query's terms are few and bounded by the query, so
    they are broadcast; matched rows without postings score 0 for a term.
    """
    fields = fields or scan.Fields.of(docs.schema)
    q = validate(rewrite(q) if config.optimize else q, config.limits)
    rows = docs.where(scan.matches(q, fields))
    weights: dict[tuple[str, str], float] = {}
    constant = 0.0
    for x in leaves(q):
        if x.term is None:
            constant += x.weight
        else:
            for n in fields.texts() if x.term[0] == scan.ALL else [x.term[0]]:
                for w in fields.analyzer(n).plain(x.term[1]):
                    weights[n, w] = weights.get((n, w), 0.0) + x.weight
    if not weights:
        return rows.withColumn("_score", F.lit(constant))
    wanted = docs.sparkSession.createDataFrame([(f, t, w) for (f, t), w in weights.items()], "field string, term string, weight double")
    listed = sorted({t for _, t in weights})
    slice_ = dictionary.where(F.col("term").isin(listed)).join(F.broadcast(wanted), ["field", "term"])  # one row a query term
    hits = postings.where(F.col("term").isin(listed)).select("field", "term", "doc_id", "tf").join(F.broadcast(slice_.select("field", "term", "idf", "weight")), ["field", "term"])
    hits = hits.join(lengths, "doc_id")
    tf = F.col("tf").cast("double")
    dl = tf if config.doc_length == "tf" else F.col("dl").cast("double")
    value = config.scorer.score(tf, dl, F.lit(float(avgdl)), F.col("idf")) * F.col("weight")
    sums = hits.groupBy("doc_id").agg(F.sum(value).alias("__sum"))
    return rows.join(sums, "doc_id", "left").withColumn("_score", F.coalesce("__sum", F.lit(0.0)) + constant).drop("__sum")


def top(rows: DataFrame, limit: int = 10, offset: int = 0, sort: list[Column] | None = None) -> DataFrame:
    """The best rows by score, ties by doc_id; planned as a bounded heap per partition."""
    if limit < 0 or offset < 0:
        raise InvalidArgument("limit and offset can't be negative")
    order = sort or [F.col("_score").desc()]
    out = rows.orderBy(*order, F.col("doc_id").asc()).limit(limit + offset)
    return out.offset(offset) if offset else out


def after(rows: DataFrame, score: float, doc_id: int, limit: int = 10) -> DataFrame:
    """The page behind a hit, by keyset: no rows before it are sorted."""
    return top(rows.where((F.col("_score") < score) | ((F.col("_score") == score) & (F.col("doc_id") > doc_id))), limit)


@dataclass
class FirstMatches:
    """A collector that has enough after so many hits."""

    most: int
    hits: list = field(default_factory=list)

    def collect(self, hit: Row) -> bool:
        """Whether to go on."""
        self.hits.append(hit)
        return len(self.hits) < self.most


def collect_until(rows: DataFrame, collector) -> object:  # noqa: ANN001
    """Offers hits one by one, partition by partition, until the collector has enough; later partitions aren't run."""
    for hit in rows.toLocalIterator():
        if not collector.collect(hit):
            break
    return collector


def first_n(rows: DataFrame, n: int) -> DataFrame:
    """Any n rows: no sort, the scan stops early."""
    return rows.limit(n)


@dataclass(frozen=True)
class Results:
    hits: DataFrame
    total_hits: int
    max_score: float | None
    took_ms: float


@dataclass(frozen=True)
class Pipeline:
    """Any scorer with any collector."""

    scorer: Scorer = BM25()
    collector: Callable[[DataFrame], DataFrame] = top
    config: Config = DEFAULT

    def run(self, docs: DataFrame, q: Node, fields: scan.Fields | None = None) -> DataFrame:
        return self.collector(scored(docs, q, replace(self.config, scorer=self.scorer), fields))

    def execute(self, *_: object) -> DataFrame:
        raise UnsupportedQuery("a pipeline needs documents; call run")


def summary(rows: DataFrame, limit: int = 10, offset: int = 0) -> Results:
    """Hits with the number and best score of all matches."""
    began = time.perf_counter()
    r = rows.agg(F.count("*").alias("n"), F.max("_score").alias("best")).first()
    return Results(top(rows, limit, offset), r.n, r.best, (time.perf_counter() - began) * 1000)
