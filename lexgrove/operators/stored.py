"""Search over a stored index: match sets and scores from postings, without reading texts.

Files of postings and dictionary are ordered by term, so a query reads the row groups and
pages of its own terms.  A posting holds its field's length (in ``field_norm``), so scores need no join
with lengths.  Terms match as analyzed words, not as parts of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedQuery
from ..plans import scan
from ..plans.ast import Bool, Fuzzy, MatchAll, Node, Phrase, Prefix, Range, Term, Wildcard
from ..plans.validate import rewrite, validate
from . import expand
from .scoring import Constant
from .search import DEFAULT, Config, leaves


@dataclass(frozen=True)
class StoredIndex:
    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    n_docs: int
    #: tokens of all documents by field
    tokens: dict[str, int]
    fields: scan.Fields

    def _texts(self, name: str) -> list[str]:
        return self.fields.texts() if name == scan.ALL else [name] if self.fields.is_text(name) else []

    def _any_of(self, sets: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, sets).distinct() if sets else self.docs.select("doc_id").limit(0)

    def _of_terms(self, name: str, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Documents with any of the dictionary's terms that are picked."""
        parts = []
        for n in self._texts(name):
            terms = pick(self.dictionary.where(F.col("field") == n)).select("term")
            parts.append(self.postings.where(F.col("field") == n).join(terms, "term", "left_semi").select("doc_id"))
        return self._any_of(parts)

    def matching(self, q: Node) -> DataFrame:
        """doc_id of the documents that a query matches by analyzed words; each once."""
        if isinstance(q, MatchAll):
            return self.docs.select("doc_id").distinct()
        if isinstance(q, Term):
            plain = {n: self.fields.analyzer(n).plain(q.value) for n in self._texts(q.field)}
            return self._any_of([expand.intersect(self.postings, ws, n) for n, ws in plain.items() if ws])
        if isinstance(q, Phrase):
            plain = {n: self.fields.analyzer(n).plain(" ".join(q.terms)) for n in self._texts(q.field)}
            return self._any_of([expand.phrase(self.postings, ws, q.slop, n) for n, ws in plain.items() if ws])
        if isinstance(q, Prefix):
            begins = F.col("term").startswith(q.value.lower())  # found by the files' statistics, without the dictionary
            return self._any_of([self.postings.where((F.col("field") == n) & begins).select("doc_id") for n in self._texts(q.field)])
        if isinstance(q, Wildcard):
            pattern = scan.wildcard_regex(q.pattern.lower(), anchored=True)
            return self._of_terms(q.field, lambda d: d.where(F.col("term").rlike(pattern)))
        if isinstance(q, Fuzzy):
            return self._of_terms(q.field, lambda d: expand.fuzzy(d, q.value.lower(), q.max_edits, q.prefix_length, q.transpositions))
        if isinstance(q, Range):
            return self.docs.where(scan.matches(q, self.fields)).select("doc_id").distinct()
        if isinstance(q, Bool):
            sets = [self.matching(c) for c in (*q.must, *q.filter)]
            if q.should:
                if q.minimum_should_match is None:
                    sets.append(self._any_of([self.matching(c) for c in q.should]))
                else:
                    votes = reduce(DataFrame.unionByName, [self.matching(c) for c in q.should]).groupBy("doc_id").agg(F.count("*").alias("votes"))
                    least = q.minimum_should_match
                    sets.append(votes.where(F.col("votes") >= least).select("doc_id") if least > 0 else self.docs.select("doc_id").distinct())
            found = expand.intersect_all(sets) if sets else self.docs.select("doc_id").distinct()
            return reduce(expand.difference, [self.matching(c) for c in q.must_not], found)
        raise UnsupportedQuery(f"no index lookup for {type(q).__name__}")

    def sums(self, q: Node, config: Config = DEFAULT) -> tuple[DataFrame | None, float]:
        """(doc_id and the sum of its terms' scores, what every match gets besides); no rows for queries without terms."""
        weights: dict[tuple[str, str], float] = {}
        constant = 0.0
        for x in leaves(q):
            if x.term is None:
                constant += x.weight
                continue
            for n in self._texts(x.term[0]):
                # as many words of a term as there are count together, with the document frequency of any of them
                words = tuple(dict.fromkeys(self.fields.analyzer(n).plain(x.term[1])))
                for w in words:
                    weights[n, w] = weights.get((n, w), 0.0) + x.weight
        if not weights:
            return None, constant
        of_terms = F.col("field").isin(sorted({f for f, _ in weights})) & F.col("term").isin(sorted({t for _, t in weights}))
        known = {(r.field, r.term): r.idf for r in self.dictionary.where(of_terms).select("field", "term", "idf").collect()}  # a row a term of the query
        rows = [(f, t, w, known[f, t], self.tokens.get(f, 0) / max(self.n_docs, 1)) for (f, t), w in weights.items() if (f, t) in known]
        wanted = self.docs.sparkSession.createDataFrame(rows, "field string, term string, weight double, idf double, avgdl double")
        hits = self.postings.where(of_terms).select("field", "term", "doc_id", "tf", "field_norm").join(F.broadcast(wanted), ["field", "term"])
        tf = F.col("tf").cast("double")
        dl = tf if config.doc_length == "tf" else F.round(1.0 / (F.col("field_norm") * F.col("field_norm")))
        value = config.scorer.score(tf, dl, F.col("avgdl"), F.col("idf")) * F.col("weight")
        return hits.groupBy("doc_id").agg(F.sum(value).alias("__sum")), constant

    def scored(self, q: Node, config: Config = DEFAULT) -> DataFrame:
        """doc_id and _score of all matches; with ``config.match`` "scan" whole rows, matched as parts of the text."""
        q = validate(rewrite(q) if config.optimize else q, config.limits)
        found = self.docs.where(scan.matches(q, self.fields)) if config.match == "scan" else self.matching(q)
        if not config.scoring or isinstance(config.scorer, Constant):
            return found.withColumn("_score", F.lit(1.0))
        sums, constant = self.sums(q, config)
        if sums is None:
            return found.withColumn("_score", F.lit(constant))
        return found.join(sums, "doc_id", "left").withColumn("_score", F.coalesce("__sum", F.lit(0.0)) + constant).drop("__sum")
