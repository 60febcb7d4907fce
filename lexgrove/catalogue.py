"""Registered queries of the search engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidState
from .functions import arrays, text
from .operators import expand, index, layout, scoring, search
from .plans import scan
from .plans.ast import Bool, Fuzzy, MatchAll, Node, Phrase, Prefix, Range, Term, Wildcard
from .plans.parser import Parser

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# match sets


def _matching(name: str, q: Node, where: str, table: str = "documents", key: str = "doc_id") -> None:
    """A query that gives the keys of a table's matching rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return rows.where(scan.matches(q, scan.Fields.of(rows.schema))).select(key)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key} FROM {table} WHERE {where}"


_the, _of, _and, _tion = (Term("text", w) for w in ("the", "of", "and", "TION"))
_has = "contains(lower(text), '{}')".format
_matching("term_contains", _the, _has("the"))
_matching("term_ignores_case", _tion, _has("tion"))
_matching("term_field", Term("source", "src1"), "contains(source, 'src1')")
_matching("term_all_fields", Term("_all", "SRC1"), "contains(lower(text), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(source), 'src1')")
_matching("bool_and", Bool(must=(_the, _of)), f"{_has('the')} AND {_has('of')}")
_matching("bool_or", Bool(should=(Term("text", "ñ"), Term("text", "ß"))), f"{_has('ñ')} OR {_has('ß')}")
_matching("bool_not", Bool(must=(_the,), must_not=(_and,)), f"{_has('the')} AND NOT {_has('and')}")
_matching("bool_mixed", Bool(must=(_the,), should=(_of, _and), must_not=(Term("source", "src0"),)), f"{_has('the')} AND ({_has('of')} OR {_has('and')}) AND NOT contains(source, 'src0')")
_matching("bool_min_should_match", Bool(should=(_the, _of, _and, Term("text", "que")), minimum_should_match=3), f"CAST({_has('the')} AS INT) + CAST({_has('of')} AS INT) + CAST({_has('and')} AS INT) + CAST({_has('que')} AS INT) >= 3")
_matching("bool_filter", Bool(must=(_the,), filter=(Term("lang", "en"), Range("n_chars", lt=2000.0))), f"{_has('the')} AND contains(lang, 'en') AND n_chars < 2000")
_matching("bool_nested", Bool(must=(Bool(should=(_of, Term("text", "und"))), Bool(must_not=(Term("lang", "fr"),)))), f"({_has('of')} OR {_has('und')}) AND NOT contains(lang, 'fr')")
_matching("range_incl", Range("n_chars", gte=1000.0, lte=2000.0), "n_chars >= 1000 AND n_chars <= 2000")
# whole numbers from 1 to 50, so both bounds are met by rows
_matching("range_bounds", Range("p_size", gte=10.0, lte=20.0), "p_size BETWEEN 10 AND 20", "part", "p_partkey")
_matching("range_excl", Range("p_size", gt=10.0, lt=20.0), "p_size > 10 AND p_size < 20", "part", "p_partkey")
_matching("range_open", Range("n_chars", gte="*", lte=1500.0), "n_chars <= 1500")
_matching("range_on_text", Range("source", gte=1.0), "false")
_matching("range_date", Range("ts", gte=datetime(2024, 1, 5), lt=datetime(2024, 1, 10)), "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'", "events", "event_id")
_matching("range_price", Range("o_totalprice", gt=100000.0, lte=200000.0), "o_totalprice > 100000 AND o_totalprice <= 200000", "orders", "o_orderkey")
_words = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> '')".format
_matching("prefix_text", Prefix("text", "Th"), f"len(list_filter({_words('text')}, lambda w: starts_with(w, 'Th'))) > 0")
_matching("prefix_words", Prefix("p_name", "bl"), f"len(list_filter({_words('p_name')}, lambda w: starts_with(w, 'bl'))) > 0", "part", "p_partkey")
_matching("prefix_customer", Prefix("c_name", "Customer#00000"), "starts_with(c_name, 'Customer#00000')", "customer", "c_custkey")
_matching("wildcard_star", Wildcard("text", "th*io"), "regexp_matches(text, 'th.*io')")
_matching("wildcard_qmark", Wildcard("text", "t?on o?"), "regexp_matches(text, 't.on o.')")
_matching("wildcard_html", Wildcard("html", "<h1>*the*</h1>"), "regexp_matches(html, '<h1>.*the.*</h1>')", "pages", "page_id")
_near = "len(list_filter({0}, lambda w: w <> '' AND levenshtein(w, '{1}') <= {2})) > 0"
_bare = "list_transform(string_split(lower(p_name), ' '), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"
_matching("fuzzy_1", Fuzzy("p_name", "blu", 1), _near.format(_bare, "blu", 1), "part", "p_partkey")
_matching("fuzzy_2", Fuzzy("p_name", "anvl", 2), _near.format(_bare, "anvl", 2), "part", "p_partkey")
_matching("match_all", MatchAll(), "true")

_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')".format
_T = f"SELECT doc_id, {_TOKENS('text')} AS w FROM documents"
_phrase = "len(list_filter(range(1, len(w) - {1} + 2), lambda i: w[i:i + {1} - 1] = {0})) > 0".format
_matching("phrase_scan", Phrase("text", ("of", "the")), f"doc_id IN (SELECT doc_id FROM ({_T}) WHERE {_phrase(['of', 'the'], 2)})")

_parser = Parser(default_field="text")
for _name, _string, _where in (
    ("parsed_compat_and", "the AND of", f"{_has('the')} AND {_has('of')}"),
    ("parsed_compat_not", "the NOT und", f"{_has('the')} AND NOT {_has('und')}"),
    ("parsed_compat_mixed", "the AND of OR que", f"{_has('of')} AND ({_has('the')} OR {_has('que')})"),
    ("parsed_compat_literal", "of the", _has("of the")),
    ("parsed_compat_range", "n_chars:[500 TO 900}", "n_chars >= 500 AND n_chars < 900"),
    ("parsed_compat_prefix", "source:src1*", "starts_with(source, 'src1')"),
    ("parsed_compat_all", "", "true"),
    ("parsed_compat_field", "lang:en", "contains(lang, 'en')"),
    ("parsed_compat_phrase", '"of the"', f"doc_id IN (SELECT doc_id FROM ({_T}) WHERE {_phrase(['of', 'the'], 2)})"),
    ("parsed_compat_wild_field", "source:s*c?", "regexp_matches(source, 's.*c.')"),
    ("parsed_compat_bare_wildcard", "th*io", "regexp_matches(text, 'th.*io')"),
):
    _matching(_name, _parser.parse(_string), _where)
_matching("parsed_compat_fuzzy", Parser(default_field="p_name").parse("blu~1"), _near.format(_bare, "blu", 1), "part", "p_partkey")
_matching("parsed_extended", Parser(default_field="text", syntax="extended").parse('(lang:en OR lang:de) AND NOT source:src1* AND n_chars:[* TO 3000] AND "of the"'), f"(contains(lang, 'en') OR contains(lang, 'de')) AND NOT starts_with(source, 'src1') AND n_chars <= 3000 AND doc_id IN (SELECT doc_id FROM ({_T}) WHERE {_phrase(['of', 'the'], 2)})")


# analysis and the index


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_docs(spark, sf_dir), ["text"])


_P = f"""t AS ({_T}),
x AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p, len(w) AS n FROM t),
p AS (SELECT doc_id, term, count(*) AS tf, list_sort(list(p)) AS positions, any_value(n) AS n FROM x GROUP BY doc_id, term)"""


@register("tokenize_simple", f"SELECT doc_id, unnest(w) AS term, CAST(unnest(range(0, len(w))) AS INT) AS position FROM ({_T})")
def _tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.SIMPLE.terms(F.col("text"))).alias("position", "term"))


@register("stopword_filter", f"SELECT doc_id, CAST(len(list_filter(w, lambda t: NOT list_contains({list(text.ENGLISH_STOP_WORDS)}, t))) AS BIGINT) AS kept, CAST(len(w) AS BIGINT) AS words FROM ({_T})")
def _stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.Analyzer("plain", text.simple_tokenizer, (text.stop_words(),))
    return _docs(spark, sf_dir).select("doc_id", F.size(plain.terms(F.col("text"))).cast("long").alias("kept"), F.size(text.SIMPLE.terms(F.col("text"))).cast("long").alias("words"))


@register(
    "ngram_2_3",
    """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
n AS (SELECT w, unnest(range(2, 4)) AS n, p_partkey FROM w)
SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) AS gram FROM n) GROUP BY gram""",
)
def _ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = text.Analyzer("grams", text.simple_tokenizer, (text.ngram_filter(2, 3),))
    return _table(spark, sf_dir, "part").select(F.explode(grams.terms(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@register("postings_build", f"WITH {_P} SELECT term, doc_id, CAST(tf AS BIGINT) AS tf, CAST(positions[1] AS INT) AS first, CAST(positions[len(positions)] AS INT) AS last FROM p")
def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


@register("term_dictionary", f"WITH {_P} SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_freq FROM p GROUP BY term")
def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dictionary(_postings(spark, sf_dir), 1).select("term", "doc_freq", "total_freq")


@register("idf", f"WITH {_P} SELECT term, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)), 6) AS idf FROM p GROUP BY term")
def _idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).count()
    return index.dictionary(_postings(spark, sf_dir), n).select("term", F.round("idf", 6).alias("idf"))


@register("index_stats", f"WITH {_P} SELECT (SELECT count(*) FROM t) AS n_docs, CAST((SELECT sum(len(w)) FROM t) AS BIGINT) AS total_tokens, (SELECT count(DISTINCT term) FROM p) AS unique_terms, round((SELECT sum(len(w)) FROM t) / (SELECT count(*) FROM t), 6) AS avgdl")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return index.index_stats(index.doc_lengths(docs, "text"), _postings(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@register("field_norm", f"SELECT doc_id, round(1.0 / sqrt(len(w)), 6) AS field_norm FROM ({_T}) WHERE len(w) > 0")
def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = index.doc_lengths(_docs(spark, sf_dir), "text").where("dl > 0")
    return lengths.select("doc_id", F.round(1.0 / F.sqrt("dl"), 6).alias("field_norm"))


@register("phrase_exact", f"SELECT doc_id FROM ({_T}) WHERE {_phrase(['of', 'the'], 2)}")
def _phrase_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.phrase(_postings(spark, sf_dir), ["of", "the"])


@register("phrase_slop", f"WITH {_P} SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term = 'the' AND b.term = 'of' AND b.p BETWEEN a.p + 1 AND a.p + 3")
def _phrase_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.phrase(_postings(spark, sf_dir), ["the", "of"], slop=2)


@register("phrase_slop_scan", f"WITH {_P} SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term = 'the' AND b.term = 'of' AND b.p BETWEEN a.p + 1 AND a.p + 3")
def _phrase_slop_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir)
    return rows.where(scan.matches(Phrase("text", ("the", "of"), 2), scan.Fields.of(rows.schema))).select("doc_id")


@register("terms_intersect", f"SELECT doc_id FROM ({_T}) WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'and')")
def _intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.intersect(_postings(spark, sf_dir), ["the", "of", "and"])


@register("terms_union", f"SELECT doc_id FROM ({_T}) WHERE list_contains(w, 'der') OR list_contains(w, 'que')")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.union(_postings(spark, sf_dir), ["der", "que"])


@register("terms_difference", f"SELECT doc_id FROM ({_T}) WHERE list_contains(w, 'the') AND NOT list_contains(w, 'that')")
def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir)
    return expand.difference(expand.union(rows, ["the"]), expand.union(rows, ["that"]))


def _terms(spark: SparkSession, sf_dir: str, table: str = "documents", column: str = "text") -> DataFrame:
    return _table(spark, sf_dir, table).select(F.explode(text.SIMPLE.terms(F.col(column))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_D = f"WITH d AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM ({_T})) GROUP BY term)"


@register("expand_prefix", f"{_D} SELECT term, n FROM d WHERE starts_with(term, 'then')")
def _expand_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.prefix(_terms(spark, sf_dir), "then")


@register("expand_wildcard", f"{_D} SELECT term, n FROM d WHERE term LIKE 'th%ing'")
def _expand_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.wildcard(_terms(spark, sf_dir), "th*ing")


@register("expand_regex", f"{_D} SELECT term, n FROM d WHERE regexp_matches(term, '^(an|on)+$')")
def _expand_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.regex(_terms(spark, sf_dir), "^(an|on)+$")


@register("expand_fuzzy", f"WITH d AS (SELECT unnest({_TOKENS('p_name')}) AS term FROM part) SELECT term, count(*) AS n, CAST(levenshtein(term, 'blake') AS BIGINT) AS distance FROM d WHERE levenshtein(term, 'blake') <= 2 GROUP BY term")
def _expand_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.fuzzy(_terms(spark, sf_dir, "part", "p_name"), "blake").withColumn("distance", F.col("distance").cast("long"))


@register("expand_fuzzy_swaps", f"WITH d AS (SELECT unnest({_TOKENS('p_name')}) AS term FROM part) SELECT term, count(*) AS n, CAST(damerau_levenshtein(term, 'bleu') AS BIGINT) AS distance FROM d WHERE damerau_levenshtein(term, 'bleu') <= 1 GROUP BY term")
def _expand_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.fuzzy(_terms(spark, sf_dir, "part", "p_name"), "bleu", 1, transpositions=True).withColumn("distance", F.col("distance").cast("long"))


@register("stem_english")
def _stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir)
    return terms.select("term", text.stem_word(F.col("term")).alias("stem"), "n")


@register("standard_tokens")
def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(text.STANDARD(F.col("text"))).alias("t")).select("doc_id", "t.*")


_UW = "[\\p{L}\\p{M}\\p{N}_]+(?:[''’.·:][\\p{L}\\p{M}\\p{N}_]+)*"


@register(
    "vietnamese_tokens",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{_UW}'), lambda w: strlen(w) <= 255) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS p FROM t)
SELECT doc_id, lower(w) AS text, CAST(p AS INT) AS position, CAST(strlen(w) AS INT) AS length, 'word' AS token_type,
  CAST(sum(strlen(w) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) - strlen(w) - 1 AS INT) AS token_offset FROM x""",
)
def _vietnamese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(text.VIETNAMESE(F.col("text"))).alias("t")).select("doc_id", "t.text", "t.position", "t.length", "t.token_type", F.col("t.offset").alias("token_offset"))


# ranking

_MATCH = "w AS (SELECT doc_id, text, {0} AS ws FROM documents), c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS avgdl FROM w)".format(_TOKENS("text"))


def _tf(term: str) -> str:
    return f"CAST(len(list_filter(ws, lambda t: t = '{term}')) AS DOUBLE)"


def _idf_sql(term: str) -> str:
    return f"ln(((SELECT n FROM c) + 1.0) / ((SELECT count(*) FROM w WHERE list_contains(ws, '{term}')) + 1.0))"


def _bm25_sql(term: str, weight: float = 1.0) -> str:
    return f"CASE WHEN {_tf(term)} > 0 THEN {_idf_sql(term)} * {_tf(term)} * 2.2 / ({_tf(term)} + 1.2 * (0.25 + 0.75 * len(ws) / (SELECT avgdl FROM c))) * {weight} ELSE 0 END"


def _ranked(name: str, q: Node, where: str, score: str, config: search.Config = search.DEFAULT, limit: int = 10, offset: int = 0) -> None:
    """The best hits of a query: doc_id and score."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = search.scored(_docs(spark, sf_dir), q, config)
        # the order is that of rounded scores, so that summation order can't move a hit
        rows = rows.select("doc_id", F.round("_score", 6).alias("_score"))
        return search.top(rows, limit, offset).withColumnRenamed("_score", "score")

    QUERIES[name] = run
    ORACLE[name] = f"WITH {_MATCH} SELECT doc_id, round(CAST({score} AS DOUBLE), 6) AS score FROM w WHERE {where} ORDER BY score DESC, doc_id LIMIT {limit} OFFSET {offset}"


_ranked("bm25_term", Term("text", "thing"), _has("thing"), _bm25_sql("thing"))
_ranked("bm25_bool_or", Bool(should=(Term("text", "thing"), Term("text", "heant"))), f"{_has('thing')} OR {_has('heant')}", f"{_bm25_sql('thing')} + {_bm25_sql('heant')}")
_ranked("bm25_bool_and", Bool(must=(_the, Term("text", "thing"))), f"{_has('the')} AND {_has('thing')}", f"{_bm25_sql('the')} + {_bm25_sql('thing')}")
_ranked("tfidf_norm", _of, _has("of"), f"CASE WHEN {_tf('of')} > 0 THEN {_tf('of')} / len(ws) * {_idf_sql('of')} ELSE 0 END", search.WITH_TFIDF)
_ranked("tfidf_raw", _of, _has("of"), f"{_tf('of')} * {_idf_sql('of')}", search.Config(scorer=scoring.TfIdf(normalized=False)))
_ranked("boosted_bool", Bool(must=(Term("text", "of", boost=2.0),), should=(Term("text", "that", boost=3.0),), boost=0.5), f"{_has('of')} AND {_has('that')}", f"{_bm25_sql('of', 1.0)} + {_bm25_sql('that', 1.5)}")
_ranked("topk_ties", MatchAll(), "true", "1.0", limit=25)
_ranked("topk_offset", Term("text", "thing"), _has("thing"), _bm25_sql("thing"), limit=10, offset=10)
_ranked("constant_score", Prefix("text", "The"), f"len(list_filter({_words('text')}, lambda w: starts_with(w, 'The'))) > 0", "1.0", limit=20)
_ranked("no_scoring", _of, _has("of"), "1.0", search.SIMPLE, limit=20)


@register("bm25_postings", f"WITH {_MATCH} SELECT doc_id, round({_bm25_sql('thing')} + {_bm25_sql('of')}, 6) AS score FROM w WHERE {_has('thing')} AND {_has('of')}")
def _bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches, scored by a join with postings of the query's terms."""
    docs = _docs(spark, sf_dir)
    lengths, rows = index.doc_lengths(docs, "text"), _postings(spark, sf_dir)
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    q = Bool(must=(Term("text", "thing"), _of))
    return search.scored_by_postings(docs, rows, index.dictionary(rows, stats.n), lengths, stats.n, stats.avgdl or 0.0, q).select("doc_id", F.round("_score", 6).alias("score"))


@register("search_summary", f"WITH {_MATCH}, s AS (SELECT round({_bm25_sql('thing')}, 6) AS score FROM w WHERE {_has('thing')}) SELECT count(*) AS total_hits, max(score) AS max_score FROM s")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(_docs(spark, sf_dir), Term("text", "thing")).agg(F.count("*").alias("total_hits"), F.max(F.round("_score", 6)).alias("max_score"))


@register("keyset_page", f"WITH {_MATCH}, s AS (SELECT doc_id, round({_bm25_sql('thing')}, 6) AS score FROM w WHERE {_has('thing')}), e AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 1 OFFSET 9) SELECT s.doc_id, s.score FROM s, e WHERE s.score < e.score OR (s.score = e.score AND s.doc_id > e.doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def _keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.scored(_docs(spark, sf_dir), Term("text", "thing")).select("doc_id", F.round("_score", 6).alias("_score"))
    last = search.top(rows, 1, 9).first()
    return search.after(rows, last["_score"], last["doc_id"], 10).withColumnRenamed("_score", "score") if last else rows.limit(0).withColumnRenamed("_score", "score")


@register("explain_score", f"WITH {_MATCH} SELECT doc_id, round({_bm25_sql('thing')}, 6) AS score, round({_bm25_sql('thing')}, 6) AS value, 'bm25, sum of the parts' AS description, round({_idf_sql('thing')}, 6) AS part, 'idf(text:thing)' AS part_description FROM w WHERE {_has('thing')} ORDER BY score DESC, doc_id LIMIT 10")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.scored(_docs(spark, sf_dir), Term("text", "thing"), search.DEBUG).withColumn("_score", F.round("_score", 6))
    best, detail = search.top(rows, 10), F.col("_explanation.details")[0]
    return best.select("doc_id", F.col("_score").alias("score"), F.round("_explanation.value", 6).alias("value"), "_explanation.description", F.round(detail["value"], 6).alias("part"), detail["description"].alias("part_description"))


@register("sort_on_field", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 15")
def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return search.top(rows.where(scan.matches(_the, scan.Fields.of(rows.schema))), 15, sort=[F.col("n_chars").desc()]).select("doc_id", "n_chars")


@register("intersect_all", f"SELECT doc_id FROM ({_T}) WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND (list_contains(w, 'que') OR list_contains(w, 'in'))")
def _intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir)
    return expand.intersect_all([expand.union(rows, ["the"]), expand.union(rows, ["of"]), expand.union(rows, ["que", "in"])])


@register("array_scale", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2.5)), 4) AS total FROM embeddings")
def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = arrays.scale(F.transform("embedding", lambda x: x.cast("double")), 2.5)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register("dot_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm FROM embeddings")
def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.dot_product(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@register("sorted_sets", "SELECT o_custkey, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_union, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_both FROM (SELECT o_custkey, list(DISTINCT month(o_orderdate)) FILTER (WHERE year(o_orderdate) % 2 = 0) AS a, list(DISTINCT month(o_orderdate)) FILTER (WHERE year(o_orderdate) % 2 = 1) AS b FROM orders GROUP BY o_custkey) WHERE a IS NOT NULL AND b IS NOT NULL")
def _sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.year("o_orderdate") % 2 == 0
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(even, F.month("o_orderdate"))).alias("a"), F.collect_set(F.when(~even, F.month("o_orderdate"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    return rows.select("o_custkey", F.size(arrays.sorted_union(F.col("a"), F.col("b"))).cast("long").alias("n_union"), F.size(arrays.sorted_intersect(F.col("a"), F.col("b"))).cast("long").alias("n_both"))


# the store


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may do without one in its settings."""
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have and not spark.sparkContext.master.startswith("local"):
        raise InvalidState("spark.checkpoint.dir must name a folder that all executors share")
    return have or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


_built: dict[tuple[str, str], object] = {}


def _stored(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """An index of the documents with its postings; built once a session and folder, as an index is there to be searched many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        ix = _store(spark, sf_dir)
        ix.build_index()
        _built[key] = ix
    return _built[key]


def _store(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """A new index of the documents, in the folder that the executors share."""
    import uuid

    from .schema import SearchSchema
    from .search_index import IndexConfig, SearchIndex

    root = _shared(spark)
    schema = SearchSchema(default_analyzer="simple").with_text("text").with_text("lang").with_text("source").with_field("n_chars", "number")
    ix = SearchIndex.open(spark, f"{root}/store-{uuid.uuid4().hex}", schema, IndexConfig(parser=Parser(default_field="text")))
    ix.add(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return ix


@register("delete_then_search", f"SELECT doc_id FROM documents WHERE {_has('the')} AND lang <> 'en'")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    ix.delete(_table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))
    return ix.matches("the").select("doc_id")


@register("delete_by_query", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents WHERE NOT (n_chars >= 1000 AND n_chars <= 5000)")
def _delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    ix.delete_by_query("n_chars:[1000 TO 5000]")
    return ix.store.docs().select("doc_id", "n_chars")


@register("upsert_latest_wins", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'changed' ELSE source END AS source FROM documents")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    ix.upsert(ix.store.docs().where("lang = 'de'").withColumn("source", F.lit("changed")))
    return ix.store.docs().select("doc_id", "source")


@register("compact_preserves", "SELECT doc_id, lang, source, 1 AS segments, 0 AS deletes FROM documents WHERE NOT contains(source, 'src3')")
def _compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    ix.delete_by_query(Term("source", "src3"))
    m = ix.compact()
    return ix.store.docs().select("doc_id", "lang", "source", F.lit(len(m.segments)).alias("segments"), F.lit(len(m.deletes)).alias("deletes"))


@register("recover_after_crash", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE 'late' END AS source FROM documents WHERE lang = 'de' AND doc_id % 3 <> 0")
def _recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, deletes and adds again of the German documents' ids, a flush, more of them, then a new process that recovers."""
    from .schema import SearchSchema
    from .search_index import IndexConfig, SearchIndex
    from .sources.store import StoreConfig

    import uuid

    path, schema = f"{_shared(spark)}/store-{uuid.uuid4().hex}", SearchSchema().with_text("source")
    config = IndexConfig(StoreConfig(log_sync="batch", log_batch=50, writer_batch_size=100_000))
    ix = SearchIndex.open(spark, path, schema, config)
    ids = sorted(r.doc_id for r in _table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id").collect())
    for i in ids:
        ix.add_document(doc_id=i, source="early")
    ix.flush()
    for i in ids:
        ix.delete_document(i)
        if i % 2 == 0:
            ix.add_document(doc_id=i, source="again")
        else:
            ix.add_document(doc_id=i, source="lost")
            ix.update_document(doc_id=i, source="late")
        if i % 3 == 0:
            ix.delete_document(i)
    ix.store.log.flush()
    again = SearchIndex.open(spark, path, schema, config)
    again.recover()
    again.recover()
    return again.store.docs().select("doc_id", "source")


@register("point_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    last = _table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return spark.createDataFrame([ix.store.snapshot().get(last)], ix.schema.struct()).select("doc_id", "lang", "source")


# search over the stored index: analyzed words, no text is read


def _by_index(name: str, q: Node, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _stored(spark, sf_dir).stored_index().matching(q)

    QUERIES[name], ORACLE[name] = run, sql


_by_index("stored_intersect", Bool(must=(_the, _of, _and)), f"SELECT doc_id FROM ({_T}) WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'and')")
_by_index("stored_phrase", Phrase("text", ("of", "the")), f"SELECT doc_id FROM ({_T}) WHERE {_phrase(['of', 'the'], 2)}")
_by_index("stored_prefix", Prefix("text", "then"), f"SELECT doc_id FROM ({_T}) WHERE len(list_filter(w, lambda t: starts_with(t, 'then'))) > 0")
_by_index("stored_not", Bool(must=(_the,), must_not=(Term("text", "that"), Range("n_chars", lt=2000.0))), f"SELECT doc_id FROM (SELECT doc_id, n_chars, {_TOKENS('text')} AS w FROM documents) WHERE list_contains(w, 'the') AND NOT list_contains(w, 'that') AND n_chars >= 2000")


@register("stored_bm25", f"WITH {_MATCH} SELECT doc_id, round({_bm25_sql('thing')} + {_bm25_sql('of')}, 6) AS score FROM w WHERE list_contains(ws, 'thing') AND list_contains(ws, 'of')")
def _stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Bool(must=(Term("text", "thing"), _of))
    return _stored(spark, sf_dir).stored_index().scored(q, search.Config(match="index")).select("doc_id", F.round("_score", 6).alias("score"))


@register("stored_top", f"WITH {_MATCH} SELECT doc_id, round({_bm25_sql('thing')}, 6) AS score, row_number() OVER (ORDER BY {_bm25_sql('thing')} DESC, doc_id) AS rank FROM w WHERE {_has('thing')} ORDER BY rank LIMIT 5")
def _stored_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facade's search, by the stored index, without its result cache."""
    return _stored(spark, sf_dir).search("thing", 5, config=search.Config(cache=False)).select("doc_id", F.round("_score", 6).alias("score"), F.col("_rank").alias("rank"))


@register("snapshot_time_travel", "SELECT doc_id FROM documents")
def _time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _store(spark, sf_dir)
    version = ix.store.versions()[-1]
    ix.delete_by_query("the")
    return ix.store.snapshot(version).docs().select("doc_id")


@register("txn_conflict", "SELECT min(doc_id) AS doc_id, 'first' AS source, true AS conflict FROM documents")
def _txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .errors import Conflict

    ix = _store(spark, sf_dir)
    lost = False
    least = ix.store.docs().agg(F.min("doc_id")).first()[0]
    one, other = ix.transaction(), ix.transaction()
    one.update(doc_id=least, source="first")
    other.update(doc_id=least, source="second")
    one.commit()
    try:
        other.commit()
    except Conflict:
        lost = True
    return ix.store.docs().where(F.col("doc_id") == least).select("doc_id", "source", F.lit(lost).alias("conflict"))


@register("streaming_ingest", "SELECT event_id AS doc_id, event_type AS kind, value FROM events")
def _streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .schema import SearchSchema
    from .sources.store import DocumentStore
    from .streaming.ingest import ingest

    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    store = DocumentStore(spark, f"{base}/store", SearchSchema().with_text("kind").with_field("value", "number"))
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("kind"), "value")
    ingest(rows, store, f"{base}/checkpoint").awaitTermination()
    return store.docs()


@register("events_per_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of two terms, either of which may match: the ten best documents."""
    return QUERIES["bm25_bool_or"](spark, sf_dir)
