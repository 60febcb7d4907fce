"""The engine's face: a store, a query parser, scores, a result cache."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument, InvalidState
from .operators import index, layout, search
from .operators.stored import StoredIndex
from .plans import scan
from .plans.ast import Node
from .plans.parser import Parser
from .schema import SearchSchema
from .sources.readers import PARTS, IndexReader, Kept, ReaderPool
from .sources.store import DocumentStore, Manifest, Snapshot, StoreConfig
from .sources.txn import Isolation, Session, Transaction, TransactionManager


@dataclass(frozen=True)
class IndexConfig:
    store: StoreConfig = field(default_factory=StoreConfig)
    parser: Parser = Parser()
    search: search.Config = search.DEFAULT
    cache_entries: int = 1024
    max_readers: int = 10
    #: readers leave out segments that are missing, and count them
    skip_missing: bool = False
    #: "eager", "lazy" or "adaptive"
    index_strategy: str = "adaptive"


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, schema: SearchSchema, config: IndexConfig):
        self.spark, self.schema, self.config = spark, schema, config
        self.store = DocumentStore(spark, path, schema, config.store)
        #: a version is part of the key, so writes never leave stale results
        self.cache: Kept[tuple[list[Row], T.StructType]] = Kept(config.cache_entries)
        self.pool = ReaderPool(self.store, config.max_readers, config.skip_missing)
        self.index_reader = IndexReader(spark, self.store.files, config.index_strategy, most=config.max_readers)
        self.transactions = TransactionManager(self.store)
        self._totals: Kept[dict] = Kept(config.max_readers)
        self._low_memory = False
        self.fields = schema.query_fields()
        self.queries = 0

    @staticmethod
    def open(spark: SparkSession, path: str, schema: SearchSchema, config: IndexConfig = IndexConfig()) -> SearchIndex:  # noqa: B008
        """A new index, or the last version of one that is there."""
        return SearchIndex(spark, path, schema, config)

    # writes

    def add(self, df: DataFrame) -> Manifest:
        return self.store.append(df)

    def add_document(self, **values: object) -> None:
        self.store.add_document(**values)

    def delete_document(self, doc_id: int) -> None:
        self.store.delete_document(doc_id)

    def delete(self, ids: DataFrame) -> Manifest:
        return self.store.delete(ids)

    def upsert(self, df: DataFrame) -> Manifest:
        return self.store.upsert(df)

    def delete_by_query(self, q: str | Node) -> int:
        """Hides all matches; their number."""
        found = self.store.docs().where(scan.matches(self.query(q), self.fields)).select("doc_id")
        m = self.store.delete(found)
        return self.spark.read.parquet(self.store.files.at(f"deletes/{m.deletes[-1]}")).count()

    def update_document(self, **values: object) -> None:
        self.store.update_document(**values)

    def flush(self) -> Manifest:
        return self.store.flush()

    def commit(self) -> Manifest:
        return self.store.commit()

    def compact(self) -> Manifest:
        return self.store.compact()

    def recover(self) -> int:
        return self.store.recover()

    def transaction(self, isolation: Isolation = Isolation.SERIALIZABLE) -> Transaction:
        return self.transactions.begin(isolation)

    def with_transaction(self, work: Callable[[Transaction], object], isolation: Isolation = Isolation.SERIALIZABLE) -> object:
        with self.transaction(isolation) as t:
            return work(t)

    def session(self) -> Session:
        return Session(self.store)

    # reads

    def query(self, q: str | Node) -> Node:
        return self.config.parser.parse(q) if isinstance(q, str) else q

    def _snapshot(self) -> Snapshot:
        return self.pool.reader()

    def stored_index(self, snapshot: Snapshot | None = None) -> StoredIndex | None:
        """The stored index of a version, the last if none is given; None if it hasn't been built."""
        snapshot = snapshot or self._snapshot()
        base = f"postings/{snapshot.version}"
        if not self.store.files.exists(f"{base}/_totals.json"):
            return None
        totals = self._totals.get(("stored", snapshot.version), lambda: json.loads(self.store.files.read(f"{base}/_totals.json")))
        parts = self.index_reader.load(base)
        return StoredIndex(snapshot.docs(), parts.postings, parts.dictionary, totals["n_docs"], totals["tokens"], self.fields)

    def matches(self, q: str | Node, snapshot: Snapshot | None = None, config: search.Config | None = None) -> DataFrame:
        """All matching documents with scores, by the version's stored index if it has one."""
        snapshot, config, node = snapshot or self._snapshot(), config or self.config.search, self.query(q)
        stored = None if config.explain else self.stored_index(snapshot)
        if config.match == "index":
            if stored is None:
                raise InvalidState("matching by the index needs build_index, and has no explanations")
            return snapshot.docs().join(stored.scored(node, config), "doc_id")
        if stored is not None:
            return stored.scored(node, config)
        return search.scored(snapshot.docs(), node, config, self.fields, self._totals.get(("scan", snapshot.version), dict))

    def _found(self, node: Node, snapshot: Snapshot, config: search.Config, limit: int, offset: int, sort: list[Column] | None) -> DataFrame:
        """The rows of a page of hits; by the index, texts are read for these rows only."""
        stored = self.stored_index(snapshot) if config.match == "index" and not sort and not config.explain else None
        if stored is None:
            return search.top(self.matches(node, snapshot, config), limit, offset, sort)
        best = search.top(stored.scored(node, config), limit, offset).collect()  # a page
        scores = self.spark.createDataFrame([(r["doc_id"], r["_score"]) for r in best], "doc_id long, _score double")
        rows = snapshot.docs().where(F.col("doc_id").isin([r["doc_id"] for r in best])).join(F.broadcast(scores), "doc_id")
        return rows.orderBy(F.col("_score").desc(), "doc_id")

    def search(self, q: str | Node, limit: int = 10, offset: int = 0, sort: list[Column] | None = None, select: list[str] | None = None, config: search.Config | None = None) -> DataFrame:
        """The best hits: stored fields (or ``select``), _score, and a _rank from 1.

        A result that the cache has is given without a Spark job.
        """
        config = config or self.config.search
        if limit < 0 or offset < 0:
            raise InvalidArgument("limit and offset can't be negative")
        snapshot, node = self._snapshot(), self.query(q)
        names = select or self.schema.stored()
        extra = ["_score", "_explanation"] if config.explain else ["_score"]

        def run() -> tuple[list[Row], T.StructType]:
            self.queries += 1
            df = self._found(node, snapshot, config, limit, offset, sort).select(*dict.fromkeys([*names, *extra]))
            return self._timed(df, config.timeout_ms), df.schema

        rows, schema = self.cache.get((snapshot.version, node, limit, offset, tuple(names), config), run) if config.cache and sort is None and not self._low_memory else run()
        ranked = [(*r, k) for k, r in enumerate(rows, offset + 1)]
        return self.spark.createDataFrame(ranked, T.StructType([*schema.fields, T.StructField("_rank", T.LongType())]))

    def _timed(self, df: DataFrame, timeout_ms: int | None) -> list[Row]:
        if timeout_ms is None:
            return df.collect()
        tag = f"search-{uuid.uuid4().hex}"
        self.spark.sparkContext.addJobTag(tag)
        timer = threading.Timer(timeout_ms / 1000, lambda: self.spark.sparkContext.cancelJobsWithTag(tag))
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def search_debug(self, q: str | Node, limit: int = 10) -> search.Results:
        """Hits with explanations, the number of matches, the best score, the time taken."""
        rows = self.matches(q, config=replace(self.config.search, explain=True))
        return search.summary(rows, limit)

    def pages(self, q: str | Node, size: int = 10) -> Iterator[list[Row]]:
        """Pages of hits of one version, each found behind the last hit of the one before."""
        rows = self.matches(q, self._snapshot())
        page = search.top(rows, size).collect()
        while page:
            yield page
            page = search.after(rows, page[-1]["_score"], page[-1]["doc_id"], size).collect() if len(page) == size else []

    # the stored index

    def build_index(self) -> str:
        """Writes postings, dictionary and lengths of the current version; their folder."""
        snapshot = self.store.snapshot()
        docs, analyzers = snapshot.docs(), self.schema.analyzers()
        spread = layout.pieces(docs, sum(s.size for s in snapshot.manifest.segments))
        base = f"postings/{snapshot.version}"
        at = self.store.files.at
        index.write_postings(index.postings(spread, analyzers, analyzers), at(f"{base}/postings"))
        rows = self.spark.read.parquet(at(f"{base}/postings"))
        n = docs.count()
        index.dictionary(rows, n).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(at(f"{base}/dictionary"))
        lengths = rows.groupBy("doc_id", "field").agg(F.sum("tf").alias("dl"))
        lengths.write.mode("overwrite").parquet(at(f"{base}/lengths"))
        lengths = self.spark.read.schema(PARTS["lengths"]).parquet(at(f"{base}/lengths"))
        tokens = {r.field: r.n for r in lengths.groupBy("field").agg(F.sum("dl").alias("n")).collect()}  # a row a field
        self.store.files.remove(f"{base}/_totals.json")
        self.store.files.create(f"{base}/_totals.json", json.dumps({"n_docs": n, "tokens": tokens}))
        self.index_reader.kept.clear()
        return base

    def index_parts(self, version: int | None = None, strategy: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings, dictionary and lengths of a version, empty where there are none."""
        version = self.store.versions()[-1] if version is None else version
        parts = self.index_reader.load(f"postings/{version}", strategy)
        return parts.postings, parts.dictionary, parts.lengths

    # state

    def stats(self) -> dict:
        m = self.store.manifest()
        return {
            "version": m.version, "segments": len(m.segments), "rows": sum(s.docs for s in m.segments), "bytes": sum(s.size for s in m.segments),
            "deletes": len(m.deletes), "buffered": len(self.store._rows), "queries": self.queries,
            "cache": self.cache.stats(), "readers": self.pool.kept.stats() | {"failures": self.pool.failures},
            "indexes": self.index_reader.kept.stats(), "transactions": self.transactions.stats(),
        }

    def memory_pressure(self) -> float:
        most = self.config.store.memory_limit
        return self.store._bytes / most if most else 0.0

    def enable_low_memory_mode(self) -> None:
        """No results are kept, and what was kept goes."""
        self._low_memory = True
        self.reclaim_memory()

    def is_low_memory_mode_enabled(self) -> bool:
        return self._low_memory

    def reclaim_memory(self) -> None:
        for kept in (self.cache, self.pool.kept, self.index_reader.kept, self._totals):
            kept.clear()

    def maybe_reclaim_memory(self, above: float = 0.8) -> bool:
        """Flushes and lets go of what is kept if the buffer is over a share of its budget."""
        if self.memory_pressure() <= above:
            return False
        self.flush()
        self.reclaim_memory()
        return True

    def health_check(self) -> dict[str, str]:
        """healthy, degraded or unhealthy for each part and, the worst of them, overall."""

        def of(check: Callable[[], str]) -> str:
            try:
                return check()
            except Exception:  # noqa: BLE001 - any failure is the finding
                return "unhealthy"

        def share(x: float) -> str:
            return "unhealthy" if x > 0.9 else "degraded" if x > 0.8 else "healthy"

        def log() -> str:
            self.store.pending()
            return "degraded" if self.store.corrupt_log_entries else "healthy"

        def readers() -> str:
            self.pool.reader().manifest  # noqa: B018 - it is there
            return "degraded" if self.pool.failures else "healthy"

        def segments() -> str:
            return "unhealthy" if any(not self.store.files.exists(f"docs/{s.id}") for s in self.store.manifest().segments) else "healthy"

        def disk() -> str:
            left, whole = self.store.files.free()
            return "healthy" if not whole or left > whole / 20 else "degraded" if left > whole / 100 else "unhealthy"

        def cache() -> str:
            # a cache that is full and never hit only costs memory
            return "degraded" if self.cache.most and len(self.cache.values) == self.cache.most and not self.cache.hits else "healthy"

        out = {"log": of(log), "readers": of(readers), "segments": of(segments), "disk": of(disk), "cache": of(cache), "memory": share(self.memory_pressure())}
        return out | {"overall": max(out.values(), key=("healthy", "degraded", "unhealthy").index)}
