import uuid

import pytest
from pyspark.sql import functions as F

from lexgrove.errors import Conflict, InvalidArgument, InvalidInput, InvalidState, NotFound, OutOfMemory, StorageError, UnsupportedQuery
from lexgrove.operators import expand, index, layout, search
from lexgrove.operators.scoring import BM25
from lexgrove.plans import scan
from lexgrove.plans.ast import Bool, Fuzzy, MatchAll, Phrase, Prefix, Range, Term, Wildcard
from lexgrove.schema import SearchSchema
from lexgrove.search_index import IndexConfig, SearchIndex
from lexgrove.sources.merge import MB, LogStructured, Segment, Tiered
from lexgrove.sources.store import StoreConfig
from lexgrove.sources.txn import Isolation
from lexgrove.topology import Cluster

DOCS = [
    (1, "Rust Programming", "The rust language is fast.\nIt is safe", 5.0, True),
    (2, "Python Basics", "python scripts for machine learning", 25.0, False),
    (3, "Databases", "a database of rusted things, quick brown fox", 60.0, None),
    (4, None, "", None, None),
    (5, "Ñandú", "schön quick the fox", 25.0, True),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, content string, price double, good boolean").cache()


def ids(docs, q):
    return sorted(r.doc_id for r in docs.where(scan.matches(q, scan.Fields.of(docs.schema))).collect())


@pytest.mark.parametrize(
    "q, want",
    [
        (Term("content", "RUST"), [1, 3]),
        (Term("_all", "rust"), [1, 3]),
        (Term("price", "5"), []),
        (Term("none", "x"), []),
        (Bool(must_not=(Term("title", "rust"),)), [2, 3, 4, 5]),
        (Bool(), [1, 2, 3, 4, 5]),
        (Bool(should=(Term("content", "rust"), Term("content", "fox")), must_not=(Term("title", "data"),)), [1, 5]),
        (Bool(should=(Term("content", "rust"), Term("content", "fox"), Term("content", "quick")), minimum_should_match=2), [3, 5]),
        (Phrase("content", ("quick", "fox")), []),
        (Phrase("content", ("quick", "fox"), 1), [3, 5]),
        (Phrase("content", ("Brown", "FOX")), [3]),
        (Phrase("content", ()), []),
        (Range("price", gte=25.0, lte=60.0), [2, 3, 5]),
        (Range("price", gt=25.0), [3]),
        (Range("price", gte="*", lt=25.0), [1]),
        (Range("good", gte=0.0), []),
        (Range("content", gte=0.0), []),
        (Prefix("title", "Prog"), [1]),
        (Prefix("title", "prog"), []),
        (Prefix("content", ""), [1, 2, 3, 5]),
        (Wildcard("content", "ru*fast"), [1]),
        (Wildcard("content", "fast*safe"), []),
        (Wildcard("content", "f?x"), [3, 5]),
        (Wildcard("content", "("), []),
        (Wildcard("content", "f*x", anchored=True), [3, 5]),
        (Fuzzy("content", "ruste", 1), [1, 3]),
        (Fuzzy("content", "pythno", 1), []),
        (Fuzzy("content", "pythno", 2), [2]),
        (Fuzzy("content", "schon", 1), [5]),
        (MatchAll(), [1, 2, 3, 4, 5]),
    ],
)
def test_match(docs, q, want):
    assert ids(docs, q) == want


def test_scan_and_index_agree(docs):
    rows = index.postings(docs, ["content"])
    for word in ("rust", "fox", "python", "the", "absent"):
        whole = {r.doc_id for r in expand.union(rows, [word]).collect()}
        contained = set(ids(docs, Term("content", word)))
        assert whole <= contained
    assert [r.doc_id for r in expand.phrase(rows, ["quick", "fox"], 1).orderBy("doc_id").collect()] == [3, 5]
    assert expand.phrase(rows, []).count() == 0
    assert expand.intersect(rows, []).count() == 0


def test_all_fields(docs):
    rows = index.all_fields(index.postings(docs, ["title", "content"]))
    first = rows.where("doc_id = 1 and term = 'rust'").first()
    assert first.tf == 2 and first.positions == [1, 8]


def test_postings_shuffle_nothing(spark):
    """Documents' tokens are grouped within their rows; only rows of ids that come again meet."""
    texts = [(1, "b a b. B c"), (2, ""), (3, None), (4, "zé zé a"), (5, " ".join(f"w{k % 700}" for k in range(3000)))]
    rows = index.postings(spark.createDataFrame(texts, "doc_id long, t string"), ["t"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()

    def want(texts):
        out = {}
        for i, words in ((i, (t or "").lower().replace(".", "").split()) for i, t in texts):
            for at, w in enumerate(words):
                out.setdefault((i, len(words), w), []).append(at)
        return sorted((str(i), w, len(ps), sorted(ps), round(n**-0.5, 9)) for (i, n, w), ps in out.items())

    def got(rows):
        return sorted((str(r.doc_id), r.term, r.tf, r.positions, round(r.field_norm, 9)) for r in rows.collect())

    assert got(rows) == want(texts)
    again = [*texts, (1, "c b a x y"), (4, "a"), (None, "n o"), (None, "n p"), (2, "late")]
    assert got(index.postings(spark.createDataFrame(again, "doc_id long, t string"), ["t"])) == want(again)
    none = spark.createDataFrame([], "doc_id long, t string")
    assert index.postings(none, ["t"]).count() == 0


def test_frequent_terms_are_spread_over_files(spark, tmp_path):
    """No task gets all postings of a term, and each file is in order."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, f"the w{k % 7} w{k}") for k in range(300)], "doc_id long, t string")
    index.write_postings(index.postings(layout.pieces(docs, 200 << 20), ["t"]), f"{tmp_path}/p")
    files = [pq.read_table(f).to_pylist() for f in sorted((tmp_path / "p").glob("*.parquet"))]
    assert len(files) == 13 and all(any(r["term"] == "the" for r in f) for f in files)
    assert all([(r["term"], r["doc_id"]) for r in f] == sorted((r["term"], r["doc_id"]) for r in f) for f in files)
    assert sum(map(len, files)) == spark.read.parquet(f"{tmp_path}/p").select("term", "doc_id").distinct().count() == index.postings(docs, ["t"]).count()


def test_scores(docs):
    found = {r.doc_id: r["_score"] for r in search.scored(docs, Term("content", "rust")).collect()}
    assert found[3] == 0.0 and found[1] > 0  # contained, but not a word
    twice = {r.doc_id: r["_score"] for r in search.scored(docs, Term("content", "rust", boost=2.0)).collect()}
    assert twice[1] == pytest.approx(2 * found[1])
    same_tf = search.scored(docs, Term("content", "rust"), search.Config(doc_length="tf")).where("doc_id = 1").first()["_score"]
    assert same_tf != found[1]
    assert all(r["_score"] == 1.0 for r in search.scored(docs, Prefix("title", "R")).collect())
    debug = search.summary(search.scored(docs, Term("content", "rust"), search.DEBUG))
    assert debug.total_hits == 2 and debug.max_score == pytest.approx(found[1])
    assert debug.hits.first()["_explanation"].details[0].description.startswith("idf")


def test_postings_scores_agree(docs):
    rows, lengths = index.postings(docs, ["content"]), index.doc_lengths(docs, "content")
    s = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
    q = Bool(should=(Term("content", "rust"), Term("content", "fox", boost=2.0), Prefix("title", "P")))
    a = search.scored_by_postings(docs, rows, index.dictionary(rows, s.n), lengths, s.n, s.a, q)
    b = search.scored(docs, q)
    assert {r.doc_id: round(r["_score"], 9) for r in a.collect()} == {r.doc_id: round(r["_score"], 9) for r in b.collect()}


def test_pipeline(docs):
    assert search.Pipeline(BM25(), lambda rows: search.top(rows, 1)).run(docs, Term("content", "fox")).count() == 1
    with pytest.raises(UnsupportedQuery):
        search.Pipeline().execute()
    with pytest.raises(InvalidArgument):
        search.top(docs, -1)


@pytest.fixture
def ix(spark, tmp_path, docs):
    schema = SearchSchema(default_analyzer="simple").with_text("title").with_text("content").with_field("price", "number").with_field("good", "boolean")
    out = SearchIndex.open(spark, f"{tmp_path}/ix", schema)
    out.add(docs)
    return out


def found(ix, q, **options):
    return [r.doc_id for r in ix.search(q, 100, **options).orderBy("doc_id").collect()]


def test_index_life(ix, spark):
    assert found(ix, "rust") == [1, 3]
    assert found(ix, "price:[20 TO 30]") == [2, 5]
    ix.add_document(doc_id=6, content="more rust", price=1)
    assert found(ix, "rust") == [1, 3]
    ix.flush()
    assert found(ix, "rust") == [1, 3, 6]
    ix.delete_document(1)
    ix.commit()
    assert found(ix, "rust") == [3, 6]
    ix.add_document(doc_id=7, content="x")
    ix.flush()
    assert found(ix, "rust") == [3, 6]  # deletes last over later flushes
    ix.upsert(spark.createDataFrame([(3, "now python")], "doc_id long, content string"))
    assert found(ix, "python") == [2, 3] and found(ix, "rust") == [6]
    before = ix.store.docs().count()
    ix.compact()
    assert ix.store.docs().count() == before and ix.store.manifest().deletes == ()
    assert found(ix, "rust") == [6]
    again = SearchIndex.open(spark, ix.store.files.root, ix.schema)
    assert found(again, "rust") == [6]
    assert ix.health_check()["overall"] == "healthy"
    assert ix.stats()["rows"] == before


def test_cache_knows_versions_and_configs(ix):
    found(ix, "fox")
    found(ix, "fox")
    assert ix.cache.hits == 1
    assert "_explanation" in ix.search("fox", config=search.Config(explain=True)).columns
    assert ix.delete_by_query("fox") == 2
    assert found(ix, "fox") == []


def test_pages_and_ranks(ix):
    pages = [[r.doc_id for r in p] for p in ix.pages(MatchAll(), 2)]
    assert pages == [[1, 2], [3, 4], [5]]
    assert [r["_rank"] for r in ix.search(MatchAll(), 2, offset=3).orderBy("_rank").collect()] == [4, 5]
    assert ix.search(MatchAll(), sort=[F.col("price").desc_nulls_last()]).first().doc_id == 3
    assert ix.search("fox", select=["title"]).columns == ["title", "_score", "_rank"]


def test_recover(spark, ix):
    ix.commit()
    ix.add_document(doc_id=10, content="lost?")
    ix.delete_document(2)
    again = SearchIndex.open(spark, ix.store.files.root, ix.schema)
    assert again.recover() == 2
    assert found(again, "lost") == [10] and found(again, "python") == []
    assert again.recover() == 0
    with open(f"{ix.store.files.local}/_log/999999999999.json", "w") as f:
        f.write("{broken")
    again.store.pending()
    assert again.store.corrupt_log_entries == 1 and again.health_check()["log"] == "degraded"


def test_recovery_keeps_the_order(spark, tmp_path):
    """A crash after any step: the store then holds what all operations so far give, one after another."""
    schema = SearchSchema().with_text("content")
    steps = [("add", 1, "a"), ("add", 2, "b"), ("flush",), ("delete", 1), ("add", 1, "new"), ("add", 2, "again"), ("update", 3, "c"), ("flush",), ("update", 2, "d"), ("commit",), ("delete", 3)]

    def play(store, step):
        if step[0] in ("flush", "commit"):
            getattr(store, step[0])()
        elif step[0] == "delete":
            store.delete_document(step[1])
        else:
            getattr(store, f"{step[0]}_document")(doc_id=step[1], content=step[2])

    want, rows = [], []
    for step in steps:
        if step[0] in ("delete", "update"):
            rows = [r for r in rows if r[0] != step[1]]
        if step[0] in ("add", "update"):
            rows = [*rows, step[1:]]
        want.append(sorted(rows))
    for k in (1, 4, 5, 7, 8, 10):
        path = f"{tmp_path}/{k}"
        store = SearchIndex.open(spark, path, schema).store
        for step in steps[: k + 1]:
            play(store, step)
        again = SearchIndex.open(spark, path, schema)
        again.recover()
        assert sorted((r.doc_id, r.content) for r in again.store.docs().collect()) == want[k], steps[: k + 1]
        assert again.recover() == 0
    batched = SearchIndex.open(spark, f"{tmp_path}/b", schema, IndexConfig(StoreConfig(log_sync="batch", log_batch=3)))
    for k in range(7):
        batched.add_document(doc_id=k, content="x")
    assert len(batched.store.files.names("_log")) == 2
    batched.commit()
    assert batched.store.files.names("_log") == [] and batched.store.docs().count() == 7


def test_buffered_rows_are_found_by_id(spark, tmp_path):
    """Deletes and updates of buffered documents, and their replay, don't look through the buffer."""
    compared = [0]

    class Id(int):
        __hash__ = int.__hash__

        def __eq__(self, other):
            compared[0] += 1
            return int(self) == int(other)

        def __ne__(self, other):
            return not self == other

    config = IndexConfig(StoreConfig(log_sync="none", writer_batch_size=10_000))
    ix = SearchIndex.open(spark, f"{tmp_path}/d", SearchSchema().with_text("content"), config)
    for k in range(500):
        ix.add_document(doc_id=Id(k), content="first")
        ix.add_document(doc_id=Id(k), content="second")
    for k in range(0, 500, 2):
        ix.delete_document(Id(k))
        ix.delete_document(Id(k))
        ix.update_document(doc_id=Id(k + 1), content="third")
    assert compared[0] < 10_000 and [r["content"] for r in ix.store._rows.values()] == ["third"] * 250
    ix.store.log.flush()
    again = SearchIndex.open(spark, f"{tmp_path}/d", ix.schema, config)
    assert again.recover() == 1750
    assert sorted((r.doc_id, r.content) for r in again.store.docs().collect()) == [(k, "third") for k in range(1, 500, 2)]


def test_updates_and_deletes_fill_the_buffer(spark, tmp_path):
    ix = SearchIndex.open(spark, f"{tmp_path}/e", SearchSchema().with_text("content"), IndexConfig(StoreConfig(writer_batch_size=2)))
    for k in range(3):
        ix.update_document(doc_id=k, content="x")
    assert ix.store.docs().count() == 2 and len(ix.store._rows) == 1
    ix.delete_document(0)
    ix.delete_document(1)
    assert ix.store.docs().count() == 2 and list(ix.store._deleted) == [1]


def test_budget_and_schema(spark, tmp_path):
    ix = SearchIndex.open(spark, f"{tmp_path}/b", SearchSchema().with_text("content"), IndexConfig(StoreConfig(memory_limit=64)))
    with pytest.raises(OutOfMemory):
        ix.add_document(doc_id=99, content="x" * 100)
    with pytest.raises(InvalidArgument):
        ix.add_document(content="x")
    with pytest.raises(InvalidInput):
        ix.add(spark.createDataFrame([(1, 2)], "doc_id long, other int"))
    with pytest.raises(InvalidInput):
        SearchSchema.infer(spark.createDataFrame([(1, [1])], "doc_id long, x array<int>"))


def test_auto_flush(spark, tmp_path):
    ix = SearchIndex.open(spark, f"{tmp_path}/c", SearchSchema().with_text("content"), IndexConfig(StoreConfig(writer_batch_size=2)))
    for k in range(3):
        ix.add_document(doc_id=k, content=f"value-{k}")
    assert ix.store.docs().count() == 2 and len(ix.store._rows) == 1


def test_transactions(ix):
    t = ix.transaction()
    t.insert(doc_id=20, content="new")
    assert t.read(20)["content"] == "new" and t.read(2).title == "Python Basics"
    t.commit()
    with pytest.raises(InvalidState):
        t.commit()
    old = ix.transaction()
    ix.delete_document(3)
    ix.commit()
    old.update(doc_id=3, content="changed")
    with pytest.raises(Conflict):
        old.commit()
    loose = ix.transaction(Isolation.READ_COMMITTED)
    ix.add_document(doc_id=21, content="y")
    ix.flush()
    loose.update(doc_id=21, content="z")
    loose.commit()
    assert found(ix, "new") == [20] and found(ix, "z") == [21]
    with pytest.raises(ZeroDivisionError), ix.transaction() as t:
        t.delete(20)
        1 / 0
    assert found(ix, "new") == [20]


def test_sessions(ix, spark):
    s = ix.session().add(spark.createDataFrame([(30, "s")], "doc_id long, content string"))
    with pytest.raises(InvalidState):
        s.commit()
    s.flush().commit()
    with pytest.raises(InvalidState):
        s.add(None)
    with ix.session() as s:
        s.delete(spark.createDataFrame([(30,)], "doc_id long"))
    assert ix.store.snapshot().get(30) is None


def test_snapshots_and_vacuum(ix, spark):
    version = ix.store.versions()[-1]
    with ix.store.pinned(version) as snapshot:
        ix.delete_by_query(MatchAll())
        assert snapshot.docs().count() == 5 and ix.store.docs().count() == 0
        gone = ix.store.vacuum(1)
        assert version not in gone and snapshot.docs().count() == 5
    ix.store.vacuum(1)
    with pytest.raises(NotFound):
        ix.store.snapshot(version)
    with pytest.raises(Conflict):
        ix.store._publish(ix.store.manifest())


def test_merge(ix, spark):
    for k in range(3):
        ix.add(spark.createDataFrame([(100 + k, "merged")], "doc_id long, content string"))
    before = sorted(r.doc_id for r in ix.store.docs().collect())
    ix.store.merge()
    assert len(ix.store.manifest().segments) == 1
    assert sorted(r.doc_id for r in ix.store.docs().collect()) == before


def seg(name, mb):
    return Segment(name, 1, 1, 1, int(mb * MB))


def test_policies():
    assert Tiered().pick([seg("a", 20), seg("b", 300)]) == []
    assert [s.id for s in Tiered().pick([seg("a", 5), seg("b", 300), seg("c", 2)])] == ["c", "a"]
    assert len(Tiered().pick([seg(str(k), 100) for k in range(12)])) == 5
    assert LogStructured().pick([seg(str(k), 0.5) for k in range(3)]) == []
    assert len(LogStructured().pick([seg(str(k), 0.5) for k in range(4)] + [seg("x", 50)])) == 4


def test_cluster(ix):
    c = Cluster(ix, 2)
    assert c.search("fox").count() == 2
    with pytest.raises(InvalidArgument):
        Cluster(ix, 0)


def jobs(spark, f):
    tracker = spark.sparkContext._jsc.sc().dagScheduler()
    before = tracker.nextJobId()
    f()
    return tracker.nextJobId() - before


def test_stored_index(ix, spark):
    assert ix.index_parts()[0].count() == 0  # none yet
    by_scan = {q: ix.search(q, 100).select("doc_id", F.round("_score", 9)).collect() for q in ("rust", "the AND fox", "price:[20 TO 60]")}
    ix.build_index()
    ix.cache.clear()
    rows, terms, _ = ix.index_parts()
    assert terms.where("field = 'content' and term = 'fox'").first().doc_freq == 2
    assert rows.where("term = 'fox'").count() == 2
    for q, want in by_scan.items():
        assert ix.search(q, 100).select("doc_id", F.round("_score", 9)).collect() == want
    words = search.Config(match="index")
    for q, want in (
        (Term("content", "RUST"), [1]),
        (Term("_all", "fox"), [3, 5]),
        (Phrase("content", ("quick", "fox"), 1), [3, 5]),
        (Prefix("content", "RU"), [1, 3]),
        (Wildcard("content", "f?x"), [3, 5]),
        (Fuzzy("content", "ruste", 1), [1, 3]),
        (Range("price", gt=25.0), [3]),
        (Bool(must=(Term("content", "fox"),), must_not=(Term("title", "databases"),)), [5]),
        (Bool(should=(Term("content", "rust"), Term("content", "fox"), Term("content", "quick")), minimum_should_match=2), [3, 5]),
        (Bool(must_not=(Term("content", "fox"),)), [1, 2, 4]),
        (MatchAll(), [1, 2, 3, 4, 5]),
    ):
        assert sorted(r.doc_id for r in ix.search(q, 100, config=words).collect()) == want, q
        assert sorted(r.doc_id for r in ix.matches(q, config=words).collect()) == want, q
    ix.index_reader.kept.clear()
    lazy = ix.index_parts(strategy="lazy")[0].where("term = 'fox'")
    assert "EqualTo(term,fox)" in lazy._jdf.queryExecution().executedPlan().toString()
    assert ix.index_reader.kept.stats()["entries"] == 1


def test_a_hit_starts_no_job(ix, spark):
    ix.search("fox")
    assert jobs(spark, lambda: ix.search("fox")) == 0 and ix.cache.hits == 1
    assert jobs(spark, lambda: ix.search("rust")) > 0
    ix.enable_low_memory_mode()
    assert ix.is_low_memory_mode_enabled() and ix.cache.stats()["entries"] == 0
    assert jobs(spark, lambda: ix.search("fox")) > 0


def test_readers_and_managers(ix, spark):
    import shutil

    t = ix.transaction()
    assert ix.transactions.stats() == {"total": 1, "active": 1, "preparing": 0} and ix.transactions.get(t.id) is t
    t.rollback()
    assert ix.transactions.cleanup() == 1 and ix.transactions.stats()["total"] == 0
    ix.search("fox")
    assert ix.stats()["readers"]["entries"] == 1
    ix.add(spark.createDataFrame([(9, "lost")], "doc_id long, content string"))
    gone = ix.store.manifest().segments[-1].id
    shutil.rmtree(f"{ix.store.files.local}/docs/{gone}")
    assert ix.health_check()["overall"] == "unhealthy"
    with pytest.raises(StorageError):
        ix.search("fox")
    loose = SearchIndex.open(spark, ix.store.files.root, ix.schema, IndexConfig(skip_missing=True))
    assert found(loose, "fox") == [3, 5] and loose.pool.failures == 1 and loose.health_check()["readers"] == "degraded"


def test_collectors_stop(docs):
    first = search.collect_until(docs.orderBy("doc_id"), search.FirstMatches(2))
    assert [r.doc_id for r in first.hits] == [1, 2]


def test_background_merge(ix, spark):
    import time

    from lexgrove.sources.store import BackgroundMerge, codec

    for k in range(3):
        ix.add(spark.createDataFrame([(100 + k, "merged")], "doc_id long, content string"))
    before = ix.store.docs().count()
    with BackgroundMerge(ix.store, 0.2) as m:
        until = time.time() + 60
        while not m.merges and time.time() < until:
            time.sleep(0.2)
    assert m.merges and len(ix.store.manifest().segments) == 1 and ix.store.docs().count() == before
    assert codec("speed") == "lz4_raw"


def test_orphans_stay_for_a_while(ix, spark):
    name = f"{ix.store.files.local}/docs/unpublished"
    spark.range(1).write.parquet(name)
    ix.store.vacuum(1)
    assert ix.store.files.exists("docs/unpublished")
    ix.store.config = StoreConfig(orphan_seconds=-1)
    ix.store.vacuum(1)
    assert not ix.store.files.exists("docs/unpublished")


def test_batches_are_never_forgotten(ix, spark):
    one = spark.createDataFrame([(50, "x")], "doc_id long, content string")
    for k in range(3):
        ix.store.append(one, batch=f"s:{k}")
    m = ix.store.manifest()
    assert m.batches == ("s:2",) and ix.store.append(one, batch="s:0").version == m.version


def test_streaming_is_idempotent(spark, tmp_path):
    from lexgrove.sources.store import DocumentStore
    from lexgrove.streaming.ingest import ingest

    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string").write.parquet(source)
    store = DocumentStore(spark, f"{tmp_path}/st", SearchSchema().with_text("content"))
    stream = spark.readStream.schema("doc_id long, content string").parquet(source)
    for k in range(2):  # a second run with a lost checkpoint offers the same batch again
        ingest(stream, store, f"{tmp_path}/cp{k}").awaitTermination()
    assert store.docs().count() == 2
    name = uuid.uuid4().hex
    ingest(stream, store, f"{tmp_path}/cp-{name}", name=name, upsert=True).awaitTermination()
    assert store.docs().count() == 2
