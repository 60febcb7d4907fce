"""A versioned document store on Parquet.

Layout: ``docs/<segment>`` (the schema's columns and ``__seq``), ``deletes/<id>``
(doc_id, seq), ``_manifest/<version>.json``, ``_log/<first>-<last>.json``.  A version is
a manifest: its segments and deletes, and the last logged operation that is in it.  Manifests are created, never changed; of two
writers of a version one gets a conflict.  A delete at sequence s hides rows of
lower sequence, so an update is a delete and an append in one manifest.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidArgument, InvalidState, NotFound, OutOfMemory
from ..schema import SearchSchema
from .files import Files
from .log import Log
from .merge import MergePolicy, Segment, Tiered

SEQ = "__seq"


@dataclass(frozen=True)
class StoreConfig:
    writer_batch_size: int = 1000
    compression: str = "zstd"
    max_records_per_file: int = 0
    merge_policy: MergePolicy = field(default_factory=Tiered)
    memory_limit: int | None = None
    max_versions: int = 100
    #: "immediate", "batch" or "none", and the entries of a batch
    log_sync: str = "immediate"
    log_batch: int = 100
    #: seconds for which a folder of no version may belong to a write that isn't published yet
    orphan_seconds: float = 86_400


def codec(goal: str) -> str:
    """Parquet's compression for a goal: "speed", "ratio" or "balanced"."""
    known = {"speed": "lz4_raw", "ratio": "zstd", "balanced": "snappy"}
    if goal not in known:
        raise InvalidArgument(f"no goal of compression is {goal!r}")
    return known[goal]


@dataclass(frozen=True)
class Manifest:
    version: int
    seq: int
    timestamp: float
    segments: tuple[Segment, ...] = ()
    deletes: tuple[str, ...] = ()
    #: keys of batches that are in; of keys name:number the highest of each name
    batches: tuple[str, ...] = ()
    applied: int = 0

    def has_batch(self, key: str) -> bool:
        name, _, number = key.rpartition(":")
        return key in self.batches or (number.isdigit() and any(b.rpartition(":")[0] == name and int(b.rpartition(":")[2]) >= int(number) for b in self.batches if b.rpartition(":")[2].isdigit()))

    def with_batch(self, key: str | None) -> tuple[str, ...]:
        if key is None:
            return self.batches
        name, _, number = key.rpartition(":")
        kept = [b for b in self.batches if not (number.isdigit() and b.rpartition(":")[0] == name and b.rpartition(":")[2].isdigit())]
        return (*kept, key)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["seq"], d["timestamp"], tuple(Segment(**s) for s in d["segments"]), tuple(d["deletes"]), tuple(d["batches"]), d.get("applied", 0))


class Snapshot:
    """A version's documents; what is written later doesn't change them."""

    def __init__(self, store: DocumentStore, manifest: Manifest):
        self.store, self.manifest, self.version = store, manifest, manifest.version

    def raw(self, segments: Iterable[Segment] | None = None) -> DataFrame:
        segments = self.manifest.segments if segments is None else tuple(segments)
        schema = self.store.raw_schema()
        if not segments:
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.schema(schema).parquet(*[self.store.files.at(f"docs/{s.id}") for s in segments])

    def deletes(self) -> DataFrame | None:
        if not self.manifest.deletes:
            return None
        rows = self.store.spark.read.schema("doc_id long, seq long").parquet(*[self.store.files.at(f"deletes/{d}") for d in self.manifest.deletes])
        return rows.groupBy(F.col("doc_id").alias("__deleted")).agg(F.max("seq").alias("__upto"))

    def visible(self, segments: Iterable[Segment] | None = None) -> DataFrame:
        rows, gone = self.raw(segments), self.deletes()
        if gone is None:
            return rows
        return rows.join(gone, (rows["doc_id"] == gone["__deleted"]) & (rows[SEQ] < gone["__upto"]), "left_anti")

    def docs(self) -> DataFrame:
        return self.visible().drop(SEQ)

    def get(self, doc_id: int) -> Row | None:
        """The newest visible row of an id; row groups are pruned by their statistics."""
        return self.visible().where(F.col("doc_id") == doc_id).orderBy(F.col(SEQ).desc()).drop(SEQ).limit(1).first()

    def __iter__(self) -> Iterator[Row]:
        return self.docs().toLocalIterator()


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, schema: SearchSchema, config: StoreConfig = StoreConfig()):  # noqa: B008
        self.spark, self.files, self.schema, self.config = spark, Files(spark, path), schema, config
        self._empty()
        self._pins: dict[int, int] = {}
        self.log = Log(self.files, config.log_sync, config.log_batch)
        if not self.versions():
            try:
                self._publish(Manifest(0, 0, time.time()))
            except InvalidState:
                pass  # another process opened the same new store

    @property
    def corrupt_log_entries(self) -> int:
        return self.log.corrupt

    def raw_schema(self):  # noqa: ANN201
        from pyspark.sql import types as T

        return T.StructType([*self.schema.struct().fields, T.StructField(SEQ, T.LongType())])

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("_manifest"))

    def manifest(self, version: int | None = None) -> Manifest:
        have = self.versions()
        version = have[-1] if version is None else version
        if version not in have:
            raise NotFound(f"no version {version}")
        return Manifest.of(self.files.read(f"_manifest/{version}.json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    @contextmanager
    def pinned(self, version: int | None = None) -> Iterator[Snapshot]:
        """A snapshot that ``vacuum`` of this process leaves alone."""
        s = self.snapshot(version)
        self._pins[s.version] = self._pins.get(s.version, 0) + 1
        try:
            yield s
        finally:
            self._pins[s.version] -= 1

    def _publish(self, m: Manifest) -> Manifest:
        self.files.create(f"_manifest/{m.version}.json", m.text())
        return m

    def docs(self) -> DataFrame:
        return self.snapshot().docs()

    # writes

    def _write_segment(self, df: DataFrame, seq: int | None) -> Segment:
        """seq None: the rows carry theirs."""
        name = uuid.uuid4().hex
        out = df if seq is None else self.schema.conform(df).withColumn(SEQ, F.lit(seq).cast("long"))
        writer = out.write.option("compression", self.config.compression)
        if self.config.max_records_per_file:
            writer = writer.option("maxRecordsPerFile", self.config.max_records_per_file)
        path = f"docs/{name}"
        writer.parquet(self.files.at(path))
        r = self.spark.read.parquet(self.files.at(path)).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        return Segment(name, r.n, r.lo, r.hi, self.files.size(path))

    def _write_deletes(self, ids: DataFrame, seq: int) -> str:
        name = uuid.uuid4().hex
        ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(seq).cast("long").alias("seq")).distinct().write.parquet(self.files.at(f"deletes/{name}"))
        return name

    def apply(self, adds: Sequence[DataFrame] = (), deletes: Sequence[DataFrame] = (), batch: str | None = None, base: Manifest | None = None, applied: int | None = None) -> Manifest:
        """One new version: first the deletes, then the adds; ``applied``: the last logged operation that is in it."""
        m = base or self.manifest()
        if batch is not None and m.has_batch(batch):
            return m
        seq = m.seq + 1
        gone = tuple(self._write_deletes(d, seq) for d in deletes)
        new = tuple(self._write_segment(d, seq) for d in adds)
        new = tuple(s for s in new if s.docs)
        return self._publish(Manifest(m.version + 1, seq, time.time(), (*m.segments, *new), (*m.deletes, *gone), m.with_batch(batch), m.applied if applied is None else applied))

    def append(self, df: DataFrame, batch: str | None = None) -> Manifest:
        return self.apply([df], batch=batch)

    def delete(self, ids: DataFrame) -> Manifest:
        return self.apply(deletes=[ids])

    def latest(self, df: DataFrame) -> DataFrame:
        """One row of each id, the greatest as JSON where there are several."""
        df = self.schema.conform(df)
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.groupBy("doc_id").agg(F.max_by(row, F.to_json(row)).alias("row")).select("row.*")

    def upsert(self, df: DataFrame) -> Manifest:
        """Rows replace those of the same id; of several new ones the greatest as JSON stays."""
        df = self.latest(df)
        return self.apply([df], [df.select("doc_id")])

    # single documents, buffered and logged

    def _empty(self) -> None:
        """Nothing is buffered: rows by a running number, the numbers of each id, the ids deleted."""
        self._rows: dict[int, dict] = {}
        self._numbers: dict[int, list[int]] = {}
        self._deleted: dict[int, None] = {}
        self._bytes = self._added = 0

    def _buffer(self, row: dict) -> None:
        self._added += 1
        self._rows[self._added] = row
        self._numbers.setdefault(row["doc_id"], []).append(self._added)

    def _unbuffer(self, doc_id: int) -> None:
        for k in self._numbers.pop(doc_id, ()):
            del self._rows[k]
        self._deleted[doc_id] = None

    def _flush_if_full(self) -> None:
        if max(len(self._rows), len(self._deleted)) >= self.config.writer_batch_size:
            self.flush()

    def _log(self, op: str, **what: object) -> None:
        self.log.append(op, self.manifest().applied if self.log._next is None else 0, **what)

    def add_document(self, **values: object) -> None:
        size = len(json.dumps(values, default=str))
        if self.config.memory_limit is not None and self._bytes + size > self.config.memory_limit:
            raise OutOfMemory(f"{size} bytes are over the ingest budget")
        if values.get("doc_id") is None:
            raise InvalidArgument("a document needs a doc_id")
        self._log("add", row=values)
        self._buffer(values)
        self._bytes += size
        self._flush_if_full()

    def delete_document(self, doc_id: int) -> None:
        """Hides the id's rows that are flushed, and drops those that aren't."""
        self._log("delete", doc_id=doc_id)
        self._unbuffer(doc_id)
        self._flush_if_full()

    def update_document(self, **values: object) -> None:
        """A delete and an add as one logged operation."""
        if values.get("doc_id") is None:
            raise InvalidArgument("a document needs a doc_id")
        self._log("update", row=values)
        self._unbuffer(values["doc_id"])  # type: ignore[arg-type]
        self._buffer(values)
        self._flush_if_full()

    def _frame(self, rows: list[dict]) -> DataFrame:
        names = self.schema.struct().fieldNames()
        unknown = {k for r in rows for k in r} - set(names)
        if unknown:
            raise InvalidArgument(f"the schema has no field {sorted(unknown)}")
        from pyspark.sql import types as T

        kinds = {f.name: f.dataType for f in self.schema.struct().fields}

        def cell(name: str, v: object) -> object:
            if isinstance(v, str) and isinstance(kinds[name], T.TimestampType):  # as the log has it
                return datetime.fromisoformat(v)
            return float(v) if v is not None and isinstance(kinds[name], T.DoubleType) else v  # type: ignore[arg-type]

        return self.spark.createDataFrame([tuple(cell(n, r.get(n)) for n in names) for r in rows], self.schema.struct())

    def flush(self) -> Manifest:
        """A new version of what is buffered; none if nothing is."""
        if not self._rows and not self._deleted:
            return self.manifest()
        self.log.flush()
        adds = [self._frame(list(self._rows.values()))] if self._rows else []
        gone = [self.spark.createDataFrame([(i,) for i in self._deleted], "doc_id long")] if self._deleted else []
        m = self.apply(adds, gone, applied=self.log.last())
        self._empty()
        return m

    def commit(self) -> Manifest:
        """Flushes, and removes log files whose operations are all in a version."""
        m = self.flush()
        self.log.drop(m.applied)
        return m

    def pending(self) -> list[dict]:
        """Logged operations that no version has, in order."""
        return self.log.behind(self.manifest().applied)

    def recover(self) -> int:
        """Replays the logged operations that no version has, each once and in order; their number."""
        self.log.flush()
        tail = self.pending()
        self._empty()
        for x in tail:
            if x["op"] != "add":
                self._unbuffer(x["doc_id"] if x["op"] == "delete" else x["row"]["doc_id"])
            if x["op"] != "delete":
                self._buffer(x["row"])
        self.log._next = None  # another process may have gone on
        self.log.last(self.manifest().applied)
        self.commit()
        return len(tail)

    # upkeep

    def compact(self, files: int | None = None) -> Manifest:
        """All visible documents in one segment, without deletes."""
        m = self.manifest()
        rows = Snapshot(self, m).visible()
        s = self._write_segment(rows.coalesce(files) if files else rows, None)
        return self._publish(Manifest(m.version + 1, m.seq, time.time(), (s,) if s.docs else (), (), m.batches, m.applied))

    def merge(self) -> Manifest:
        """Merges the segments that the policy picks; rows keep their sequence, deletes stay for the others."""
        m = self.manifest()
        picked = self.config.merge_policy.pick(list(m.segments))
        if not picked:
            return m
        s = self._write_segment(Snapshot(self, m).visible(picked), None)
        rest = tuple(x for x in m.segments if x not in picked)
        return self._publish(Manifest(m.version + 1, m.seq, time.time(), (*rest, s) if s.docs else rest, m.deletes, m.batches, m.applied))

    def vacuum(self, max_versions: int | None = None) -> list[int]:
        """Removes old versions, never the last or a pinned one, and what only they had; the versions removed.

        What no version ever had may be of a write that isn't published yet, so it stays for ``orphan_seconds``.
        """
        keep = self.config.max_versions if max_versions is None else max_versions
        have = self.versions()
        gone = [v for v in have[: max(0, len(have) - max(keep, 1))] if not self._pins.get(v)]
        left = [self.manifest(v) for v in have if v not in gone]
        dropped = [self.manifest(v) for v in gone]
        for v in gone:
            self.files.remove(f"_manifest/{v}.json")
            self.files.remove(f"postings/{v}")
        for folder, names in (("docs", lambda m: {s.id for s in m.segments}), ("deletes", lambda m: set(m.deletes))):
            used, once = (set().union(*map(names, ms)) for ms in (left, dropped))
            for name in self.files.names(folder):
                if name not in used and (name in once or self.files.age(f"{folder}/{name}") > self.config.orphan_seconds):
                    self.files.remove(f"{folder}/{name}")
        return gone


class BackgroundMerge:
    """Merges a store's segments every so many seconds, in a thread of its own; a lost race is tried again next time."""

    def __init__(self, store: DocumentStore, seconds: float = 60.0):
        self.store, self.seconds, self.merges, self.conflicts = store, seconds, 0, 0
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def once(self) -> None:
        before = self.store.manifest().version
        try:
            self.merges += self.store.merge().version != before
        except Conflict:
            self.conflicts += 1

    def _run(self) -> None:
        while not self._stop.wait(self.seconds):
            self.once()

    def __enter__(self) -> BackgroundMerge:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
