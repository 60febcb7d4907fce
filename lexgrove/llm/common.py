"""Small helpers the operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for written tables.

    It is the session's ``spark.checkpoint.dir``; only a local session without
    one gets a folder of its own under the warehouse.
    """
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
        spark.sparkContext.setCheckpointDir(have)
    return have


#: Paths of written tables that are still there.
_paths: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Lost executors then cost the reader nothing but a read.  ``discard`` removes
    the table once nothing reads it any more; those that a result still reads are
    removed by ``release`` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _paths.discard(path)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``written`` made; DataFrames that would still read them must have been written themselves."""
    for t in tables:
        if t is not None and getattr(t, "written_path", None) in _paths:
            _remove(t.sparkSession, t.written_path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more, rather than at the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, keep: DataFrame | None = None, since: frozenset[str] = frozenset()) -> None:
    """Removes all tables written after ``since`` was taken by ``held``, but for ``keep``: for when results have been stored."""
    for path in _paths - since - {getattr(keep, "written_path", None)}:
        _remove(spark, path)


def held() -> frozenset[str]:
    return frozenset(_paths)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the JVM may have gone first
            pass


def whole_id(name: str = "doc_id") -> Column:
    """A document's integer id; what isn't a whole number counts as null."""
    return F.col(f"`{name}`").try_cast("long")


#: What tells rows apart: doc_id and 128 bits of the text.  Texts of different doc_ids are never compared by it.
KEY = ("doc_id", "key_a", "key_b")


def keys() -> list[Column]:
    """The KEY columns of a table with doc_id and text."""
    return [whole_id().alias("doc_id"), F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]


def beside(docs: DataFrame, *columns: Column) -> DataFrame:
    """The whole rows as one struct, ``row``, and columns that can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def rows_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def split(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are certainly not in ``gone``, the others), both with ``row`` and KEY; a Bloom filter decides.

    So most texts stay where they are: only the others need to be shuffled.
    """
    among = may_be_among(gone.select(F.xxhash64(*KEY).alias("key")))
    rows = beside(docs, *keys())
    known = F.col("doc_id").isNotNull() & F.col("row").getField("text").isNotNull()
    rows = rows.withColumn("probe", F.when(known, F.xxhash64(*KEY)))
    return rows.where(~among("probe")).drop("probe"), rows.where(among("probe")).drop("probe")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose KEY isn't in ``gone``; those without a doc_id or text stay."""
    clear, rest = split(docs, gone)
    return rows_of(clear.unionByName(rest.join(gone.select(*KEY).hint("merge"), list(KEY), "left_anti").select(clear.columns)), docs)


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``: each holds all rows of its keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key))
        last = k[-1].as_py()
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == last == k[0].as_py():
            held.append(batch)
            continue
        cut = batch.num_rows
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:  # first row of the last key
            mid = (lo + hi) // 2
            if k[mid].as_py() == last:
                hi = mid
            else:
                lo = mid + 1
        cut = lo
        if cut or (held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != last):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


BLOOM_MOST_BITS, BLOOM_BLOCK = 1 << 29, 1 << 19


def _bloom_places(x, bits: int):
    import numpy as np

    from .bytesops import mix

    h = mix(x.view(np.uint64).copy())
    g = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return [((h + np.uint64(k) * g) & np.uint64(bits - 1)).astype(np.int64) for k in range(4)]


def bloom(ids: DataFrame):
    """(broadcast bitmap, its bits) of a Bloom filter of ``ids`` (one long column).

    It has twelve to 24 bits a value, but 64 MB at most, beyond which it only lets
    more rows pass.  Built by the executors from partial bitmaps; the driver gets
    the final blocks.
    """
    import zlib

    import numpy as np

    bits = max(1 << 19, min(BLOOM_MOST_BITS, 1 << (ids.count() * 12).bit_length()))
    names = ["block", "field"]

    def part(batches):
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for p in _bloom_places(x, bits):
                np.bitwise_or.at(field, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
        for k in range(0, bits // 8, BLOOM_BLOCK // 8):
            block = field[k : k + BLOOM_BLOCK // 8]
            if block.any():
                yield pa.record_batch([pa.array([k]), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names)

    def union(batches):
        for t in by_key(batches, "block"):
            whole: dict = {}
            for k, c in zip(t["block"].to_pylist(), t["field"].to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.uint8)
                whole[k] = whole[k] | x if k in whole else x
            yield pa.record_batch([pa.array(list(whole), pa.int64()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], names)

    schema = "block long, field binary"
    field = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(part, schema).repartition("block").sortWithinPartitions("block").mapInArrow(union, schema).collect():
        field[r.block : r.block + BLOOM_BLOCK // 8] = np.frombuffer(r.field, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(field.tobytes()), bits


def in_bloom(filter_, x):
    """Which of an array's 64-bit numbers may be among the filter's."""
    import numpy as np

    shared, bits = filter_
    have = np.frombuffer(shared.value, np.uint8)
    ok = np.ones(len(x), bool)
    for p in _bloom_places(x, bits):
        ok &= (have[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


def may_be_among(ids: DataFrame):
    """A Column function that is true for every value of ``ids`` (one long column) and false for most others.

    It is a Bloom filter, so the caller joins afterwards.  It is there to keep texts
    out of a shuffle that only some of them need.
    """
    import numpy as np

    filter_ = bloom(ids)

    @F.pandas_udf("boolean")
    def among(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(in_bloom(filter_, x.to_numpy().astype(np.int64)))

    def test(column):  # noqa: ANN001, ANN202
        column = F.col(column) if isinstance(column, str) else column
        # nulls are taken out first: pandas would make floats of the other numbers
        return column.isNotNull() & among(F.coalesce(column, F.lit(0)).cast("long"))

    return test


def frugal(f):
    """An Arrow function whose worker gives its freed memory back when a task ends; workers are kept for later tasks."""
    from functools import wraps

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library
