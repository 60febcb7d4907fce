"""Continuous ingestion into a store by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import DocumentStore


def ingest(stream: DataFrame, store: DocumentStore, checkpoint: str, name: str = "ingest", upsert: bool = False, interval: str | None = None) -> StreamingQuery:
    """Appends each micro-batch as one version.

    A batch's number is part of its version's manifest, so a batch that is run
    again after a failure isn't written twice.  Without ``interval`` the query ends
    when all that was there at its start is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        key = f"{name}:{number}"
        if upsert:
            rows = store.latest(batch)
            store.apply([rows], [rows.select("doc_id")], batch=key)
        else:
            store.append(batch, batch=key)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", most_files: int | None = None) -> DataFrame:
    """A stream of the files in a folder; ``most_files`` a micro-batch, so that a backlog can't overrun the writer."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows by key and tumbling window of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
