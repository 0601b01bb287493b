"""Continuous ingestion: new files become chunks, and chunks without a vector get one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators.sections import chunks, sections
from fathomline.operators.vectors import missing
from fathomline.sources.files import append_vectors, read_vectors
from fathomline.sources.versions import VectorStore


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, size: int = 1200, overlap: int = 120) -> StreamingQuery:
    """Reads ``rel, text`` rows as they arrive under ``source`` (Parquet) and appends their chunks to ``target``.

    Files are told apart by path: each arrives once, and ids depend on the path
    alone, so a batch that is replayed after a failure writes the same rows. It
    replaces its own folder, which makes the sink idempotent.
    """

    def store(batch: DataFrame, number: int) -> None:
        chunks(sections(batch), size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema("rel string, text string").parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_stream(
    spark: SparkSession, source: str, store: VectorStore, checkpoint: str, make_vectors: Callable[[DataFrame], DataFrame], files: int = 8, name: str = "embed"
) -> StreamingQuery:
    """Embeds the chunks ``id, text`` that arrive under ``source`` (Parquet), at most ``files`` files in a micro-batch.

    Each batch embeds what the store lacks and is committed with its number, so
    a run that follows a crash does the batches that are still open and no
    other; a batch that was committed before its checkpoint is recognised.
    Null texts are sent as empty ones, as ``embed`` does.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if not store.versions.latest().has((name, number)):
            todo = missing(batch.select("id", F.col("text")).dropDuplicates(["id"]), store.read())
            store.upsert(make_vectors(todo), (name, number))

    stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_missing(spark: SparkSession, chunk_path: str, vector_path: str, make_vectors: Callable[[DataFrame], DataFrame]) -> None:
    """Appends vectors of the chunks that have none; run again after a crash it goes on where it stopped."""
    rows = spark.read.parquet(chunk_path)
    append_vectors(make_vectors(missing(rows, read_vectors(spark, vector_path)).select("id", F.col("text"))), vector_path)
