"""Incremental additions to a stored chunk index from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import SMALL_CHUNKS, Chunking
from ..operators.index import ChunkIndex


def index_stream(docs: DataFrame, path: str, checkpoint: str, sizes: Chunking = SMALL_CHUNKS, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch (doc_id, text) to the index under path, one folder a batch in each table.

    A batch that runs again writes to its own folder again, so documents count once. The
    statistics of a search are taken from the tables, so nothing needs finalising.
    """

    def add(batch: DataFrame, number: int) -> None:
        ChunkIndex.build(batch, sizes).save(path, mode="overwrite", part=f"batch={number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def load_stream(spark: SparkSession, path: str) -> ChunkIndex:
    """The index of all batches so far."""
    found = ChunkIndex.load(spark, path)
    return ChunkIndex(*[getattr(found, t).drop("batch") for t in ChunkIndex.TABLES])
