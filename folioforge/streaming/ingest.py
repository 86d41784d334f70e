"""Incremental ingest: documents arriving as files become chunks as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioforge import schemas
from folioforge.operators.chunking import ChunkSettings, chunk_documents


def stream_chunks(
    spark: SparkSession,
    source: str,
    out: str,
    state: str,
    cfg: ChunkSettings = ChunkSettings(),
    continuous: str | None = None,
) -> StreamingQuery:
    """Chunk new document files below ``source`` and append the chunks to ``out``.

    Chunking is a map, so the stream keeps no state but the list of files done, in
    ``state``; file source and Parquet sink make each file's chunks appear exactly once.
    Stops when all present files are done, or runs on with a ``continuous`` interval.
    """
    documents = spark.readStream.schema(schemas.DOCUMENT).parquet(source)
    writer = (
        chunk_documents(documents, cfg)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
    )
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()
