"""Incremental ingestion as a stream of document files (an extra beside the batch job)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions import embed
from paperloom.operators.chunk import chunk_documents
from paperloom.sources.readers import DOCUMENT
from paperloom.sources.sinks import VectorStore


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of new JSON-line files in a folder."""
    return spark.readStream.schema(DOCUMENT).json(path)


def index_stream(documents: DataFrame, store: VectorStore, checkpoint: str) -> StreamingQuery:
    """Chunk, embed and upsert each micro-batch; a batch that is repeated replaces its own rows."""

    def batch(df: DataFrame, _: int) -> None:
        chunks = chunk_documents(df.dropDuplicates(["document_id"])).select("chunk_id", "document_id", "text")
        missing, _ = store.missing(chunks)
        vectors = embed.hash_embedding(missing, "chunk_id", "text")
        store.upsert(missing.join(vectors, "chunk_id").select("chunk_id", "document_id", "text", "embedding"))

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per window and kind with a watermark, for batch and streaming input alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", F.round("total", 4).alias("total"))
