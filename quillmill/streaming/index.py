"""Incremental index: chunk files arrive, changed documents replace what the index holds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillmill.operators.ledger import publish


def arriving_chunks(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Chunk files as a stream, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_batch(batch: DataFrame, index_path: str) -> None:
    """Publish one batch: the newest row of each chunk, keyed by chunk, so that a repeated batch changes nothing."""
    newest = batch.groupBy("chunk_id").agg(*[F.max_by(c, F.struct("run_key", F.xxhash64("text"))).alias(c) for c in batch.columns if c != "chunk_id"])
    publish(newest.withColumn("hash_prefix", F.substring("doc_hash", 1, 1)), index_path, key="chunk_id")


def start(chunks: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Run the index until all files that are there have been read."""
    return chunks.writeStream.foreachBatch(lambda b, _: index_batch(b, index_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and tumbling window, with a watermark for late rows; for streams and tables alike."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("ts", late)
    w = F.window("ts", f"{minutes} minutes")
    return x.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
