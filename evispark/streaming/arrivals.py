"""Extension: documents as they arrive, chunked by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import MAX_CHARS, chunk_snippets


def stream_snippets(spark: SparkSession, folder: str, max_chars: int = MAX_CHARS, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of chunks of the text documents (source_id, locator, text, type as Parquet) that appear in a folder."""
    docs = spark.readStream.schema("source_id string, locator string, text string, type string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return chunk_snippets(docs, max_chars)


def counts_by_window(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
