"""Streaming ingest: files as they come, each content once, pages to chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks
from ..sources import uploads


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Registered uploads of a folder, as a stream."""
    return spark.readStream.format("binaryFile").schema(uploads.BINARY).load(folder)


def once(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; what the watermark passes leaves the state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def ingest(pages: DataFrame, table: str, checkpoint: str, config: chunks.Chunking = chunks.Chunking()) -> StreamingQuery:
    """Chunks of a stream of whole documents (document_id, page_number, raw_text) under ``table``, a folder for each
    batch: a batch that is run again after a failure replaces its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        made = chunks.build_chunks(chunks.normalise_pages(batch), config)
        made.withColumn("ingested", F.current_timestamp()).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(chunk_table: DataFrame) -> DataFrame:
    """The chunks of each document's last batch: an ingest replaces what went before."""
    last = chunk_table.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return chunk_table.join(last, ["document_id", "batch"], "left_semi")
