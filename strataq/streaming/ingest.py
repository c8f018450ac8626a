"""Incremental ingestion: new files of a landing folder, in micro-batches, idempotent by document and chunk id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import run_pipeline
from ..sources.files import PageReader, document_records, pdf_pages, upload_error
from ..sources.sinks import save_chunks

FILES = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of the files that appear below a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def process_batch(files: DataFrame, chunks_path: str, documents_path: str, batch: int, reader: PageReader | None = None) -> None:
    """One micro-batch: refuses bad files, extracts, chunks and stores. A batch that runs again overwrites what it wrote."""
    good = files.filter(upload_error(F.col("path"), F.col("content"), F.col("length")).isNull())
    records = document_records(good).withColumns({"uploaded_by": F.lit(None).cast("long"), "page_count": F.lit(0), "chunk_count": F.lit(0), "error_message": F.lit(""), "updated_at": F.col("created_at"), "processed_at": F.lit(None).cast("timestamp")})
    page_rows = pdf_pages(good, reader).join(records.select(F.col("file").alias("id"), F.col("id").alias("document_id")), "id").drop("id")
    documents, chunks = run_pipeline(records, page_rows, F.current_timestamp())
    documents.write.mode("overwrite").parquet(f"{documents_path}/batch={batch}")
    save_chunks(chunks, chunks_path)


def ingest_available(spark: SparkSession, folder: str, chunks_path: str, documents_path: str, checkpoint: str, reader: PageReader | None = None, then: Callable | None = None) -> StreamingQuery:
    """Processes what is there and ends."""

    def each(files: DataFrame, batch: int) -> None:
        process_batch(files, chunks_path, documents_path, batch, reader)
        if then is not None:
            then(batch)

    return landing(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; batch tables and streams alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")
