"""File sources: folder scans, upload checks, document records, PDF pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx

#: A page reader: file bytes -> texts of pages, or (text, tables as rows of cells) for each.
PageReader = Callable[[bytes], list]


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = True, ordered: bool = False) -> DataFrame:
    """All matching files below a folder, with path, modificationTime, length and content; by path where ``ordered`` (which
    sorts by range, not in one task). A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files if content else files.drop("content")
    return files.orderBy("path") if ordered else files


def upload_error(path: Column, head: Column, size: Column) -> Column:
    """The first reason to refuse a file, or null: its extension, its first bytes, its size (in this order)."""
    extension = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    return (
        F.when(extension != ".pdf", F.concat(F.lit("unsupported type "), F.coalesce(extension, F.lit(""))))
        .when(F.coalesce(F.substring(head, 1, 4) != F.lit(b"%PDF"), F.lit(True)), "not a PDF")
        .when(size > config.UPLOAD_BYTES, "too large")
    )


def document_records(files: DataFrame, strategy: str = "recursive", size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """Pending document rows of scanned files; ids derive from path and length, so a rerun gives the same."""
    return files.select(
        F.sha2(F.concat_ws("|", "path", "length"), 256).alias("id"), tx.title_from_path(F.col("path")).alias("title"), F.col("path").alias("file"), F.lit("pdf").alias("file_type"),
        F.floor(F.col("length") / 1024).cast("int").alias("file_size_kb"), F.lit(strategy).alias("chunk_strategy"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"),
        F.lit("pending").alias("status"), F.col("modificationTime").alias("created_at"),
    )


def pdf_pages(files: DataFrame, reader: PageReader | None = None, mode: str = "full", id: str = "path", ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(id, page_number, text, tables, ocr_used, error) of every page of ``content``. ``mode`` ``plain`` takes stripped text as
    it is; ``full`` cleans it and keeps the tables that the reader returns (the built-in reader extracts none, so theirs are
    empty). Pages with little text go to ``ocr`` where one is given. A file that can't be read gives one row with ``error``
    and no page, so one bad file doesn't end the job."""
    from .pdf import read_pages

    read = reader or read_pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, data in zip(batch[id], batch["content"]):
                try:
                    pages = read(bytes(data))
                except Exception as e:  # noqa: BLE001  any damage of a file is that file's error
                    rows.append((key, None, None, [], False, str(e)[:500]))
                    continue
                for n, p in enumerate(pages, 1):
                    text, tables = p if isinstance(p, tuple) else (p, [])
                    scanned = ocr is not None and len(text.strip()) < config.MIN_PAGE_CHARS
                    if scanned:
                        text, tables = ocr(bytes(data), n - 1), []
                    rows.append((key, n, text, ["\n".join("| " + " | ".join(c or "" for c in r) + " |" for r in t if any(r)) for t in tables], scanned, None))
            yield pd.DataFrame(rows, columns=["id", "page_number", "text", "tables", "ocr_used", "error"])

    pages = files.select(id, "content").mapInPandas(run, "id string, page_number int, text string, tables array<string>, ocr_used boolean, error string")
    if mode == "plain":
        return pages.withColumn("text", tx.strip(F.col("text")))
    body = F.when(F.col("ocr_used"), tx.clean_ocr(F.col("text"))).otherwise(tx.clean(F.col("text")))
    return pages.withColumn("text", F.when(F.col("page_number").isNotNull(), F.concat_ws("\n\n", F.array_insert("tables", 1, body))))
