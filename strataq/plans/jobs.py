"""Batch jobs: ``python -m strataq.plans.jobs ingest FOLDER ROOT [--dry-run] [--force]`` and ``... index ROOT [--force]``.

ROOT holds the tables documents, chunks and vectors as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, vectors
from ..schema import CHUNKS, DOCUMENTS, VECTORS
from ..sources import files


def stored(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table of ``root``; the one that a broken ``write`` put aside, where that is all there is; an empty one where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for place in (f"{root}/{name}", f"{root}/{name}__old"):
        if fs.exists(path(place)):
            return spark.read.schema(schema).parquet(place)
    return spark.createDataFrame([], schema)


def write(df: DataFrame, root: str, name: str) -> None:
    """Replaces a table, also where ``df`` reads it: the new rows are written beside it, the old ones step aside, the new ones take
    the name, and only then the old ones go. A run that ended between leaves one of them whole, which ``stored`` finds."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{root}/{name}__new")
    fs.delete(path(f"{root}/{name}__old"), True)
    if fs.exists(path(f"{root}/{name}")) and not fs.rename(path(f"{root}/{name}"), path(f"{root}/{name}__old")):
        raise OSError(f"{root}/{name} can't be moved")
    if not fs.rename(path(f"{root}/{name}__new"), path(f"{root}/{name}")):
        raise OSError(f"{root}/{name}__new can't be moved")
    fs.delete(path(f"{root}/{name}__old"), True)


def run_ingest(spark: SparkSession, folder: str, root: str, dry_run: bool = False, force: bool = False, reader=None) -> DataFrame:
    """Scans, decides, extracts, chunks and stores; returns the number of files by decision."""
    documents = stored(spark, root, "documents", DOCUMENTS)
    scanned = files.scan_folder(spark, folder)
    records = files.document_records(scanned)
    plan = ingest.decide(records, documents, force)
    counts = ingest.summary(plan)
    if dry_run:
        return counts
    result = spark.createDataFrame(counts.collect(), counts.schema)  # three rows at most
    create = plan.filter("decision = 'create'").select(*records.columns)
    again = documents.join(plan.filter("decision = 'reprocess'").select(F.col("existing_id").alias("id")), "id", "left_semi").withColumn("status", F.lit("pending"))
    todo = spark.createDataFrame([], DOCUMENTS).unionByName(create, allowMissingColumns=True).unionByName(again)
    ids = plan.filter("decision <> 'skip'").select("file", F.coalesce("existing_id", "id").alias("document_id"))
    pages = files.pdf_pages(scanned.join(ids.select(F.col("file").alias("path")), "path", "left_semi"), reader).join(ids.withColumnRenamed("file", "id"), "id").drop("id")
    write(pages, root, "pages")  # read twice below: files are opened once, and both tables are of the same pages
    done, chunks = ingest.run_pipeline(todo, spark.read.schema(pages.schema).parquet(f"{root}/pages"), F.current_timestamp())
    gone = ids.select("document_id").distinct()
    old = stored(spark, root, "chunks", CHUNKS).join(gone, "document_id", "left_anti")
    write(old.unionByName(chunks.select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS])), root, "chunks")
    write(documents.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti").unionByName(done.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENTS])), root, "documents")
    return result


def run_index(spark: SparkSession, root: str, force: bool = False) -> int:
    """Embeds the chunks of ready documents that have some without a vector; returns the number of vectors written."""
    documents, chunks = stored(spark, root, "documents", DOCUMENTS), stored(spark, root, "chunks", CHUNKS)
    todo = vectors.unembedded(documents, chunks, force).select(F.col("id").alias("document_id"))
    fresh = ingest.index_chunks(chunks.join(todo, "document_id", "left_semi"), documents)
    table = stored(spark, root, "vectors", VECTORS).join(todo, "document_id", "left_anti").unionByName(fresh.select(*[F.col(f.name).cast(f.dataType) for f in VECTORS]))
    n = fresh.count()
    write(table, root, "vectors")
    write(vectors.mark_embedded(chunks, stored(spark, root, "vectors", VECTORS), F.current_timestamp()), root, "chunks")
    return n


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("job", choices=("ingest", "index"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if args.job == "ingest":
        run_ingest(spark, args.paths[0], args.paths[1], args.dry_run, args.force).show()
    else:
        print(run_index(spark, args.paths[0], args.force))


if __name__ == "__main__":
    main()
