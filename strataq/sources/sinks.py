"""Sinks: chunk and vector tables, chat messages, JSON events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(document: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("chunk"), document.cast("string"), index.cast("string"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, doc: str = "document_id") -> DataFrame:
    """The stored chunks with those of each fresh document replaced; running it twice is running it once."""
    fresh = fresh.withColumn("chunk_id", chunk_id(F.col(doc), F.col("chunk_index")))
    return stored.join(fresh.select(doc).distinct(), doc, "left_anti").unionByName(fresh, allowMissingColumns=True)


def save_chunks(fresh: DataFrame, path: str, doc: str = "document_id", buckets: int = 256) -> None:
    """Overwrites only the bucket folders that fresh documents fall into, together with the other documents of those.

    The new rows of these buckets are first written beside the table, so no task reads a folder that is being replaced, and
    rows that a lost executor held can be made again; that copy is deleted at the end."""
    spark = fresh.sparkSession
    bucketed = fresh.withColumn("chunk_id", chunk_id(F.col(doc), F.col("chunk_index"))).withColumn("bucket", F.pmod(F.hash(doc), F.lit(buckets)))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = [r.bucket for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(fresh.select(doc).distinct(), doc, "left_anti")
        bucketed = old.unionByName(bucketed, allowMissingColumns=True)
        beside = f"{path.rstrip('/')}__staged"
        bucketed.write.mode("overwrite").parquet(beside)
        bucketed = spark.read.schema(bucketed.schema).parquet(beside)
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}__staged")
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)


def append_turns(messages: DataFrame, bridge: DataFrame, answers: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """``messages`` and ``bridge`` with a user and an assistant row for each answer, and links to its cited chunks."""
    columns = messages.columns
    stamped = answers.withColumn("__at", at)
    own = F.concat_ws("-", "session_id", F.unix_micros("__at").cast("string"))
    user = stamped.select(F.concat(own, F.lit("-u")).alias("id"), "session_id", F.lit("user").alias("role"), F.col("question").alias("content"), F.col("__at").alias("created_at"))
    assistant = stamped.select(F.concat(own, F.lit("-a")).alias("id"), "session_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), (F.col("__at") + F.expr("interval 1 microsecond")).alias("created_at"), *[c for c in ("prompt_tokens", "completion_tokens", "total_tokens", "retrieval_scores", "was_streamed") if c in answers.columns and c in columns])
    rows = messages.unionByName(user, allowMissingColumns=True).unionByName(assistant, allowMissingColumns=True)
    links = stamped.select(F.concat(own, F.lit("-a")).alias("message_id"), F.explode("cited_chunks").alias("chunk_id"))
    return rows.select(*columns), bridge.unionByName(links)


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with updated_at no earlier than their newest message."""
    newest = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("__t"))
    return sessions.join(newest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "__t")).select(*sessions.columns)


def events(tokens: Column, done: Column, error: Column | None = None) -> Column:
    """Server-sent JSON lines of an answer: one per token, then the closing one, or the error's in its place where there is one."""
    lines = F.transform(tokens, lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("token").alias("type"), t.alias("text")))))
    last = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("done").alias("type"), done.alias("payload"))))
    if error is not None:
        failed = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("error").alias("type"), error.alias("text"))))
        last = F.when(error.isNull(), last).otherwise(failed)
    return F.concat(F.coalesce(lines, F.array().cast("array<string>")), F.array(last))
