"""Ingestion: decisions, status machine, the batch pipeline, indexing, deletion, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..sources.sinks import chunk_id
from . import chunking, pages as pg
from .chunking import norm
from .embedding import HashEmbedder, embed


def decide(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (with title) and what to do with each: skip (known and ready, without force), reprocess, or create. Of several
    known documents of a title the newest counts; reprocessing keeps its options."""
    newest = existing.groupBy("title").agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("__d"))
    joined = files.join(newest, "title", "left")
    decision = F.when(F.col("__d").isNull(), "create").when((F.col("__d.status") == "ready") & ~F.lit(force), "skip").otherwise("reprocess")
    return joined.withColumns({"existing_id": F.col("__d.id"), "decision": decision}).drop("__d")


def summary(outcomes: DataFrame, column: str = "decision") -> DataFrame:
    return outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def next_status(status: Column, has_text: Column, n_chunks: Column, error: Column) -> Column:
    """Struct of status and error_message after a run; a ready document stays as it is."""
    problem = F.when(error.isNotNull(), error).when(~has_text, "No text extracted.").when(n_chunks == 0, "No chunks.")
    now = F.when(status == "ready", "ready").when(problem.isNotNull(), "failed").otherwise("ready")
    return F.struct(now.alias("status"), F.when(now == "failed", problem).otherwise("").alias("error_message"))


def run_pipeline(documents: DataFrame, page_rows: DataFrame, at: Column, embedder: Callable = HashEmbedder) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after extraction and chunking of all documents that aren't ready, each by its own strategy, size and
    overlap (the defaults where they are null). ``page_rows`` has document_id,
    page_number, text and (optional) ocr_used and error. Errors are columns of their document, not of the job."""
    open_ = documents.filter("status <> 'ready'")
    errors = page_rows.filter("error is not null") if "error" in page_rows.columns else None
    good = page_rows.filter("page_number is not null").join(open_.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    tidy = pg.offsets(pg.strip_repeated(good), skip_blank=True)
    full = pg.assemble(tidy).join(pg.page_array(tidy), "document_id")
    own = {"chunk_size": F.coalesce(F.col("chunk_size"), F.lit(config.CHUNK_SIZE)).cast("int"), "chunk_overlap": F.coalesce(F.col("chunk_overlap"), F.lit(config.CHUNK_OVERLAP)).cast("int")}
    todo = full.join(open_.select(F.col("id").alias("document_id"), "chunk_strategy", *[v.alias(k) for k, v in own.items()]), "document_id").filter("has_text")
    todo = todo.select("document_id", "chunk_strategy", *own, F.col("full_text").alias("text"), "pages")
    made = chunking.long_enough(chunking.by_strategy(todo, lambda c: embed(c, embedder), "document_id", size=F.col("chunk_size"), overlap=F.col("chunk_overlap")))
    placed = made.join(todo.select("document_id", "pages"), "document_id")
    chunks = placed.select("document_id", "text", "token_count", "chunk_index", pg.page_of(F.col("char_start"), F.col("pages")).alias("page_start"), pg.page_of(F.col("char_end"), F.col("pages")).alias("page_end"), "char_start", "char_end", chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), F.lit(None).cast("string").alias("embedding_model"), F.lit(False).alias("is_embedded"), F.lit(None).cast("timestamp").alias("embedded_at"))
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    facts = full.select(F.col("document_id").alias("id"), F.col("page_count").alias("__pages"), F.col("has_text").alias("__text"))
    joined = documents.join(facts, "id", "left").join(counts, "id", "left")
    error = F.lit(None).cast("string")
    if errors is not None:
        joined = joined.join(errors.groupBy(F.col("document_id").alias("id")).agg(F.min("error").alias("__error")), "id", "left")
        error = F.col("__error")
    done = joined.withColumn("__s", next_status(F.col("status"), F.coalesce("__text", F.lit(False)), F.coalesce("__n", F.lit(0)), error))
    ran = F.col("status") != "ready"
    out = done.withColumns({
        "page_count": F.when(ran, F.coalesce("__pages", "page_count")).otherwise(F.col("page_count")), "chunk_count": F.when(ran, F.coalesce("__n", F.lit(0))).otherwise(F.col("chunk_count")),
        "processed_at": F.when(ran & (F.col("__s.status") == "ready"), at).otherwise(F.col("processed_at")), "updated_at": F.when(ran, at).otherwise(F.col("updated_at")),
    }).withColumns({"status": F.col("__s.status"), "error_message": F.when(ran, F.col("__s.error_message")).otherwise(F.col("error_message"))})
    return out.select(*documents.columns), chunks


def index_chunks(chunks: DataFrame, documents: DataFrame, embedder: Callable = HashEmbedder) -> DataFrame:
    """Vector rows of chunks, with their norm, so that a search is one dot product."""
    named = chunks.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), F.coalesce(F.col("uploaded_by").cast("string"), F.lit("")).alias("user_id")), "document_id")
    return named.withColumn("embedding", embed(F.col("text"), embedder)).withColumn("norm", norm(F.col("embedding"))).select("chunk_id", "embedding", "norm", "text", "document_id", "chunk_index", "page_start", "page_end", "char_start", "char_end", "token_count", "doc_title", "user_id")


def delete_documents(ids: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, id: str = "id", doc: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without some documents, their chunks and their vectors."""
    gone = ids.select(F.col(id).alias(doc)).distinct()
    return documents.join(gone.withColumnRenamed(doc, id), id, "left_anti"), chunks.join(gone, doc, "left_anti"), vectors.join(gone, doc, "left_anti")


def reset_for_rechunk(documents: DataFrame, id, strategy: str | None = None, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """A document set to pending with overrides; one that is processing raises."""
    if documents.filter((F.col("id") == id) & (F.col("status") == "processing")).limit(1).count():
        raise ValueError("the document is processing")
    hit = F.col("id") == id
    new = {"status": F.lit("pending"), "error_message": F.lit("")}
    new |= {k: F.lit(v) for k, v in (("chunk_strategy", strategy), ("chunk_size", size), ("chunk_overlap", overlap)) if v is not None}
    return documents.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


def deactivate(sessions: DataFrame, id) -> DataFrame:
    return sessions.withColumn("is_active", F.when(F.col("id") == id, False).otherwise(F.col("is_active")))


def ensure_sessions(sessions: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """``sessions`` and a new active one for each wanted id (and user) that isn't there."""
    fresh = wanted.dropDuplicates(["id"]).join(sessions.select("id"), "id", "left_anti")
    rows = fresh.withColumns({"title": F.lit(""), "is_active": F.lit(True), "created_at": at, "updated_at": at})
    rows = rows.withColumns({"top_k_retrieval": F.lit(config.RETRIEVE_K).cast("smallint"), "top_k_rerank": F.lit(config.RERANK_K).cast("smallint")})
    return sessions.unionByName(rows.select(*[c for c in rows.columns if c in sessions.columns]), allowMissingColumns=True)


def open_sessions(sessions: DataFrame, links: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions, links) with a session for each wanted (id, user_id, documents): the one of that id, where it has no other user,
    else a new one, named after id and user, that is linked to the wanted documents. An existing session keeps its links."""
    asked = wanted.groupBy("id", "user_id").agg(F.max("documents").alias("documents"))
    known = sessions.select("id", F.col("user_id").alias("__owner"), F.lit(True).alias("__known"))
    met = asked.join(known, "id", "left")
    mine = F.coalesce("__known", F.lit(False)) & (F.col("user_id").isNull() | F.col("user_id").eqNullSafe(F.col("__owner")))
    name = F.when(F.col("__known"), F.concat_ws("-", "id", F.col("user_id").cast("string"))).otherwise(F.col("id"))
    fresh = met.filter(~mine).select(name.alias("id"), "user_id", "documents").join(sessions.select("id"), "id", "left_anti")
    rows = ensure_sessions(sessions, fresh.select("id", "user_id"), at)
    new = fresh.select(F.col("id").alias("session_id"), F.explode("documents").alias("document_id"))
    return rows, links.unionByName(new)


def session_title(title: Column, question: Column, n_messages: Column) -> Column:
    """The first question's 80 characters for a session without a title and at most two messages."""
    return F.when((F.coalesce(title, F.lit("")) == "") & (n_messages <= 2), F.substring(question, 1, 80)).otherwise(title)


def preview_rows(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("preview", tx.preview(F.col("text")))
