"""The service's endpoints as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..operators import chat as turns
from ..operators import ingest, prompt, stats, vectors
from ..operators.embedding import HashEmbedder, embed_query

DOCUMENT_FIELDS = ("id", "title", "file_size_kb", "page_count", "chunk_count", "status", "chunk_strategy", "created_at", "processed_at")


def document_list(documents: DataFrame) -> DataFrame:
    """All documents, newest first."""
    return documents.select(*DOCUMENT_FIELDS).orderBy(F.desc("created_at"), "id")


def document_detail(documents: DataFrame, chunks: DataFrame, id) -> DataFrame:
    """One document with its first ten chunks as an array; no row for an unknown id."""
    one = F.struct("chunk_index", "page_start", "page_end", "token_count", "is_embedded")
    first = stats.first_chunks(chunks.filter(F.col("document_id") == id)).groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("chunks"))
    return documents.filter(F.col("id") == id).select(*DOCUMENT_FIELDS).join(first, "id", "left")


def delete_document(documents: DataFrame, chunks: DataFrame, vector_table: DataFrame, id) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ingest.delete_documents(documents.filter(F.col("id") == id).select("id"), documents, chunks, vector_table)


def index_document(documents: DataFrame, chunks: DataFrame, vector_table: DataFrame, id, embedder: Callable = HashEmbedder) -> DataFrame:
    """The vector table with a ready document's chunks indexed anew; another status raises."""
    found = documents.filter(F.col("id") == id).select("status").first()
    if found is None or found.status != "ready":
        raise ValueError("the document is not ready")
    fresh = ingest.index_chunks(chunks.filter(F.col("document_id") == id), documents, embedder)
    return vectors.delete_document(vector_table, id)[0].unionByName(fresh)


def search_rows(hits: DataFrame, title: str = "doc_title") -> DataFrame:
    """Ranked hits as the search page shows them."""
    label = tx.page_label(F.col("page_start"), F.col("page_end"), "–")
    shown = {"preview": tx.preview(F.col("text")), "page_label": label, "source_label": prompt.source_label(F.col(title), F.col("page_start"), F.col("page_end"))}
    return hits.withColumns(shown).orderBy("rank")


def search(vector_table: DataFrame, question: str, k: int | None = None, document=None, document_ids=None, user=None, embedder: Callable = HashEmbedder) -> DataFrame:
    """The k chunks nearest to a question within a scope; a blank question raises."""
    if not question.strip():
        raise ValueError("a question is needed")
    found = vectors.topk(vectors.scope(vector_table, document, document_ids, user), embed_query(question, embedder), vectors.clamp_k(k), size="norm")
    return search_rows(found.drop("embedding", "norm"))


def search_stats(documents: DataFrame, chunks: DataFrame, vector_table: DataFrame) -> DataFrame:
    """Ready documents, newest first, with how far they are indexed."""
    state = vectors.completeness(documents, chunks.drop("chunk_count"), vector_table)
    names = documents.select(F.col("id").alias("document_id"), "title", "created_at")
    return state.join(names, "document_id").orderBy(F.desc("created_at"), "document_id")


def chat(questions: DataFrame, vector_table: DataFrame, messages: DataFrame | None = None, k: int | None = None, **more) -> DataFrame:
    """A batch of chat turns; k is 5 and at most 10."""
    return turns.answer(questions, vector_table, messages, config.RETRIEVE_K, vectors.clamp_k(k, config.CHAT_K, config.CHAT_K_MOST), **more)


def sessions(session_table: DataFrame, messages: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    return stats.session_list(session_table, messages, links, documents)


def session(messages: DataFrame, bridge: DataFrame, chunks: DataFrame, documents: DataFrame, id) -> DataFrame:
    return stats.session_detail(messages, bridge, chunks, documents, id)


def debug_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return stats.document_stats(documents, chunks)


def debug_chunks(chunks: DataFrame, id, page=None) -> tuple[DataFrame, DataFrame]:
    """A document's chunks (of one page where it is given), and the token statistics of just those."""
    shown = stats.chunk_list(chunks.filter(F.col("document_id") == id), page)
    return shown, stats.token_stats(shown)


def rechunk(documents: DataFrame, page_rows: DataFrame, chunks: DataFrame, id, at: Column, strategy: str | None = None, size: int | None = None, overlap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after a document ran again with overrides."""
    reset = ingest.reset_for_rechunk(documents, id, strategy, size, overlap)
    done, fresh = ingest.run_pipeline(reset.filter(F.col("id") == id), page_rows.filter(F.col("document_id") == id), at)
    return documents.filter(F.col("id") != id).unionByName(done), chunks.filter(F.col("document_id") != id).unionByName(fresh)
