"""Statistics over chunks, sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def token_stats(chunks: DataFrame, *keys: str, tokens: str = "token_count") -> DataFrame:
    """min, max, avg (half to even), median (floor of the mean of the middle two), total and number of tokens."""
    t = F.col(tokens)
    cols = {
        "min_tokens": F.min(t), "max_tokens": F.max(t), "avg_tokens": F.bround(F.avg(t), 0), "median_tokens": F.floor(F.median(t)),
        "total_tokens": F.sum(t), "n_chunks": F.count(F.lit(1)),
    }
    return chunks.groupBy(*keys).agg(*[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in cols.items()])


def document_stats(documents: DataFrame, chunks: DataFrame, id: str = "id", doc: str = "document_id") -> DataFrame:
    """All documents with the token statistics of their chunks; zeros without any."""
    stats = token_stats(chunks, doc).withColumnRenamed(doc, id)
    names = [c for c in stats.columns if c != id]
    return documents.join(stats, id, "left").na.fill(0, names)


def page_filter(chunks: DataFrame, page: int | str | None) -> DataFrame:
    """Chunks that touch a page; anything but a whole number filters nothing."""
    try:
        p = int(page)
    except (TypeError, ValueError):
        return chunks
    return chunks.filter(F.lit(p).between(F.col("page_start"), F.col("page_end")))


def token_share(chunks: DataFrame, doc: str = "document_id", tokens: str = "token_count") -> DataFrame:
    """``token_bar``: tokens as a percentage of the document's largest chunk."""
    return chunks.withColumn("token_bar", F.round(100 * F.col(tokens) / F.max(tokens).over(Window.partitionBy(doc))).cast("int"))


def first_chunks(chunks: DataFrame, n: int = 10, doc: str = "document_id") -> DataFrame:
    w = Window.partitionBy(doc).orderBy("chunk_index")
    return chunks.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def session_list(sessions: DataFrame, messages: DataFrame, links: DataFrame | None = None, documents: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Active sessions, newest first: title or ``Untitled``, message_count, and their documents as an array."""
    newest = sessions.filter("is_active").orderBy(F.desc("updated_at"), "id").limit(most)
    shown = F.broadcast(newest.select(F.col("id").alias("session_id")))  # ``most`` rows
    counts = messages.join(shown, "session_id", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    out = newest.join(counts, "id", "left").na.fill(0, ["message_count"])
    if links is not None and documents is not None:
        named = links.join(shown, "session_id", "left_semi").join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
        lists = named.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("document_id").alias("id"), "title"))).alias("documents"))
        none = F.array().cast(lists.schema["documents"].dataType)
        out = out.join(lists, "id", "left").withColumn("documents", F.coalesce("documents", none))
    return out.withColumn("title", untitled(F.col("title"))).orderBy(F.desc("updated_at"), "id")


def untitled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def session_detail(messages: DataFrame, bridge: DataFrame, chunks: DataFrame, documents: DataFrame, session) -> DataFrame:
    """Messages of a session, oldest first; assistant's carry their sources and token counts."""
    own = messages.filter(F.col("session_id") == session)
    source = F.struct("chunk_index", F.substring("text", 1, 200).alias("text"), "page_start", "page_end", "title")
    mine = own.select(F.col("id").alias("message_id"))  # the messages of one session
    rows = bridge.join(mine, "message_id", "left_semi").join(chunks, "chunk_id").join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    sources = rows.groupBy(F.col("message_id").alias("id")).agg(F.sort_array(F.collect_list(source)).alias("sources"))
    tokens = F.struct("prompt_tokens", "completion_tokens", "total_tokens")
    out = own.join(sources, "id", "left")
    assistant = F.col("role") == "assistant"
    return out.withColumns({"sources": F.when(assistant, F.col("sources")), "tokens": F.when(assistant, tokens)}).orderBy("created_at", "id")


def cited_documents(messages: DataFrame, bridge: DataFrame, chunks: DataFrame, documents: DataFrame, message) -> DataFrame:
    """The distinct documents behind a message's sources."""
    used = bridge.filter(F.col("message_id") == message).join(chunks, "chunk_id").select(F.col("document_id").alias("id"))
    return documents.join(used, "id", "left_semi")


def chunk_list(chunks: DataFrame, page: int | str | None = None) -> DataFrame:
    """Chunks by number with a preview, of one page where it is given."""
    return page_filter(chunks, page).withColumn("preview", tx.preview(F.col("text"))).orderBy("document_id", "chunk_index")
