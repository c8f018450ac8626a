"""Registered queries of the text and vector operators over the test tables. Their SQL is in ``oracles``.

Lines of ``documents`` stand for pages, its ``source`` for a document; ``embeddings.label`` stands for a document, ``vec_id``
for a chunk; ``conversations`` for sessions and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chat, chunking, ingest, prompt, rerank, stats, vectors
from ..operators import pages as pg
from ..sources.files import upload_error
from ..schema import MESSAGE_CHUNKS, MESSAGES, SESSION_DOCUMENTS
from ..sources.sinks import append_turns, chunk_id, events, replace_chunks
from ..sources.tables import table
from ..streaming.ingest import windowed_counts
from . import api, oracles

SIZE, OVERLAP = 128, 16


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as pages of them."""
    return _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_number"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("document_id"))


def _query(spark: SparkSession, d: str) -> list[float]:
    return _vectors(spark, d).orderBy("chunk_id").select("embedding").first()[0]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors nearest to the first of each label."""
    v = _vectors(spark, d)
    first = v.groupBy("document_id").agg(F.min_by("embedding", "chunk_id").alias("query")).select(F.col("document_id").alias("query_id"), "query")
    return vectors.batch_topk(v, first, 20)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed(_docs(spark, d).select("doc_id", "source", "text"), size=SIZE, overlap=OVERLAP, offsets=False)


# --- chunking --------------------------------------------------------------------------------------------------------


def chunk_fixed(spark, d):
    return chunking.long_enough(_fixed(spark, d)).select("doc_id", "chunk_index", "text", "token_count")


def chunk_fixed_stats(spark, d):
    return stats.token_stats(chunking.long_enough(_fixed(spark, d)), "source")


def chunk_fixed_offsets(spark, d):
    tidy = pg.offsets(_lines(spark, d))
    arrays = pg.page_array(tidy).withColumnRenamed("document_id", "doc_id")
    docs = _docs(spark, d).select("doc_id", "text").join(arrays, "doc_id")
    return chunking.fixed(docs, size=SIZE, overlap=OVERLAP, pages="pages").select("doc_id", "chunk_index", "char_start", "char_end", "page_start", "page_end")


def chunk_recursive(spark, d):
    return chunking.long_enough(chunking.recursive(_docs(spark, d).select("doc_id", "text"), size=SIZE, overlap=OVERLAP)).select("doc_id", "chunk_index", "text", "char_start", "char_end", "token_count")


def chunk_recursive_native(spark, d):
    return chunking.long_enough(chunking.recursive(_docs(spark, d).select("doc_id", "text"), size=SIZE, overlap=OVERLAP, engine="native")).select("doc_id", "chunk_index", "text", "char_start", "char_end", "token_count")


def chunk_recursive_exact(spark, d):
    return chunking.recursive(_docs(spark, d).select("doc_id", "text"), size=SIZE, overlap=OVERLAP, offsets="exact").select("doc_id", "chunk_index", "char_start", "char_end", "token_count")


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))


def semantic_breakpoints(spark, d):
    rows = chunking.breakpoint_groups(_vectors(spark, d), "document_id", "chunk_id", threshold=0.0)
    return rows.select("document_id", "chunk_id", F.round("similarity", 4).alias("similarity"), "group_id")


def merge_small_groups(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence")).withColumn("token_count", tx.estimate_tokens(F.col("sentence")))
    groups = rows.withColumn("group_id", F.floor(F.col("pos") / 2).cast("int"))
    return chunking.merge_small_groups(groups, "doc_id", "pos").select("doc_id", "pos", "group_id", "merged_id")


def semantic_chunks(spark, d):
    from ..operators.embedding import embed

    return chunking.semantic(_docs(spark, d).select("doc_id", "text"), embed, "doc_id", threshold=0.05).select("doc_id", "chunk_index", "char_start", "char_end", "token_count")


def chunk_by_strategy(spark, d):
    from ..operators.embedding import embed

    docs = _docs(spark, d).select("doc_id", "text", F.element_at(F.array(F.lit("fixed"), F.lit("semantic"), F.lit("recursive"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int")).alias("chunk_strategy"))
    return chunking.by_strategy(docs, embed, "doc_id", size=SIZE, overlap=OVERLAP).groupBy("chunk_strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


# --- text and pages --------------------------------------------------------------------------------------------------


def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean(F.col("html")).alias("cleaned"))


def clean_ocr_lines(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean_ocr(F.col("html")).alias("cleaned"))


def table_text(spark, d):
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, r" \| "))
    return _docs(spark, d).filter(F.contains("text", F.lit(" | "))).select("doc_id", tx.table_to_text(rows).alias("table_text"))


def text_measures(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", tx.word_count(t).alias("word_count"), tx.estimate_tokens(t).alias("token_count"), tx.preview(t).alias("preview"), tx.needs_ocr(t).alias("needs_ocr"))


def _source_pages(spark, d):
    return _docs(spark, d).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")


def repeated_lines(spark, d):
    pages = _source_pages(spark, d).withColumn("document_id", F.concat("document_id", F.lit("/"), (F.col("page_number") % 7).cast("string")))
    low = pages.withColumn("text", F.regexp_replace("text", "[A-Za-z ]{30,}", "line"))
    return pg.repeated_lines(low).select("document_id", "line", "n", "n_pages")


def strip_repeated_lines(spark, d):
    pages = _source_pages(spark, d).withColumn("text", F.concat(F.lit("Header of "), F.col("document_id"), F.lit("\n"), F.col("text")))
    return pg.strip_repeated(pages).select("document_id", "page_number", "text")


def page_offsets(spark, d):
    return pg.offsets(_lines(spark, d)).select("document_id", "page_number", "char_start", "char_end", "word_count", "is_empty")


def page_offsets_exact(spark, d):
    return pg.offsets(_lines(spark, d), skip_blank=True).select("document_id", "page_number", "char_start", "char_end")


def page_assembly(spark, d):
    out = pg.assemble(_lines(spark, d))
    return out.select("document_id", "full_text", "page_count", "char_count", "has_text", F.array_join(F.col("empty_pages").cast("array<string>"), ",").alias("empty_pages"))


def page_for_char(spark, d):
    tidy = pg.offsets(_lines(spark, d))
    wanted = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit(0), F.floor(F.col("n_chars") / 2).cast("int"), (F.col("n_chars") + 5).cast("int"))).alias("position")).distinct()
    return pg.locate(wanted, tidy).select("document_id", "position", "page_number")


def page_filter(spark, d):
    tidy = pg.offsets(_lines(spark, d))
    docs = _docs(spark, d).select("doc_id", "text").join(pg.page_array(tidy).withColumnRenamed("document_id", "doc_id"), "doc_id")
    chunks = chunking.fixed(docs, size=SIZE, overlap=OVERLAP, pages="pages")
    return stats.page_filter(chunks, 2).select("doc_id", "chunk_index", tx.preview(F.col("text")).alias("preview"))


def title_from_filename(spark, d):
    return table(spark, d, "pages").select("page_id", tx.title_from_path(F.col("url")).alias("title"))


def highlight_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.highlight(F.col("text"), ["the", "that", "tion"]).alias("marked"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def _shown(df):
    return df.select("chunk_id", "document_id", "score", "rank")


def vector_topk(spark, d):
    return _shown(vectors.topk(_vectors(spark, d), _query(spark, d), 20))


def vector_topk_scoped(spark, d):
    return _shown(vectors.topk(vectors.scope(_vectors(spark, d), document=3), _query(spark, d), 5))


def vector_topk_multi(spark, d):
    return _shown(vectors.topk(vectors.scope(_vectors(spark, d), document_ids=[1, 2, 5]), _query(spark, d), vectors.clamp_k(None)))


def vector_topk_batch(spark, d):
    return _candidates(spark, d).select("query_id", "chunk_id", "score", "rank")


def hydrate_hits(spark, d):
    hits = vectors.topk(_vectors(spark, d), _query(spark, d), 50).drop("embedding", "document_id")
    chunks = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return vectors.hydrate(hits, chunks).select("chunk_id", "score", "quality")


def collection_name(spark, d):
    docs = _docs(spark, d)
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return docs.select("doc_id", vectors.collection_name(name, F.col("source")).alias("per_document"), vectors.collection_name(name, F.col("lang"), "per_user").alias("per_user"), vectors.collection_name(name, F.col("lang"), "global").alias("all_in_one"))


def upsert_latest(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return vectors.latest(events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def upsert_vectors(spark, d):
    v = _vectors(spark, d).select("chunk_id", "document_id")
    changes = v.filter("document_id = 1").select("chunk_id", F.lit(99).alias("document_id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("chunk_id"), F.lit(99).alias("document_id")))
    return vectors.upsert(v, changes)


def delete_document(spark, d):
    return vectors.delete_document(_vectors(spark, d), 4)[0].select("chunk_id", "document_id")


def delete_cascade(spark, d):
    v = _vectors(spark, d).select("chunk_id", "document_id")
    docs = v.select(F.col("document_id").alias("id")).distinct()
    left = ingest.delete_documents(docs.filter("id < 3"), docs, v, v)
    names = ("documents", "chunks", "vectors")
    out = left[0].agg(F.lit(names[0]).alias("name"), F.count(F.lit(1)).alias("n"))
    for name, x in zip(names[1:], left[1:]):
        out = out.unionByName(x.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")))
    return out


def replace_document_chunks(spark, d):
    chunks = chunking.fixed(_docs(spark, d).select(F.col("doc_id").alias("document_id"), "text"), size=SIZE, overlap=OVERLAP).select("document_id", "chunk_index", "token_count")
    stored = chunks.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index")))
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    fresh = chunks.join(toxic, "document_id", "left_semi").filter("chunk_index = 0").withColumn("token_count", F.lit(1))
    return replace_chunks(stored, fresh).select("document_id", "chunk_index", "token_count", "chunk_id")


def _indexed(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("ready").alias("status"))
    labels = table(spark, d, "labels")
    chunks = labels.select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("is_embedded"))
    return docs, chunks, labels.filter("quality = 1").select(F.col("doc_id").alias("document_id"))


def index_completeness(spark, d):
    return vectors.completeness(*_indexed(spark, d))


def unembedded_docs(spark, d):
    docs, chunks, _ = _indexed(spark, d)
    return vectors.unembedded(docs, chunks)


def mark_embedded(spark, d):
    labels = table(spark, d, "labels")
    chunks = labels.select(F.col("doc_id").alias("chunk_id"), F.lit(False).alias("is_embedded"), F.lit(None).cast("timestamp").alias("embedded_at"), F.lit(None).cast("string").alias("embedding_model"))
    done = labels.filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return vectors.mark_embedded(chunks, done, F.timestamp_seconds(F.lit(0))).select("chunk_id", "is_embedded", "embedding_model")


# --- rerank and prompts ----------------------------------------------------------------------------------------------


def rerank_fallback(spark, d):
    return rerank.take(rerank.blended(_candidates(spark, d)), 5).select("query_id", "chunk_id", "rerank_score", "n")


def rerank_minmax(spark, d):
    raw = _candidates(spark, d).withColumn("raw", (F.col("chunk_id") % 7).cast("double"))
    return rerank.take(rerank.minmax(raw), 5).select("query_id", "chunk_id", "rerank_score", "n")


def rerank_listwise(spark, d):
    raw = _candidates(spark, d).withColumn("raw", F.lit("Scores: 3, 9.5, 12, 0.25; 7"))
    return rerank.rerank(raw, 5, listwise="raw").select("query_id", "chunk_id", "rerank_score", "n")


def parse_listwise_scores(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(rerank.parse_scores(F.col("props"), F.lit(4)), lambda x: F.format_string("%.4f", x)), ",").alias("scores"))


def _ranked_docs(spark, d):
    w_rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _docs(spark, d).select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", w_rank.alias("n"))


def context_budget(spark, d):
    return prompt.budget(_ranked_docs(spark, d)).select("query_id", "n", F.length("shown").alias("shown_chars"), F.substring("shown", -40, 40).alias("ends"))


def context_block(spark, d):
    rows = _ranked_docs(spark, d).withColumn("header", prompt.header(F.col("n"), F.concat(F.lit("Doc "), F.col("chunk_id").cast("string")), F.col("n"), F.col("n") + F.col("n") % 2, F.lit(1.0) / F.col("n")))
    return prompt.context_block(rows).select("query_id", "context")


def citation_labels(spark, d):
    n = F.col("doc_id") % 5 + 1
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", prompt.header(n, title, n, n + F.col("doc_id") % 2, F.col("n_chars") / 40000.0).alias("header"), prompt.source_label(title, n, n + F.col("doc_id") % 2).alias("label"))


def _answers(spark, d):
    n = F.col("turn")
    text = F.concat(F.col("text"), F.lit(" [Source "), (n % 3 + 1).cast("string"), F.lit("] and [Source  2], [Source\n"), (n % 7).cast("string"), F.lit("] [Source "), (n % 3 + 1).cast("string"), F.lit("] [Source x]"))
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.alias("answer"))


def extract_citations(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.array_join(prompt.citations(F.col("answer")), "|").alias("citations"))


def uncited(spark, d):
    answers = _answers(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "answer")
    ranked = answers.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    return prompt.cited(ranked, answers).filter("not was_cited").select("query_id", "n")


def retrieval_scores_record(spark, d):
    candidates = _candidates(spark, d).withColumnRenamed("score", "retrieval_score")
    ranked = rerank.take(rerank.blended(candidates, score="retrieval_score"), 5).withColumn("was_cited", F.col("n") <= 2)
    return prompt.retrieval_scores(candidates, ranked).select("query_id", "chunk_id", "retrieval_score", "rerank_score", "citation_n", "was_cited")


def history_last_n(spark, d):
    turns = prompt.history(_messages(spark, d), 2)
    return turns.select("session_id", F.posexplode("turns").alias("pos", "t")).select("session_id", "pos", "t.role", F.element_at("t.parts", 1)["text"].alias("text"))


def history_block(spark, d):
    return prompt.history_block(_messages(spark, d))


def prompt_build(spark, d):
    asked = _messages(spark, d).groupBy("session_id").agg(F.max_by("content", "created_at").alias("question")).join(prompt.history_block(_messages(spark, d)), "session_id")
    text = prompt.user_prompt(F.lit(None).cast("string"), F.col("question"), F.col("history"))
    return asked.select("session_id", text.alias("prompt"), F.floor(F.length(text) / 4).alias("token_estimate"))


# --- sessions, documents, ingestion ----------------------------------------------------------------------------------


def _sessions(spark, d):
    m = _messages(spark, d)
    return m.groupBy("session_id").agg(F.max("created_at").alias("updated_at")).select(F.col("session_id").alias("id"), "updated_at", F.when(F.col("session_id") % 4 != 0, F.concat(F.lit("Chat "), F.col("session_id").cast("string"))).otherwise("").alias("title"), (F.col("session_id") % 3 != 0).alias("is_active"))


def session_list(spark, d):
    return stats.session_list(_sessions(spark, d), _messages(spark, d)).select("id", "title", "updated_at", "message_count")


def session_detail(spark, d):
    m = _messages(spark, d).withColumns({"id": F.concat_ws("-", "session_id", "created_at"), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(2), "total_tokens": F.lit(3)})
    chunks = _lines(spark, d).select(F.concat_ws("-", "document_id", "page_number").alias("chunk_id"), "document_id", "text", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.col("page_number").alias("chunk_index"))
    bridge = m.filter("role = 'assistant'").select(F.col("id").alias("message_id"), F.concat(F.col("session_id").cast("string"), F.lit("-1")).alias("chunk_id"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    return stats.session_detail(m, bridge, chunks, docs, 2).select("id", "role", F.size("sources").alias("n_sources"), F.element_at("sources", 1)["title"].alias("title"), F.col("tokens.total_tokens").alias("total_tokens"))


def session_soft_delete(spark, d):
    return ingest.deactivate(_sessions(spark, d), 1).select("id", "is_active")


def document_stats(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "source")
    chunks = _fixed(spark, d).filter("token_count > 150").withColumnRenamed("doc_id", "document_id")
    return stats.document_stats(docs, chunks).drop("source")


def _documents(spark, d):
    """Documents as the service has them."""
    status = F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("ready")
    return _docs(spark, d).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.floor(F.col("n_chars") / 1024).alias("file_size_kb"), F.lit(1).alias("page_count"), (F.col("doc_id") % 7).alias("chunk_count"),
        status.alias("status"), F.lit("fixed").alias("chunk_strategy"), F.col("doc_id").alias("created_at"), F.lit(None).cast("long").alias("processed_at"), "source",
    )


def document_list(spark, d):
    return api.document_list(_documents(spark, d)).join(_docs(spark, d).select(F.col("doc_id").alias("id"), "source"), "id").select("id", "file_size_kb", "source").orderBy(F.desc("id"))


def document_page(spark, d):
    return api.document_list(_documents(spark, d)).drop("processed_at")


def document_detail(spark, d):
    chunks = _fixed(spark, d).withColumnRenamed("doc_id", "document_id")
    return stats.first_chunks(chunks).select("document_id", "chunk_index", "token_count")


def document_detail_page(spark, d):
    chunks = _fixed(spark, d).select(F.col("doc_id").alias("document_id"), "chunk_index", "token_count", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(False).alias("is_embedded"))
    out = api.document_detail(_documents(spark, d), chunks, 7)
    return out.select("id", "title", "status", F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c.chunk_index.cast("string"), c.token_count.cast("string"))), ",").alias("chunks"))


def search_stats(spark, d):
    _, chunks, v = _indexed(spark, d)
    return api.search_stats(_documents(spark, d), chunks, v).select("document_id", "title", "chunk_count", "embedded_chunks", "vector_count", "fully_indexed")


def search_rows(spark, d):
    v = _vectors(spark, d).withColumns({"text": F.concat(F.lit("text of "), F.repeat(F.col("chunk_id").cast("string"), 60)), "page_start": F.col("chunk_id") % 9, "page_end": F.col("chunk_id") % 9 + F.col("chunk_id") % 2, "doc_title": F.concat(F.lit("T"), F.col("document_id").cast("string"))})
    return api.search_rows(vectors.topk(v, _query(spark, d), 20)).select("chunk_id", "rank", "preview", "page_label", "source_label")


def debug_documents(spark, d):
    chunks = _fixed(spark, d).withColumnRenamed("doc_id", "document_id")
    return api.debug_documents(_docs(spark, d).select(F.col("doc_id").alias("id")), chunks)


def debug_chunk_stats(spark, d):
    chunks = _fixed(spark, d).select(F.col("doc_id").alias("document_id"), "chunk_index", "text", "token_count", (F.col("chunk_index") + 1).alias("page_start"), (F.col("chunk_index") + 2).alias("page_end"))
    shown, numbers = api.debug_chunks(chunks, 3, "2")
    return shown.select("chunk_index", "preview").crossJoin(numbers.select("min_tokens", "max_tokens", "n_chunks"))


def title_accents(spark, d):
    return table(spark, d, "pages").select("page_id", tx.title_from_path(F.translate("url", "aeou", "áéöü")).alias("title"))


def chunk_own_sizes(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 3 * 32 + 64).cast("int").alias("chunk_size"), (F.col("doc_id") % 4 * 20).cast("int").alias("chunk_overlap"))
    return chunking.fixed(docs, size=F.col("chunk_size"), overlap=F.col("chunk_overlap"), offsets=False).select("doc_id", "chunk_index", "text", "token_count")


def vector_topk_copies(spark, d):
    v = _vectors(spark, d)
    copies = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("i") * 1_000_000 + F.col("chunk_id")).cast("long").alias("chunk_id"), "embedding", "document_id")
    first = v.groupBy("document_id").agg(F.min_by("embedding", "chunk_id").alias("query")).select(F.col("document_id").alias("query_id"), "query")
    return vectors.batch_topk(copies, first, 20)


def upsert_versions(spark, d):
    changes = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), "ts")
    stored = spark.range(0, 400).select(F.col("id").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("old").alias("kind"))
    return vectors.upsert(stored, changes, "user_id", "ts")


def hydrate_with_documents(spark, d):
    hits = vectors.topk(_vectors(spark, d), _query(spark, d), 50).drop("embedding", "document_id")
    chunks = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("document_id"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("document_id"), "source")
    return vectors.hydrate(hits, chunks, docs).select("chunk_id", "document_id", "source", "score")


def rerank_pairs(spark, d):
    """A pair model in place: the share of a passage's characters that its question has."""
    rows = _candidates(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").withColumn("question", F.lit("the"))
    return rerank.rerank(rows, 5, pair_model=lambda q, t: (F.length(t) - F.length(F.replace(t, q, F.lit("")))).cast("double")).select("query_id", "chunk_id", "rerank_score", "n")


def _said(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.concat(F.lit("s"), (F.col("item_id") % 7).cast("string")).alias("session_id"), F.col("text").alias("question"), F.concat(F.lit("On "), F.col("text")).alias("answer"), F.array(F.col("item_id").cast("string"), F.lit("x")).alias("cited_chunks"), (F.col("item_id") * 3).cast("int").alias("prompt_tokens"), F.lit(True).alias("was_streamed"), "item_id")


def _appended(spark, d):
    return append_turns(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], MESSAGE_CHUNKS), _said(spark, d), F.timestamp_seconds(F.col("item_id")))


def chat_messages(spark, d):
    return _appended(spark, d)[0].select("id", "session_id", "role", "content", "prompt_tokens", "was_streamed", F.unix_micros("created_at").alias("created_at"))


def chat_links(spark, d):
    return _appended(spark, d)[1]


def stream_lines(spark, d):
    rows = _said(spark, d)
    error = F.when(F.col("item_id") % 5 == 0, F.lit("model gone"))
    lines = events(F.split("question", " "), F.struct("prompt_tokens"), error)
    return rows.select("item_id", F.posexplode(lines).alias("seq", "line"))


def session_open(spark, d):
    known = _sessions(spark, d).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), (F.col("id") % 2).alias("user_id"), "title", "is_active")
    wanted = spark.range(0, 30).select(F.concat(F.lit("c"), (F.col("id") * 7).cast("string")).alias("id"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("user_id"), F.array(F.lit("d1"), F.lit("d2")).alias("documents"))
    rows, links = ingest.open_sessions(known, spark.createDataFrame([], SESSION_DOCUMENTS), wanted, F.timestamp_seconds(F.lit(0)))
    return rows.join(links.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_links")), "id", "left").select("id", "user_id", "title", "is_active", "n_links")


def session_documents(spark, d):
    links = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 3 + F.col("turn") % 2).alias("document_id")).distinct()
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    out = stats.session_list(_sessions(spark, d), _messages(spark, d), links, docs)
    return out.select("id", "title", "message_count", F.array_join(F.transform("documents", lambda x: F.concat_ws(":", x["id"].cast("string"), x["title"])), ",").alias("documents"))


def prompt_with_context(spark, d):
    text = prompt.user_prompt(F.col("context"), F.concat(F.lit("What does "), F.col("query_id"), F.lit(" hold?")), F.lit(None).cast("string"))
    return context_block(spark, d).select("query_id", text.alias("prompt"))


def chat_streamed(spark, d):
    """Lines of streamed turns whose candidates are the table's own vectors."""
    from ..operators.embedding import HashEmbedder, embed

    docs = _docs(spark, d)
    v = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("source").alias("doc_title"), embed(F.col("text"), lambda: HashEmbedder(64)).alias("embedding"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("session_id"), F.col("text").alias("question"))
    lines = chat.stream_events(chat.answer(asked, v, embedder=lambda: HashEmbedder(64), streamed=True))
    token = F.when(F.contains("line", F.lit('"type":"token"')), F.struct("seq", F.get_json_object(F.substring("line", 7, 1 << 30), "$.text").alias("t")))
    turns = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(token)).alias("p"), F.max_by("line", "seq").alias("l"), F.max("seq").alias("n_tokens")).filter(F.size("p") > 0)
    return turns.select("query_id", F.array_join(F.transform("p", lambda x: x.t), "").alias("answer"), "n_tokens", F.contains("l", F.lit('"type":"done"')).alias("done"))


def token_bars(spark, d):
    return stats.token_share(_fixed(spark, d).withColumnRenamed("doc_id", "document_id")).select("document_id", "chunk_index", "token_bar")


def cited_documents(spark, d):
    labels = table(spark, d, "labels")
    chunks = labels.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("document_id"))
    bridge = labels.select((F.col("doc_id") % 3).alias("message_id"), F.col("doc_id").alias("chunk_id"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "source")
    return stats.cited_documents(None, bridge, chunks, docs, 1)


def _files(spark, d):
    name = F.concat(F.lit("docs/report_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".PDF").when(F.col("page_id") % 4 == 1, ".txt").otherwise(".pdf"))
    head = F.when(F.col("page_id") % 3 == 0, F.lit("<htm")).otherwise(F.lit("%PDF")).cast("binary")
    return table(spark, d, "pages").select("page_id", name.alias("path"), head.alias("head"), (F.col("page_id") * 200_000).alias("length"))


def upload_validation(spark, d):
    f = _files(spark, d)
    return f.select("page_id", upload_error(F.col("path"), F.col("head"), F.col("length")).alias("error"))


def ingest_decision(spark, d):
    files = _files(spark, d).select("page_id", tx.title_from_path(F.col("path")).alias("title"))
    known = _docs(spark, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("Report "), (F.col("doc_id") % 40 * 3).cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("failed").alias("status"), F.col("n_chars").alias("created_at"))
    return ingest.decide(files, known).select("page_id", "title", "existing_id", "decision")


def ingest_summary(spark, d):
    return ingest.summary(ingest_decision(spark, d))


def status_machine(spark, d):
    e = table(spark, d, "events")
    s = ingest.next_status(F.when(F.col("event_id") % 3 == 0, "ready").otherwise("pending"), F.col("event_id") % 5 != 0, (F.col("event_id") % 4).cast("int"), F.when(F.col("event_id") % 7 == 0, "damaged file"))
    return e.select("event_id", s.alias("s")).select("event_id", "s.status", "s.error_message")


def event_windows(spark, d):
    out = windowed_counts(table(spark, d, "events"))
    return out.select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def chat_turns(spark, d):
    from ..operators.embedding import HashEmbedder, embed

    chunks = chunking.fixed(_docs(spark, d).select(F.col("doc_id").alias("document_id"), "source", "text"), size=SIZE, overlap=OVERLAP, offsets=False)
    v = chunks.select(chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "text", "document_id", "chunk_index", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("source").alias("doc_title"), embed(F.col("text"), lambda: HashEmbedder(64)).alias("embedding"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("session_id"), F.col("text").alias("question"))
    out = chat.answer(asked, v, embedder=lambda: HashEmbedder(64))
    return out.select("query_id", "answer", F.array_join("citations", "|").alias("citations"), F.size("retrieval_scores").alias("n_candidates"), F.size("sources").alias("n_sources"), "prompt_tokens", "total_tokens")


_ALL = (
    chunk_fixed_stats, chunk_fixed, chunk_fixed_offsets, chunk_recursive, chunk_recursive_native, chunk_recursive_exact, sentence_split, semantic_breakpoints, merge_small_groups, semantic_chunks, chunk_by_strategy,
    clean_text, clean_ocr_lines, table_text, text_measures, repeated_lines, strip_repeated_lines, page_offsets, page_offsets_exact, page_assembly, page_for_char, page_filter, title_from_filename, highlight_terms,
    vector_topk, vector_topk_scoped, vector_topk_multi, vector_topk_batch, hydrate_hits, collection_name, upsert_latest, upsert_vectors, delete_document, delete_cascade, replace_document_chunks, index_completeness, unembedded_docs, mark_embedded,
    rerank_fallback, rerank_minmax, rerank_listwise, parse_listwise_scores, context_budget, context_block, citation_labels, extract_citations, uncited, retrieval_scores_record, history_last_n, history_block, prompt_build,
    document_page, document_detail_page, search_stats, search_rows, debug_documents, debug_chunk_stats, title_accents, chunk_own_sizes, vector_topk_copies, upsert_versions, hydrate_with_documents, rerank_pairs,
    chat_messages, chat_links, stream_lines, session_open, session_documents, prompt_with_context, chat_streamed,
    session_list, session_detail, session_soft_delete, document_stats, document_list, document_detail, token_bars, cited_documents, upload_validation, ingest_decision, ingest_summary, status_machine, event_windows, chat_turns,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
