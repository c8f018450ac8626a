"""Chat turns for a batch of questions: retrieve, re-rank, build prompts, generate, cite, record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..sources.sinks import events
from . import prompt as pr
from . import rerank as rr
from .embedding import HashEmbedder, embed
from .vectors import batch_topk

#: A generator: (system, prompt) -> answer, whole or in pieces. The default cites the first passage, so that a turn runs offline.
Generator = Callable[[str, str], str | Iterable[str]]
#: Hits up to this number are sent to where the chunks are; more are joined by a shuffle.
BROADCAST_HITS = 1 << 20
NO_ANSWER = "The indexed documents hold nothing that bears on this question."


def echo(system: str, prompt: str) -> str:
    question = prompt.rsplit("## QUESTION\n", 1)[-1].split("\n\n## YOUR ANSWER")[0]
    return f"On the question '{question}', see [Source 1]." if "[Source 1]" in prompt else NO_ANSWER


def generate(prompt: Column, make: Callable[[], Generator] = lambda: echo, system: str = pr.SYSTEM) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = make()
        for batch in batches:
            yield pa.array([None if p is None else "".join(answer(system, p)) for p in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(prompt)


def stream_tokens(answer: str) -> Iterator[str]:
    """An answer in pieces of a word and the space after it."""
    import re

    yield from re.findall(r"\S+\s*", answer)


def generate_pieces(prompt: Column, make: Callable[[], Generator] = lambda: echo, system: str = pr.SYSTEM) -> Column:
    """Struct of the pieces that a generator gave, and of its error (null where it came to its end). An answer given whole is cut
    into words; pieces before an error are kept."""
    kind = pa.struct([("pieces", pa.list_(pa.string())), ("error", pa.string())])

    def one(answer: Generator, text: str) -> dict:
        pieces: list[str] = []
        try:
            given = answer(system, text)
            pieces.extend(stream_tokens(given) if isinstance(given, str) else ())
            for piece in () if isinstance(given, str) else given:
                pieces.append(piece)
        except Exception as e:  # noqa: BLE001  any failure of a model is that turn's error
            return {"pieces": pieces, "error": str(e)[:500]}
        return {"pieces": pieces, "error": None}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = make()
        for batch in batches:
            yield pa.array([None if p is None else one(answer, p) for p in batch.to_pylist()], kind)

    return F.arrow_udf(run, "struct<pieces:array<string>,error:string>")(prompt)


def answer(questions: DataFrame, vectors: DataFrame, messages: DataFrame | None = None, k: int = config.RETRIEVE_K, take: int = config.RERANK_K, embedder: Callable = HashEmbedder, make: Callable[[], Generator] = lambda: echo, extra: str = "", streamed: bool = False) -> DataFrame:
    """One row per question (query_id, session_id, question): answer, citations, sources, cited_chunks, retrieval_scores, and
    token estimates. Questions without candidates get a fixed answer. With ``streamed`` the answer is what the generator's
    ``pieces`` give together, a failure is the row's ``error`` (not the job's), and ``was_streamed`` says so."""
    if take < 1 or k < 1:
        raise ValueError("k must be 1 or more")
    asked = questions.withColumn("query", embed(F.col("question"), embedder, "query"))
    hits = batch_topk(vectors, asked.select("query_id", "query"), k)
    if questions.count() * k <= BROADCAST_HITS:
        hits = F.broadcast(hits)  # so that texts stay where they are
    candidates = hits.join(vectors.select("chunk_id", "text", "document_id", "chunk_index", "page_start", "page_end", "doc_title"), "chunk_id")
    # all that follows comes from one row per question: each further use of the candidates would search and embed again
    ranked = pr.shown(rr.rerank(candidates, 2**31 - 1))
    ranked = ranked.withColumn("header", pr.header(F.col("n"), F.col("doc_title"), F.col("page_start"), F.col("page_end"), F.col("rerank_score")))
    passage = F.when((F.col("n") <= take) & F.col("shown").isNotNull(), F.struct("n", pr.passage().alias("b")))
    candidate = F.struct("rank", "chunk_id", "chunk_index", "page_start", "page_end", "doc_title", F.col("score").alias("retrieval_score"), "rerank_score", "n")
    found = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(passage)).alias("__p"), F.sort_array(F.collect_list(candidate)).alias("__c"))
    found = found.select("query_id", F.when(F.size("__p") > 0, F.array_join(F.transform("__p", lambda x: x.b), "\n\n")).alias("context"), "__c")
    rows = questions.join(found, "query_id", "left")
    if messages is not None:
        rows = rows.join(pr.history_block(messages), "session_id", "left")
    else:
        rows = rows.withColumn("history", F.lit(None).cast("string"))
    rows = rows.withColumn("prompt", pr.user_prompt(F.col("context"), F.col("question"), F.col("history")))
    if streamed:
        rows = rows.withColumn("__g", generate_pieces(F.col("prompt"), make, pr.system_prompt(extra)))
        none = F.array(*[F.lit(x) for x in stream_tokens(NO_ANSWER)])
        rows = rows.withColumns({"pieces": F.when(F.col("context").isNull(), none).otherwise(F.col("__g.pieces")), "error": F.when(F.col("context").isNotNull(), F.col("__g.error"))}).drop("__g")
        rows = rows.withColumn("answer", F.array_join("pieces", ""))
    else:
        rows = rows.withColumn("answer", F.when(F.col("context").isNull(), NO_ANSWER).otherwise(generate(F.col("prompt"), make, pr.system_prompt(extra))))
    rows = rows.withColumn("citations", pr.citations(F.col("answer")))

    def cited(c: Column) -> Column:
        return F.coalesce(F.array_contains("citations", pr.label(c.n)), F.lit(False))

    def record(c: Column) -> Column:
        top = c.n <= take
        new = (F.round(F.when(top, c.rerank_score).otherwise(0.0), 4).alias("rerank_score"), F.when(top, c.n).alias("citation_n"), (top & cited(c)).alias("was_cited"))
        return F.struct(*(c[f].alias(f) for f in ("rank", "chunk_id", "chunk_index", "page_start", "doc_title", "retrieval_score")), *new)

    def source(c: Column) -> Column:
        return F.struct(*(c[f].alias(f) for f in ("n", "chunk_id", "doc_title", "page_start", "page_end", "rerank_score")), cited(c).alias("was_cited"))

    out = rows.withColumns({"retrieval_scores": F.transform("__c", record), "sources": F.sort_array(F.transform(F.filter("__c", lambda c: c.n <= take), source))}).drop("__c")
    used = F.transform(F.filter("sources", lambda s: s.was_cited), lambda s: s.chunk_id)
    return out.withColumns({
        "cited_chunks": F.coalesce(used, F.array().cast("array<string>")), "prompt_tokens": F.floor(F.length("prompt") / 4).cast("int"),
        "completion_tokens": F.floor(F.length("answer") / 4).cast("int"), "was_streamed": F.lit(streamed),
    }).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def stream_events(answered: DataFrame) -> DataFrame:
    """(query_id, seq, line): the server-sent lines of streamed answers, in order: tokens, then sources and counts, or the error."""
    done = F.struct("sources", "citations", "prompt_tokens", "completion_tokens", "total_tokens")
    return answered.select("query_id", F.posexplode(events(F.col("pieces"), done, F.col("error"))).alias("seq", "line"))
