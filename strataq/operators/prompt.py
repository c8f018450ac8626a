"""Prompts: source labels, token-budgeted context, history, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx

#: Frames and notes of the context block.
RULE = "─" * 50
CUT_NOTE = "\n[... truncated for length ...]"
NO_CONTEXT = "No relevant context passages found."
CITATION = r"\[Source\s+\d+\]"

SYSTEM = "Answer from the numbered passages alone. Cite the passage after each claim as [Source N]. Say so where the passages don't hold the answer."
STEPS = "First name the passages that bear on the question, then put together what they say, then answer with citations."


def label(n: Column) -> Column:
    return F.concat(F.lit("[Source "), n.cast("string"), F.lit("]"))


def two_places(c: Column) -> Column:
    """A number with two decimals, rounded as its binary value has it (format_string rounds its shortest decimal form up). The
    distance to the nearest tie is exact: the number is split in halves whose products don't round."""
    high = c * 134217729.0 - (c * 134217729.0 - c)
    k = F.floor(c * 100)
    off = (high * 200 - (2 * k + 1)) + (c - high) * 200
    up = (off > 0) | ((off == 0) & (k % 2 != 0))
    return F.format_string("%.2f", (k + F.when(up, 1).otherwise(0)) / 100.0)


def header(n: Column, title: Column, start: Column, end: Column, score: Column) -> Column:
    """``[Source n] title - page (relevance: 0.00)``."""
    return F.concat(label(n), F.lit(" "), title, F.lit(" - "), tx.page_label(start, end), F.lit(" (relevance: "), two_places(score), F.lit(")"))


def source_label(title: Column, start: Column, end: Column) -> Column:
    """The search page's form, with an en dash."""
    return F.concat(title, F.lit(" · "), tx.page_label(start, end, "–"))


def budget(rows: DataFrame, query: str = "query_id", rank: str = "n", text: str = "text", most: int = config.CONTEXT_TOKENS) -> DataFrame:
    """The rows that fit a query's token budget, with ``shown``."""
    return shown(rows, query, rank, text, most).filter("shown is not null")


def shown(rows: DataFrame, query: str = "query_id", rank: str = "n", text: str = "text", most: int = config.CONTEXT_TOKENS) -> DataFrame:
    """``rows`` with ``shown``, what fits a query's token budget: whole texts up to the first that doesn't fit, which is cut if
    at least 200 characters of it fit; then null. A text costs a token to four characters and 20 more."""
    w = Window.partitionBy(query)
    cost = F.floor(F.length(text) / 4) + config.BLOCK_TOKENS
    used = F.coalesce(F.sum("__cost").over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__cost", cost).withColumn("__used", used)
    first = F.min(F.when(F.col("__used") + F.col("__cost") > most, F.col(rank))).over(w)
    rows = rows.withColumn("__first", first)
    left = ((most - F.col("__used")) * 4 - 80).cast("int")
    whole = F.col("__first").isNull() | (F.col(rank) < F.col("__first"))
    cut = (F.col(rank) == F.col("__first")) & (left >= config.LEAST_CUT_CHARS)
    shown = F.when(whole, F.col(text)).when(cut, F.concat(F.substring(F.col(text), F.lit(1), left), F.lit(CUT_NOTE)))
    return rows.withColumn("shown", shown).drop("__cost", "__used", "__first")


def passage() -> Column:
    """A framed passage of ``header`` and ``shown``."""
    return F.concat(F.lit(RULE + "\n"), F.col("header"), F.lit("\n" + RULE + "\n"), F.col("shown"))


def context_block(rows: DataFrame, query: str = "query_id", rank: str = "n", text: str = "text", most: int = config.CONTEXT_TOKENS) -> DataFrame:
    """(query, context): framed passages, with a blank line between. Needs ``header``."""
    fit = budget(rows, query, rank, text, most)
    lists = fit.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("n"), passage().alias("b")))).alias("l"))
    return lists.select(query, F.array_join(F.transform("l", lambda x: x.b), "\n\n").alias("context"))


def last_turns(messages: DataFrame, n: int, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def history(messages: DataFrame, turns: int = 10, session: str = "session_id", order: str = "created_at", role: str = "role", content: str = "content") -> DataFrame:
    """(session, turns): an array of role (user, else model) and parts, oldest first."""
    recent = last_turns(messages, turns * 2, session, order)
    one = F.struct(F.col(order).alias("o"), F.when(F.col(role) == "user", "user").otherwise("model").alias("role"), F.array(F.struct(F.col(content).alias("text"))).alias("parts"))
    lists = recent.groupBy(session).agg(F.sort_array(F.collect_list(one)).alias("l"))
    return lists.select(session, F.transform("l", lambda x: F.struct(x.role.alias("role"), x.parts.alias("parts"))).alias("turns"))


def history_block(messages: DataFrame, session: str = "session_id", order: str = "created_at", role: str = "role", content: str = "content") -> DataFrame:
    """(session, history): the last 12 messages, 400 characters each, below a heading."""
    recent = last_turns(messages, config.HISTORY_TURNS * 2, session, order)
    line = F.concat(F.when(F.col(role) == "user", "User").otherwise("Assistant"), F.lit(": "), tx.preview(F.col(content), config.HISTORY_CHARS))
    lists = recent.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("l"))
    return lists.select(session, F.concat(F.lit("## CONVERSATION HISTORY\n"), F.array_join(F.transform("l", lambda x: x.x), "\n")).alias("history"))


def user_prompt(context: Column, question: Column, history: Column, steps: str = STEPS) -> Column:
    """The parts of a prompt with blank lines between; empty parts go."""
    parts = [F.lit("## CONTEXT PASSAGES"), F.coalesce(F.nullif(context, F.lit("")), F.lit(NO_CONTEXT)), F.lit("## INSTRUCTIONS"), F.lit(steps), F.nullif(history, F.lit("")), F.concat(F.lit("## QUESTION\n"), question), F.lit("## YOUR ANSWER")]
    return F.concat_ws("\n\n", *parts)


def system_prompt(extra: str = "", system: str = SYSTEM) -> str:
    return system + (f"\n\nADDITIONAL INSTRUCTIONS:\n{extra}" if extra else "")


def citations(answer: Column) -> Column:
    """Labels that an answer cites, each once, in the order of their first use, with single spaces."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"\s+", " "))), F.array().cast("array<string>"))


def cited(ranked: DataFrame, answers: DataFrame, query: str = "query_id", answer: str = "answer") -> DataFrame:
    """``ranked`` with ``was_cited``; labels of no passage are dropped."""
    labels = answers.select(query, citations(F.col(answer)).alias("__c"))
    joined = ranked.join(labels, query, "left")
    return joined.withColumn("was_cited", F.coalesce(F.array_contains("__c", label(F.col("n"))), F.lit(False))).drop("__c")


def retrieval_scores(candidates: DataFrame, ranked: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Every candidate with the re-rank score, label and citation of those that were ranked; defaults for the others."""
    r = ranked.select(query, key, "rerank_score", F.col("n").alias("citation_n"), "was_cited")
    joined = candidates.join(r, [query, key], "left")
    return joined.withColumns({"rerank_score": F.round(F.coalesce("rerank_score", F.lit(0.0)), 4), "was_cited": F.coalesce("was_cited", F.lit(False))})
