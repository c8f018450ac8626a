"""Schemas of the persistent tables and of vector rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import config


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "smallint": T.ShortType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _parts(text: str) -> list[str]:
    """What stands between commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, _, t in (x.partition(":") for x in _parts(text[7:-1]))])
    return _TYPES[text]


def _schema(text: str) -> T.StructType:
    """A schema from ``name type`` pairs, without a session."""
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (x.partition(" ") for x in _parts(text))])


DOCUMENTS = _schema(
    "id string, uploaded_by long, title string, file string, file_type string, file_size_kb int, page_count int, chunk_strategy string, chunk_size int, "
    "chunk_overlap int, status string, error_message string, chunk_count int, created_at timestamp, updated_at timestamp, processed_at timestamp"
)
CHUNKS = _schema(
    "document_id string, text string, token_count int, chunk_index int, page_start int, page_end int, char_start int, char_end int, "
    "chunk_id string, embedding_model string, is_embedded boolean, embedded_at timestamp"
)
SESSIONS = _schema("id string, user_id long, title string, top_k_retrieval smallint, top_k_rerank smallint, llm_model string, is_active boolean, created_at timestamp, updated_at timestamp")
MESSAGES = _schema(
    "id string, session_id string, role string, content string, prompt_tokens int, completion_tokens int, total_tokens int, was_streamed boolean, created_at timestamp, "
    "retrieval_scores array<struct<chunk_id:string,chunk_index:int,page_start:int,doc_title:string,retrieval_score:double,rerank_score:double,citation_n:int,was_cited:boolean>>"
)
SESSION_DOCUMENTS = _schema("session_id string, document_id string")
MESSAGE_CHUNKS = _schema("message_id string, chunk_id string")
PAGES = _schema("document_id string, page_number int, text string, tables array<string>, char_start int, char_end int, word_count int, is_empty boolean, ocr_used boolean")
VECTORS = _schema(
    "chunk_id string, embedding array<float>, norm double, text string, document_id string, chunk_index int, page_start int, page_end int, "
    "char_start int, char_end int, token_count int, doc_title string, user_id string"
)
HISTORY = _schema("turns array<struct<role:string,parts:array<struct<text:string>>>>")


def violations(documents: DataFrame) -> DataFrame:
    """Rows outside the domains of the documents table, with ``problem``."""
    bad = (
        F.when(~F.col("status").isin(*config.STATUSES), "status")
        .when(~F.col("chunk_strategy").isin(*config.STRATEGIES), "chunk_strategy")
        .when((F.col("file_size_kb") < 0) | (F.col("page_count") < 0), "negative")
    )
    return documents.withColumn("problem", bad).filter("problem is not null")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
