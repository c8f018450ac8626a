"""A corpus pipeline of five stages: language ID, toxicity, near duplicates, source mixing, SentencePiece.

Each stage takes all documents that the stage before kept; ``run`` writes each one's result to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import jaccard_join, language_id, sentencepiece_codec, shared, source_mix, toxicity
from strataq.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose predicted language is less sure than this go, as do texts in which none is found.
SURE = 0.5
#: Near duplicates: words of a shingle, and the percentage of shingles in common.
SHINGLE, PERCENT = 5, 80
#: Share of the tokens that mixing keeps.
FRACTION = 0.6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents with a language; texts without letters (or null) and unsure ones go. Null ids and languages,
    repeated rows and texts of any length are kept or go by their text alone; without a language to learn from, or without
    rows, none stay."""
    found = language_id.predict_language(docs, docs.filter(~language_id.held_out(F.col("doc_id"))))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null and empty texts have the score of texts without hits, rows without an id are scored but
    never learnt from; without toxic or without clean labels all get the share of toxic ones; no rows give no rows."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; rows without an id are documents of their own, and so are rows
    that repeat an id with another text, each held against the others by its own text (a 64-bit hash of id and text names
    it); rows that repeat both are one. Null and empty texts are near nothing; no rows give no rows."""
    own = docs.select(*COLUMNS).withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    named = own.filter("__key is not null")
    groups = jaccard_join.jaccard_components(named, "__key", n=SHINGLE, percent=PERCENT)
    parts = groups.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("part"))
    keyed, _ = shared.store(named.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).join(parts, "__key"))
    first = keyed.groupBy("part").agg(F.min(F.struct("doc_id", "__key"))["__key"].alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = shared.attach(keyed, first, ["part"], "many", shared.hot_bound(keyed.count()))
    marks, _ = shared.store(met.select("__key", "n", F.coalesce(F.col("first") != F.col("__key"), F.lit(False)).alias("copy")).filter("copy or n > 1"))
    marked = shared.attach(named, marks, ["__key"], "n", shared.hot_bound(keyed.agg(F.sum("n")).first()[0] or 0))
    repeated = marked.filter("not copy").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return own.filter("__key is null").select(*COLUMNS).unionByName(marked.filter("copy is null").select(*COLUMNS)).unionByName(repeated)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics. Null sources and languages are one value, ''; null and
    empty texts weigh one token; repeated rows share their fate; no rows give no rows."""
    return source_mix.mix(docs, FRACTION).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with an end id; null and empty texts have the end id alone, other columns may be null."""
    done = sentencepiece_codec.encode_text(docs, vocabulary("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the learned stages nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage hands on is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = shared.store(docs)
    return docs
