"""Endpoints and jobs over small tables."""

import pytest
from pyspark.sql import functions as F

from strataq.operators import chunking, ingest, pages
from strataq.plans import api, catalog, jobs
from strataq.schema import CHUNKS, DOCUMENTS, VECTORS, duplicate_keys, violations

from .test_retrieval_and_ingest import make_pdf


def test_ingest_index_search(spark, tmp_path):
    land, root = tmp_path / "in", str(tmp_path / "root")
    land.mkdir()
    fox = ["The red fox runs through the quiet wood at night."] * 3
    tea = ["Green tea is best when it is drunk warm and slowly."] * 3
    (land / "fox_report.pdf").write_bytes(make_pdf([fox, fox]))
    (land / "tea-notes.pdf").write_bytes(make_pdf([tea]))
    assert {r.decision: r.n for r in jobs.run_ingest(spark, str(land), root, dry_run=True).collect()} == {"create": 2}
    jobs.run_ingest(spark, str(land), root)
    documents, chunks = jobs.stored(spark, root, "documents", DOCUMENTS), jobs.stored(spark, root, "chunks", CHUNKS)
    assert {(r.title, r.status) for r in documents.collect()} == {("Fox Report", "ready"), ("Tea Notes", "ready")}
    assert violations(documents).count() == 0 and duplicate_keys(chunks, "document_id", "chunk_index").count() == 0
    assert {r.decision: r.n for r in jobs.run_ingest(spark, str(land), root).collect()} == {"skip": 2}
    n = jobs.stored(spark, root, "chunks", CHUNKS).count()  # a job replaces files, so tables are read anew after it
    assert n >= 2 and jobs.run_index(spark, root) == n and jobs.run_index(spark, root) == 0
    documents, v, chunks = jobs.stored(spark, root, "documents", DOCUMENTS), jobs.stored(spark, root, "vectors", VECTORS), jobs.stored(spark, root, "chunks", CHUNKS)
    top = api.search(v, "red fox wood", 1).first()
    assert top.doc_title == "Fox Report" and top.source_label.startswith("Fox Report · p.1") and top["rank"] == 1
    with pytest.raises(ValueError):
        api.search(v, "  ")
    assert {r.fully_indexed for r in api.search_stats(documents, chunks, v).collect()} == {True}
    one = documents.filter("title = 'Tea Notes'").first().id
    assert len(api.document_detail(documents, chunks, one).first().chunks) >= 1 and api.document_list(documents).count() == 2
    shown, numbers = api.debug_chunks(chunks, one, "1")
    assert shown.count() == numbers.first().n_chunks >= 1 and api.debug_chunks(chunks, one, "9")[1].first().max_tokens == 0
    left = api.delete_document(documents, chunks, v, one)
    assert [x.count() for x in left[:1]] == [1] and left[2].filter(F.col("document_id") == one).count() == 0
    again = api.index_document(documents, chunks, left[2], one)
    assert again.count() == v.count()
    with pytest.raises(ValueError):
        api.index_document(documents.withColumn("status", F.lit("failed")), chunks, v, one)
    q = spark.createDataFrame([(1, "s", "green tea")], "query_id int, session_id string, question string")
    assert api.chat(q, v, k=99).first().sources[0].doc_title == "Tea Notes"


def test_document_list_query_has_all_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "source").collect()
    got = [(r.id, r.file_size_kb, r.source) for r in catalog.document_list(spark, d).collect()]
    assert len(got) > 50 and got == sorted(((r.doc_id, r.n_chars // 1024, r.source) for r in docs), reverse=True)


def test_rechunk_takes_the_documents_own_size_and_overlap(spark):
    words = [f"w{k}" + (";" if k % 9 == 0 else "") for k in range(900)]
    text = " ".join(words)
    docs = [(k, strategy, size, overlap) for k, strategy, size, overlap in (("a", "fixed", 512, 64), ("b", "recursive", 100, 10), ("c", "recursive", None, None))]
    rows = [{"id": k, "title": k, "chunk_strategy": s, "chunk_size": n, "chunk_overlap": o, "status": "pending"} for k, s, n, o in docs]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    page_rows = spark.createDataFrame([(k, 1, text) for k in "abc"], "document_id string, page_number int, text string")
    full = pages.assemble(pages.offsets(pages.strip_repeated(page_rows), skip_blank=True)).select("document_id", F.col("full_text").alias("text"))

    def alone(how, k, size, overlap):
        made = chunking.long_enough(how(full.filter(F.col("document_id") == k), "text", size, overlap))
        return sorted((r.chunk_index, r.text, r.char_start, r.char_end) for r in made.collect())

    def of(chunks, k):
        return sorted((r.chunk_index, r.text, r.char_start, r.char_end) for r in chunks.filter(F.col("document_id") == k).collect())

    done, chunks = (spark.createDataFrame(x.collect(), x.schema) for x in ingest.run_pipeline(documents, page_rows, F.current_timestamp()))
    assert of(chunks, "a") == alone(chunking.fixed, "a", 512, 64) and of(chunks, "b") == alone(chunking.recursive, "b", 100, 10) and of(chunks, "c") == alone(chunking.recursive, "c", 512, 64)
    for k, how, size, overlap in (("a", chunking.fixed, 40, 15), ("b", chunking.recursive, 60, 5)):
        after, fresh = (spark.createDataFrame(x.collect(), x.schema) for x in api.rechunk(done, page_rows, chunks, k, F.current_timestamp(), size=size, overlap=overlap))
        want = alone(how, k, size, overlap)
        assert len(want) > 10 and of(fresh, k) == want and of(fresh, "c") == of(chunks, "c")
        assert {(r.chunk_size, r.chunk_overlap, r.chunk_count) for r in after.filter(F.col("id") == k).collect()} == {(size, overlap, len(want))}


def test_streamed_turns_keep_pieces_and_errors(spark):
    from strataq.operators import chat
    from strataq.operators.embedding import embed

    def pieces(system, prompt):
        yield "See "
        yield "[Source 1]"
        if "tea" in prompt.rsplit("## QUESTION", 1)[1]:
            raise RuntimeError("model gone")

    v = spark.createDataFrame([("c1", "red fox"), ("c2", "green tea")], "chunk_id string, text string").select("chunk_id", "text", F.lit("d").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("T").alias("doc_title"), embed(F.col("text")).alias("embedding"))
    q = spark.createDataFrame([(1, "s", "red fox"), (2, "s", "green tea")], "query_id int, session_id string, question string")
    done = chat.answer(q, v, make=lambda: pieces, streamed=True)
    rows = {r.query_id: r for r in done.collect()}
    assert rows[1].pieces == ["See ", "[Source 1]"] and rows[1].answer == "See [Source 1]" and rows[1].error is None and rows[1].was_streamed
    assert rows[2].pieces == ["See ", "[Source 1]"] and rows[2].error == "model gone"
    lines = {}
    for r in chat.stream_events(done).orderBy("query_id", "seq").collect():
        lines.setdefault(r.query_id, []).append(r.line)
    assert [len(x) for x in lines.values()] == [3, 3] and '"type":"done"' in lines[1][2] and lines[2][2] == 'data: {"type":"error","text":"model gone"}'
    assert not any(r.was_streamed for r in chat.answer(q, v).collect())


def test_tables_survive_a_write_that_ended_between(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("a",)], "session_id string")
    jobs.write(one, root, "t")
    (tmp_path / "t").rename(tmp_path / "t__old")  # the moment between the two renames
    schema = one.schema
    assert jobs.stored(spark, root, "t", schema).count() == 1
    jobs.write(jobs.stored(spark, root, "t", schema).unionByName(one), root, "u")
    assert jobs.stored(spark, root, "u", schema).count() == 2 and jobs.stored(spark, root, "none", schema).count() == 0
