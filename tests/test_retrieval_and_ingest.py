"""Vectors, re-ranking, prompts, sessions, ingestion, files and streams."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.operators import chat, ingest, prompt, rerank, vectors
from strataq.operators.embedding import HashEmbedder, embed
from strataq.sources import files, pdf, sinks
from strataq.streaming.ingest import ingest_available, windowed_counts


def test_topk_is_exact_and_stable(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 1), ("c", [-1.0, 0.0], 2), ("z", [0.0, 0.0], 2), ("d", [1.0, 1.0], 3)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, document_id int")
    assert [(r.chunk_id, r.score, r["rank"]) for r in vectors.topk(v, [2.0, 0.0], 9).collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("d", 0.8536, 3), ("z", 0.5, 4), ("c", 0.0, 5)]
    assert "TakeOrderedAndProject" in vectors.topk(v, [2.0, 0.0], 2)._jdf.queryExecution().toString()
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "query_id int, query array<double>")
    batch = vectors.batch_topk(v, q, 2, block=1).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in batch) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d"), (2, 2, "a")]
    assert vectors.scope(v, document=1, document_ids=[2]).count() == 2 and vectors.scope(v, document_ids=[1, 3]).count() == 3
    with pytest.raises(ValueError):
        vectors.clamp_k(-1)
    assert vectors.clamp_k(None) == 20 and vectors.clamp_k(99) == 50


def test_batch_topk_equals_topk_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 9)).astype(np.float32)
    rows = [(k, base[k % 40].tolist()) for k in range(300)] + [(300 + k, base[0].tolist()) for k in range(60)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [None] * 9), (904, [0.0] * 9), (905, [float("nan")] * 9), (906, (base[3] * 2).tolist())]
    rng.shuffle(rows)
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<float>").repartition(4)
    asked = [(k, base[k].astype(float).tolist()) for k in range(12)] + [(50, [0.0] * 9), (51, [1.0, 1.0])]
    q = spark.createDataFrame(asked + [(60, None), (61, [None, 1.0])], "query_id int, query array<double>")
    for k in (1, 3, 50):
        got = {}
        for r in vectors.batch_topk(v, q, k, block=5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score, r["rank"]))
        want = {n: [(r.chunk_id, r.score, r["rank"]) for r in vectors.topk(v, x, k).orderBy("rank").collect()] for n, x in asked}
        assert got == want
    assert [x[0] for x in got[0][:4]] == [0, 40, 80, 120] and got[51] == [(902, 0.9743, 1)]


def test_batch_topk_has_no_cap_on_queries(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(30)], "query_id int, query array<double>")
    want = sorted(map(tuple, vectors.batch_topk(v, q, 3).collect()))
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert sorted(map(tuple, vectors.batch_topk(v, q, 3).collect())) == want and len(want) == 90


def test_upsert_takes_the_last_change(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, document_id int")
    c = spark.createDataFrame([("b", 2, 1), ("b", 9, 0), ("c", 5, 3), ("c", 4, 7)], "chunk_id string, document_id int, version int")
    assert sorted(map(tuple, vectors.upsert(t, c, version="version").collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, vectors.upsert(t, c.drop("version")).collect())) == [("a", 1), ("b", 9), ("c", 5)]


def test_upsert_delete_latest(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, document_id int")
    c = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, document_id int")
    once = vectors.upsert(t, c)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, vectors.upsert(once, c).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    left, n = vectors.delete_document(once, 2)
    assert n == 2 and left.count() == 1
    v = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, version int, x string")
    assert [r.x for r in vectors.latest(v, "key", "version").collect()] == ["new"]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, 1, 0.91, 5.0), (1, 2, 0.85, 5.0), (1, 3, 0.78, 5.0), (2, 1, 0.5, 1.0)], "query_id int, rank int, score double, raw double")
    assert [r.rerank_score for r in rerank.blended(rows).filter("query_id = 1").orderBy("rank").collect()] == [0.9235, 0.8225, 0.713]
    assert {r.rerank_score for r in rerank.minmax(rows).collect()} == {0.0}
    assert [(r.query_id, r.n) for r in rerank.take(rerank.minmax(rows), 2).orderBy("query_id", "n").collect()] == [(1, 1), (1, 2), (2, 1)]
    raw = spark.createDataFrame([("8, 12.5 and 3", 4), ("none", 2), ("1,2,3", 2)], "raw string, n int")
    assert [r.s for r in raw.select(rerank.parse_scores(F.col("raw"), F.col("n")).alias("s")).collect()] == [[0.8, 1.0, 0.3, 0.0], [0.0, 0.0], [0.1, 0.2]]
    with pytest.raises(ValueError):
        rerank.take(rows, 0)


def test_context_budget(spark):
    rows = [(1, 1, "x" * 30_000), (2, 1, "a" * 20_000), (2, 2, "b" * 20_000), (2, 3, "c"), (3, 1, "a" * (4 * 5940)), (3, 2, "b" * 400), (3, 3, "c"), (4, 1, "e" * (4 * 5980))]
    out = {(r.query_id, r.n): r.shown for r in prompt.budget(spark.createDataFrame(rows, "query_id int, n int, text string")).collect()}
    assert set(out) == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)}
    assert out[1, 1] == "x" * 23_920 + prompt.CUT_NOTE and len(out[2, 2]) == (6000 - 5020) * 4 - 80 + len(prompt.CUT_NOTE) and out[4, 1] == "e" * (4 * 5980)


def test_citations(spark):
    df = spark.createDataFrame([("x [Source 1][Source  2] y [Source\n1] [Source 99]",), ("none",), (None,)], "a string")
    assert [r.c for r in df.select(prompt.citations(F.col("a")).alias("c")).collect()] == [["[Source 1]", "[Source 2]", "[Source 99]"], [], []]
    values = [0.045, 0.055, 0.125, 0.375, 1.0, 0.005, 0.015, 0.29, 0.9999, 0.0]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(prompt.two_places(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_chat_turn(spark):
    texts = [("c1", "the red fox runs in the wood"), ("c2", "green tea is drunk warm"), ("c3", "a fox is red")]
    v = spark.createDataFrame(texts, "chunk_id string, text string").select("chunk_id", "text", F.lit("d").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("T").alias("doc_title"), embed(F.col("text")).alias("embedding"))
    q = spark.createDataFrame([(1, "s1", "red fox"), (2, "s2", "green tea")], "query_id int, session_id string, question string")
    m = spark.createDataFrame([("s1", 1, "user", "before")], "session_id string, created_at int, role string, content string")
    out = {r.query_id: r for r in chat.answer(q, v, m, k=3, take=2).collect()}
    assert out[2].citations == ["[Source 1]"] and out[2].cited_chunks == ["c2"] and len(out[1].retrieval_scores) == 3
    assert "User: before" in out[1].prompt and "## QUESTION\nred fox" in out[1].prompt and "[Source 1] T - p.1-2 (relevance:" in out[1].prompt
    assert chat.answer(q, v.filter("false"), None).first().answer == chat.NO_ANSWER
    assert "".join(chat.stream_tokens("a b  c")) == "a b  c"


def test_ingest_decisions_and_statuses(spark):
    known = spark.createDataFrame([("1", "A", "failed", 5), ("2", "A", "ready", 9), ("3", "B", "pending", 1)], "id string, title string, status string, created_at int")
    f = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    get = lambda force: {r.title: (r.existing_id, r.decision) for r in ingest.decide(f, known, force).collect()}
    assert get(False) == {"A": ("2", "skip"), "B": ("3", "reprocess"), "C": (None, "create")} and get(True)["A"] == ("2", "reprocess")
    paths = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1"), 10), ("a.txt", bytearray(b"%PDF"), 1), ("b.PDF", bytearray(b"PK"), 1), ("c.pdf", bytearray(b"%PDF"), 20 * 1024 * 1024 + 1), ("d.pdf", bytearray(b"%PDF"), 20 * 1024 * 1024)], "p string, h binary, n long")
    assert [r.e for r in paths.select(files.upload_error(F.col("p"), F.col("h"), F.col("n")).alias("e")).collect()] == [None, "unsupported type .txt", "not a PDF", "too large", None]


def make_pdf(pages):
    objects, kids = [], []
    for k, lines in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td " + b" T* ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
        packed = zlib.compress(body) if k % 2 else body
        flate = b"/Filter /FlateDecode " if k % 2 else b""
        objects.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * k, 11 + 2 * k))
        objects.append(b"%d 0 obj << %s/Length %d >>\nstream\n%s\nendstream\nendobj" % (11 + 2 * k, flate, len(packed), packed))
        kids.append(b"%d 0 R" % (10 + 2 * k))
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + b" ".join(kids) + b"] >> endobj\n" + b"\n".join(objects) + b"\n%%EOF"


def test_pdf_reader():
    assert pdf.read_pages(make_pdf([["One (a)", "Zwei é"], ["Three"]])) == ["One (a)\nZwei é", "Three"]
    with pytest.raises(pdf.PdfError):
        pdf.read_pages(b"junk")


def test_stream_ingests_new_files_once(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    text = [f"Line {k} of the first page holds some words for a chunk." for k in range(6)]
    (land / "my_first-file.pdf").write_bytes(make_pdf([text, text[:2] + ["Another page with words of its own."]]))
    (land / "bad.pdf").write_bytes(b"%PDF nothing here")
    (land / "no.pdf").write_bytes(b"PK")
    run = lambda: ingest_available(spark, str(land), str(tmp_path / "chunks"), str(tmp_path / "docs"), str(tmp_path / "check")).awaitTermination()
    run()
    docs = {r.title: r for r in spark.read.parquet(str(tmp_path / "docs")).collect()}
    assert docs["My First File"].status == "ready" and docs["My First File"].page_count == 2 and docs["Bad"].status == "failed" and len(docs) == 2
    first = spark.read.parquet(str(tmp_path / "chunks"))
    n = first.count()
    assert n >= 1 and first.filter("page_start = 1").count() >= 1 and first.select("chunk_id").distinct().count() == n
    run()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == n
    scanned = files.scan_folder(spark, str(land))
    assert scanned.count() == 3 and files.document_records(scanned).select("id").distinct().count() == 3


def test_sinks_are_idempotent(spark):
    stored = spark.createDataFrame([("d1", 0, "x", "chunk_d1_0"), ("d2", 0, "y", "chunk_d2_0")], "document_id string, chunk_index int, text string, chunk_id string")
    fresh = spark.createDataFrame([("d1", 0, "n"), ("d1", 2, "m")], "document_id string, chunk_index int, text string")
    once = sinks.replace_chunks(stored, fresh)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.replace_chunks(once, fresh).collect()))
    assert {r.chunk_id for r in once.collect()} == {"chunk_d1_0", "chunk_d1_2", "chunk_d2_0"}


def test_event_windows(spark):
    df = spark.sql("select timestamp '2024-01-01 00:01:00' ts, 'a' event_type, 1.0D value union all select timestamp '2024-01-01 00:04:59', 'a', 2.0D union all select timestamp '2024-01-01 00:05:00', 'a', 4.0D")
    assert sorted((r.n, r.total) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_hash_embedder_is_a_unit_vector():
    e = HashEmbedder(32).embed(["a b c", "", "a b c"])
    assert np.allclose(np.linalg.norm(e, axis=1), [1, 0, 1], atol=1e-6) and (e[0] == e[2]).all()
