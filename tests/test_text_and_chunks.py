"""Text, page and chunk operators against short restatements of their rules and against edge cases."""

import random
import re

from pyspark.sql import functions as F

from strataq.functions import text as tx
from strataq.operators import chunking
from strataq.operators import pages as pg

EDGES = ["", " \n\t ", "one", "a b  c\n\nd", "x" * 700, "A. B? C! D; E, F. " * 60, "w " * 112, "w " * 113, "p1\n\n\np2\n\np3\n" * 40, "a\xa0b\x85c\r\nd\x0ce", "é ü ß " * 300]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_clean(spark):
    raw = "ﬁne “q” –\n  next word-\n  joined\t\tx\n\n\n\ny\x00\x07z­  "
    assert one(spark, raw, tx.clean) == 'fine "q" next wordjoined x\n\nyz'
    assert one(spark, None, tx.clean) == "" and one(spark, "", tx.clean) == ""
    assert one(spark, " \n a \n|\n5\n\nb ||||   c\n", tx.clean_ocr) == "a\n5\n\nb c"


def test_small_text_functions(spark):
    assert one(spark, "a\xa0b \x1c c", tx.word_count) == 3 and one(spark, None, tx.word_count) == 0
    assert [one(spark, t, tx.estimate_tokens) for t in ("", "abc", "abcdefgh")] == [1, 1, 2]
    assert one(spark, "x" * 121, tx.preview) == "x" * 120 + "..." and one(spark, "x" * 120, tx.preview) == "x" * 120
    assert one(spark, "/a/b/o'neil_2nd-x.ray.pdf", tx.title_from_path) == "O'Neil 2Nd X.Ray"
    assert one(spark, "straße élan", tx.title_case_unicode) == "straße élan".title()
    assert one(spark, "Heart attack", lambda c: tx.highlight(c, ["heart", "at"])) == "<mark>Heart</mark> attack"
    assert [one(spark, s, lambda c: tx.score_class(c.cast("double"))) for s in ("0.8", "0.6", "0.1")] == ["high", "mid", "low"]
    rows = spark.createDataFrame([([["a ", None], [None, ""], ["b", "c"]],), ([],), (None,)], "t array<array<string>>").select(tx.table_to_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["| a |  |\n| b | c |", "", ""]


def test_repeated_lines(spark):
    pages = [(1, k, f"Header\nbody {k}\n  Header" if k == 1 else f"Header\nbody {k}") for k in range(1, 5)] + [(2, 1, "H\nx"), (2, 2, "H\ny"), (3, 1, "z" * 80), (3, 2, "z" * 80), (3, 3, "q")]
    df = spark.createDataFrame(pages, "document_id int, page_number int, text string")
    found = {(r.document_id, r.line): r.n for r in pg.repeated_lines(df).collect()}
    assert found == {(1, "Header"): 5, (2, "H"): 2}
    out = {(r.document_id, r.page_number): r.text for r in pg.strip_repeated(df).collect()}
    assert out[1, 1] == "body 1" and out[2, 1] == "H\nx" and out[3, 1] == "z" * 80


def test_offsets_assembly_and_lookup(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "  "), (1, 3, "defg"), (2, 1, "")], "document_id int, page_number int, text string")
    drift = {(r.document_id, r.page_number): (r.char_start, r.char_end) for r in pg.offsets(pages).collect()}
    exact = {(r.document_id, r.page_number): (r.char_start, r.char_end) for r in pg.offsets(pages, skip_blank=True).collect()}
    assert drift[1, 3] == (7, 11) and exact[1, 3] == (4, 8)
    full = {r.document_id: r for r in pg.assemble(pages).collect()}
    assert full[1].full_text == "abc\ndefg" and full[1].empty_pages == [1, 2, 3] and not full[2].has_text and full[2].warnings[0] == "No text extracted."
    tidy = pg.offsets(pages)
    wanted = spark.createDataFrame([(1, 0), (1, 3), (1, 4), (1, 9), (1, 99), (7, 3)], "document_id int, position int")
    assert {(r.document_id, r.position): r.page_number for r in pg.locate(wanted, tidy, span=4).collect()} == {(1, 0): 1, (1, 3): 1, (1, 4): 2, (1, 9): 3, (1, 99): 3, (7, 3): 1}
    arrays = wanted.join(pg.page_array(tidy), "document_id", "left").select("document_id", "position", pg.page_of(F.col("position"), F.col("pages")).alias("p"))
    assert {(r.document_id, r.position): r.p for r in arrays.collect()} == {(1, 0): 1, (1, 3): 1, (1, 4): 2, (1, 9): 3, (1, 99): 3, (7, 3): 1}


def test_fixed_windows(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id int, text string")
    got = {}
    for r in chunking.fixed(df, size=16, overlap=4).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.char_start, r.char_end))
    for k, t in enumerate(EDGES):
        words, spots = t.split(), [m.start() for m in re.finditer(r"[^ \t\n]+", t)]
        want = [(i, " ".join(words[s : s + 16]), spots[s] if s < len(spots) else 0) for i, s in enumerate(range(0, len(words), 12))]
        assert sorted(got.get(k, [])) == [(i, x, s, s + len(x)) for i, x, s in want], k
    assert chunking.fixed_step(10, 99) == 5 and chunking.fixed_step(1, 0) == 1


def test_recursive_engines_agree(spark):
    rng = random.Random(4)
    texts = EDGES + ["".join(rng.choice(["word ", "a. ", "b? ", "\n", "\n\n", "\n\n\n", ", ", "; ", "longerword", " "]) for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    key = lambda r: (r.doc_id, r.chunk_index, r.text, r.char_start, r.char_end, r.token_count)
    for size, overlap in ((12, 3), (40, 0)):
        arrow = sorted(map(key, chunking.recursive(df, size=size, overlap=overlap).collect()))
        native = sorted(map(key, chunking.recursive(df, size=size, overlap=overlap, engine="native").collect()))
        assert arrow == native and len(arrow) > 60


def test_exact_offsets_point_at_the_words(spark):
    text = "First part here. Second part there? Third\n\nFourth one, fifth one; sixth one. " * 12
    rows = chunking.recursive(spark.createDataFrame([(1, text)], "doc_id int, text string"), size=20, overlap=2, offsets="exact").collect()
    assert len(rows) > 8
    for r in rows:
        assert text[r.char_start : r.char_end].split()[0].startswith(r.text.split()[0])
    starts = [r.char_start for r in sorted(rows, key=lambda r: r.chunk_index)]
    assert starts == sorted(set(starts))


def test_sentences(spark):
    text = "We met Dr. Who yesterday. Did he sleep. Next morning came! See fig. 3 for more, et al. 2020 showed it. Tiny. The volcano. Then it ended well"
    got = one(spark, text, chunking.sentences)
    assert got == ["We met Dr. Who yesterday.", "Did he sleep. Next morning came!", "See Fig. 3 for more, et al. 2020 showed it.", "The volcaNo. Then it ended well"]
    assert "See Fig. 3 for more, et al. 2020 showed it." in got
    assert one(spark, "Short. Also short.", chunking.sentences) == []


def test_groups(spark):
    rows = [(1, k, v, t) for k, (v, t) in enumerate([([1.0, 0.0], 150), ([1.0, 0.1], 10), ([0.0, 1.0], 20), ([0.0, 1.0], 30), ([1.0, 0.0], 120), ([0.0, 0.0], 5)])]
    df = spark.createDataFrame(rows, "doc int, pos int, embedding array<double>, token_count int")
    out = sorted(chunking.merge_small_groups(chunking.breakpoint_groups(df, "doc", "pos"), "doc", "pos").collect(), key=lambda r: r.pos)
    assert [r.group_id for r in out] == [0, 0, 1, 1, 2, 3] and [r.merged_id for r in out] == [0, 0, 0, 0, 1, 1]
    assert out[5].similarity == 0.0


def test_titles_of_every_script(spark):
    for t in ("élan vital straße", "ß ßa ﬁn ǆem", "ΟΔΟΣ ὀδυσσεύς", "дом-музей 2й", "日本a語b", "a1b c'd É", "", "İstanbul ıc"):
        assert one(spark, t, tx.title_case) == t.title(), t
    assert one(spark, "x/élan_vital-straße.pdf", tx.title_from_path) == "Élan Vital Straße"


def test_exact_offsets_hold_every_word_of_a_chunk(spark):
    """On whole documents and on a small vocabulary, where words repeat."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b.", "c;", "d", "e?"]) for _ in range(400)) for _ in range(8)] + EDGES
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], docs.schema))
    whole = {r.doc_id: r.text for r in df.collect()}
    bare = lambda t: [w.rstrip(".?!;,") for w in t.split() if w.rstrip(".?!;,")]  # noqa: E731  splitting takes these away
    n = 0
    for size, overlap in ((20, 4), (128, 16)):
        search = {(r.doc_id, r.chunk_index): r.text for r in chunking.recursive(df, size=size, overlap=overlap).collect()}
        for r in chunking.recursive(df, size=size, overlap=overlap, offsets="exact").collect():
            assert search[r.doc_id, r.chunk_index] == r.text
            assert bare(whole[r.doc_id][r.char_start : r.char_end]) == bare(r.text)
            n += 1
    assert n > 6000


def test_sentences_against_a_plain_split(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    extra = ["We met Dr. Who. He left! Was it vol. 3? No. It was the pp. 3 of it. ok", "x" * 30 + ". " + "y" * 30, ""]
    docs |= {-k: t for k, t in enumerate(extra, 1)}
    df = spark.createDataFrame([(k, t) for k, t in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", chunking.sentences(F.col("text")).alias("s")).collect()}
    for k, t in docs.items():
        for i, a in enumerate(chunking.ABBREVIATIONS):
            t = re.sub(re.escape(a), chr(0xE100 + i), t, flags=re.I)
        parts = re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", t)
        for i, a in enumerate(chunking.ABBREVIATIONS):
            parts = [p.replace(chr(0xE100 + i), a) for p in parts]
        assert got[k] == [p.strip() for p in parts if len(p.strip()) > 15], k


def test_semantic_chunks_against_a_plain_fold(spark):
    """Sentences embedded, broken where neighbours differ, small groups joined to the one before, first sentences looked up."""
    import numpy as np

    from strataq.operators.embedding import HashEmbedder, embed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunking.semantic(docs, embed, "doc_id", threshold=0.05).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.char_start, r.char_end))
    found = {r.doc_id: (r.text, r.s) for r in docs.select("doc_id", "text", chunking.sentences(F.col("text")).alias("s")).collect()}
    model, tokens = HashEmbedder(), lambda x: max(1, len(x) // 4)
    for k, (text, sentences) in found.items():
        v = model.embed(sentences).astype(float)
        groups = []
        for i, s in enumerate(sentences):
            size = np.sqrt((v[i] ** 2).sum()) * np.sqrt((v[i - 1] ** 2).sum())
            if i and (v[i] @ v[i - 1] / size if size else 0.0) >= 0.05:
                groups[-1].append(s)
            else:
                groups.append([s])
        merged = []
        for g in groups:
            if merged and sum(map(tokens, g)) < 100:
                merged[-1] += g
            else:
                merged.append(list(g))
        want, at = [], 0
        for i, g in enumerate(merged):
            start = text.find(g[0], at)
            start = at if start < 0 else start
            want.append((i, " ".join(g), start, start + len(" ".join(g))))
            at = max(at, start + 1)
        assert sorted(got.get(k, [])) == want, k
