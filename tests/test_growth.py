"""Work that must not be done twice, and sizes that must stay bounded as tables grow."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from strataq.functions import text as tx
from strataq.operators import chunking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_chunks_are_made_once(spark):
    """A filter on the size of the array, which the optimizer takes from explode, made every chunk three times."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    p = plan(chunking.recursive(df, size=40, overlap=4, engine="native"))
    assert "size(aggregate(" not in p and p.count("aggregate(aggregate(flatten(") == 1


def test_strip_takes_what_python_takes(spark):
    rng = random.Random(3)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["".join(rng.choice([*blanks, "a", "é", "字", "​", "\x00"]) for _ in range(rng.randrange(9))) for _ in range(3000)] + [b + "x" + b for b in blanks] + ["".join(blanks)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", tx.strip(F.col("t")).alias("s")).collect()
    assert sorted(tx.SPACES) == blanks and all(r.s == texts[r.id].strip() for r in got)
    assert spark.range(1).select(tx.strip(F.lit(None).cast("string")).alias("s")).first().s is None


def test_recursive_chunks_are_made_once_and_in_slices(spark, monkeypatch):
    """One Python step, whose worker holds the chunks of a slice, not of a batch."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert plan(chunking.recursive(df, size=40, overlap=4)).count("ArrowEvalPython") == 1
    held = []
    whole = chunking.chunk_lists
    monkeypatch.setattr(chunking, "chunk_lists", lambda rows: held.append(len(rows)) or whole(rows))
    made = {}
    monkeypatch.setattr(chunking.F, "arrow_udf", lambda f, kind: made.setdefault("f", f) and (lambda *c: F.lit(None).cast(kind)))
    chunking.recursive(df, size=40, overlap=4)
    texts = pa.array(["a word and " * 20_000] * 12 + [None, ""])
    out = pa.concat_arrays(list(made["f"](iter([texts]))))
    assert len(out) == 14 and max(held) <= 4 and out[13].as_py() == [] and out[0].as_py() == out[11].as_py() and out[0].as_py()[1]["chunk_index"] == 1


def test_a_turn_searches_and_embeds_once(spark):
    """Every further use of the candidates searched all vectors again, and a filter on them embedded twice in each search."""
    from strataq.plans import catalog

    for name in ("chat_turns", "chat_streamed"):
        p = plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        assert p.count("MapInArrow") == 1 and p.count("ArrowEvalPython") == 2, name  # the chunks' vectors and the answers


def test_hashed_vectors_of_a_batch_are_those_of_a_text(spark):
    import zlib

    import numpy as np

    from strataq.operators.embedding import HashEmbedder

    texts = ["", " ", "one", "a\x1cb \xa0 c\x85d e", "İ ß é　字 é", "x " * 9000, "ab cd " * 3000]
    for dim in (1, 64, 768):
        got = HashEmbedder(dim).embed(texts)
        for row, text in zip(got, texts):
            words, want = text.lower().split(), np.zeros(dim, np.float32)
            for f in [*words, *(a + " " + b for a, b in zip(words, words[1:]))]:
                h = zlib.crc32(f.encode())
                want[h % dim] += 1.0 if h >> 31 else -1.0
            size = np.sqrt((want * want).sum())
            assert np.array_equal(row, want / size if size else want)


def test_semantic_chunks_shuffle_nothing(spark):
    """Vectors of sentences are many times as long as the text; rows with equal keys stay apart, and missing vectors break nothing."""
    from strataq.operators.embedding import HashEmbedder, embed

    words = [f"The {a} of the {b} was seen again here. " for a in ("fox", "tea", "sea", "ship") for b in ("moon", "hill", "king")]
    rng = random.Random(5)
    rows = [(k % 7, "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 40, 700]))), None if k % 2 else "s") for k in range(25)] + [(3, None, "s"), (3, "short", "s")]
    df = spark.createDataFrame(rows, "id int, text string, source string").coalesce(1)
    out = chunking.semantic(df, lambda c: embed(c, lambda: HashEmbedder(16)), "id", threshold=0.3)
    assert "Exchange" not in plan(out) and out.columns == ["id", "source", "chunk_index", "text", "char_start", "char_end", "token_count"]
    got = [(r.id, r.source, r.chunk_index, r.text) for r in out.collect()]
    want = []
    for k, text, source in rows:
        one_row = spark.createDataFrame([(text,)], "text string").select(chunking.sentences(F.col("text")).alias("s")).first().s or []
        v = HashEmbedder(16).embed(one_row).astype(float)
        breaks = [i > 0 and v[i] @ v[i - 1] < 0.3 for i in range(len(v))]
        want += [(k, source, i, " ".join(g)) for i, g in enumerate(chunking.merged_groups(one_row, breaks)) if one_row]
    assert got == want and len(got) > 20
    mixed = pa.array([[1.0, 0.0], None, [0.0, 1.0], [0.0, 2.0, 5.0], [0.0, 0.0, 0.0], [None, 1.0]], pa.list_(pa.float32()))
    sims, last = chunking.neighbour_cosines(mixed, None)
    assert [round(x, 6) if x == x else None for x in sims.tolist()] == [None, None, None, round(2 / 29**0.5, 6), 0.0, None] and len(last) == 2


def test_each_strategy_runs_once_where_the_rows_are(spark):
    from strataq.operators.embedding import embed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.element_at(F.array(F.lit("fixed"), F.lit("semantic"), F.lit("recursive")), (F.col("doc_id") % 3 + 1).cast("int")).alias("chunk_strategy"))
    p = plan(chunking.by_strategy(docs, embed, "doc_id", size=40, overlap=4))
    assert "Exchange" not in p and p.count("ArrowEvalPython") == 2  # vectors of sentences, recursive chunks
