"""SentencePiece, language ID, token counts and toxicity."""

import random
import re
import zlib

import numpy as np
import pytest

from strataq.llm import language_id, sentencepiece_codec, token_count, toxicity
from strataq.llm.queries import vocabulary

ODD = [None, "", " ", "  a", "a  b ", "▁x▁", "a\x00b", "\n\n a\t b", "é😀 x", "a　b\xa0c", "ﬁÅ", "\r\n", "</s> <s> <unk> <0x0A>", "x" * 5000, "  " * 700, "word " * 3000, "日本語テキスト"]


def model():
    return vocabulary("piece_bpe_32k.model")


def texts(seed=1, n=120):
    rng = random.Random(seed)
    letters = "abcdefghij éüß  \n\t▁😀0123.,"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(n)] + ODD


def test_sentencepiece_equals_the_library(spark):
    sp = sentencepiece_codec.load(model())
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumnRenamed("doc_id", "IDS2").selectExpr("IDS2 as doc_id", "text", "'old' as IDS", "1 as `a.b`").repartition(3)
    out = sentencepiece_codec.encode_text(df, model())
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "ids", "decoded"])
    got = {r.doc_id: (r.ids, r.decoded) for r in out.collect()}
    for k, t in enumerate(rows):
        want = sp.encode(t or "") + [sp.eos_id()]
        assert got[k] == (want, sp.decode(want)), (k, t)


def test_chunk_table_limit_changes_nothing():
    sp = sentencepiece_codec.load(model())
    rows = [t for t in texts(2) if t]
    for limit in (1, 7, 10**6):
        table = sentencepiece_codec.ChunkTable(sp, limit)
        for at in range(0, len(rows), 9):
            flat, lens = table.encode(rows[at : at + 9], [])
            assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == sp.encode(rows[at : at + 9])


def test_inseparable_models_are_encoded_whole():
    class Crossing:
        def __init__(self, sp):
            self.sp = sp

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 5 else self.sp.id_to_piece(i)

    sp = sentencepiece_codec.load(model())
    table = sentencepiece_codec.ChunkTable(Crossing(sp))
    assert table.whole
    flat, lens = table.encode(["a b", None], [2])
    assert flat.tolist() == sp.encode("a b") + [2, 2] and lens.tolist() == [len(sp.encode("a b")) + 1, 1]


def test_codec_on_no_rows(spark):
    assert sentencepiece_codec.encode_text(spark.createDataFrame([], "text string"), model()).collect() == []


def brute_count(text, scores, pattern):
    import regex

    total = 0
    for token in regex.findall(pattern, text or ""):
        w = token.encode()
        best = [(0.0, 0)] + [None] * len(w)
        for end in range(1, len(w) + 1):
            best[end] = max((best[s][0] + scores[w[s:end]], best[s][1] - 1) for s in range(end) if w[s:end] in scores)
        total -= best[-1][1]
    return total


def test_token_counts(spark, monkeypatch):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    rows = texts(3, 60)
    scores = token_count.pieces(path)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, path, public_tokenizers.PATTERN).collect()}
    short = [k for k, t in enumerate(rows) if not t or len(t) < 1000]
    assert {k: got[k] for k in short} == {k: brute_count(rows[k], scores, public_tokenizers.PATTERN) for k in short}
    assert all(got[k] == got[k + len(rows) - len(ODD)] for k in range(len(ODD)))
    monkeypatch.setattr(token_count, "DEEP", 3)
    shallow = token_count.Trie(scores)
    deep = token_count.Trie(scores)
    monkeypatch.setattr(token_count, "DEEP", 48)
    for w in ("internationalization", " hello", "zzzzqqqq", "é" * 40):
        want = brute_count(w, scores, r"(?s).+")
        assert deep.count(w) == want == shallow.count(w)


def labelled(n=600, seed=7):
    rng = random.Random(seed)
    words = {"en": "the and thing over house with under green".split(), "de": "der und haus über grün schön nicht ein".split(), "fr": "le et maison été vert où très une".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(words))
        rows.append((k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_language_id_held_out_accuracy(spark):
    rows = labelled() + [(1000, None, "en"), (1001, "", None), (1002, "12 345 !?", "de"), (1003, "le et maison " * 60_000, None), (1004, "Haus", None), (1005, "Haus", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "0 as score").repartition(4)
    import pyspark.sql.functions as F

    train = df.filter(~language_id.held_out(F.col("doc_id")))
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(df, train).collect()}
    test = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(test) > 100 and sum(out[r[0]][0] == r[2] for r in test) >= 0.97 * len(test)
    assert all(out[k] == ("und", 0.0) for k in (1000, 1001, 1002))
    assert out[1003][0] == "fr" and out[1004] == out[1005] and 0 <= out[1004][1] <= 1
    assert {p for p, _ in out.values()} <= {"en", "de", "fr", "und"}
    nothing = language_id.predict_language(df, train.filter("false"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.predict_language(df.filter("false"), train).collect() == []


def test_grams_against_a_plain_count():
    """Each n-gram of letters and single spaces once, none across texts."""
    texts_ = ["Ab c!", None, "é", "  "]
    bucket, owner, letters = language_id.grams(texts_)
    assert letters.tolist() == [3, 0, 1, 0]
    plain = []
    for t in texts_:
        s = re.sub(r"[^a-zé]+", " ", f" {(t or '').lower()} ")
        plain.append(sum(len(re.sub(" ", "", s)) if n == 1 else max(0, len(s) - n + 1) for n in language_id.ORDERS))
    assert np.bincount(owner, minlength=4).tolist() == plain


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_walk_equals_edit_distance():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(60)})
    lexicon = toxicity.Lexicon(terms, ["dcba"])
    for _ in range(4000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10)))
        want = "exact" if w in terms else "stem" if w.startswith("dcba") else "fuzzy" if any(len(t) >= toxicity.FUZZY and edits(w, t) <= 1 for t in terms) else None
        assert lexicon.kind(w) == want, w


def test_context_separates_quotation():
    assert toxicity.context('he said "idiot" to us', 9, 14)[0]
    assert toxicity.context("the word idiot is rude", 9, 14)[0]
    assert not toxicity.context("go away idiot now", 8, 13)[0]
    assert toxicity.context("you are an idiot", 11, 16)[1]


def test_toxicity_held_out_and_misspelled(spark):
    rng = random.Random(5)
    clean = [f"w{rng.randrange(300)}" for _ in range(2000)]
    bad = ["idiot", "moron", "worthless", "disgusting"]
    rows, labels = [], []
    for k in range(700):
        words = [rng.choice(clean) for _ in range(rng.randrange(3, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    extra = [(900, None), (901, ""), (902, "you idoit are a wortless morron disgustin"), (903, 'they wrote "idiot" there'), (904, "w1 w2"), (905, "w1 " * 200_000), (906, "w1 w2")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (7, labels[7][1])], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert set(bad) <= set(model.terms)
    out = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80 and sum(out[k][1] == y for k, y in held) >= 0.98 * len(held)
    assert out[900] == out[901] and out[904] == out[906] and out[905][1] == 0
    assert out[903][1] == 0 and all(0 <= s <= 1 for s, _ in out.values())
    assert out[902][0] > out[904][0]
    none = toxicity.fit(docs, marks.filter("toxic = 0"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.filter("false"), model).collect() == []


@pytest.mark.parametrize("x,want", [(0, 0.5)])
def test_logistic_of_nothing_to_learn(x, want):
    w, b = toxicity.logistic(np.array([[x], [x]], float), np.array([0.0, 1.0]), np.array([3.0, 3.0]))
    assert abs(1 / (1 + np.exp(-b)) - want) < 1e-6 and w == [0.0]


def test_ngrams_of_long_texts_count_once(monkeypatch):
    rng = random.Random(12)
    texts_ = ["".join(rng.choice("abc  é.") for _ in range(n)) for n in (5, 700, 0, 49, 50, 51, 3000)] + [None]
    whole = language_id.grams(texts_)
    for piece in (1, 7, 50, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        cut = language_id.grams(texts_)
        assert cut[2].tolist() == whole[2].tolist()
        assert sorted(zip(cut[0].tolist(), cut[1].tolist())) == sorted(zip(whole[0].tolist(), whole[1].tolist()))


def test_apostrophes_inside_words_are_no_quotes():
    text = "i don't like you idiot it's over"
    at = text.index("idiot")
    assert not toxicity.context(text, at, at + 5)[0]
    for quote in ("'idiot' she heard", "‘idiot’ she heard", '"idiot" she heard'):
        assert toxicity.context("then " + quote, 6, 11)[0]
    long = "x" * 60 + "n't a b c d idiot it's"  # the window begins inside a word
    assert not toxicity.context(long, long.index("idiot"), long.index("idiot") + 5)[0]


def test_token_table_is_emptied_by_entries_too(monkeypatch):
    scores = token_count.pieces(vocabulary("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(token_count, "DEEP", 4)
    monkeypatch.setattr(token_count, "NODES", 100)
    trie = token_count.Trie(scores)
    for k in range(200):
        trie.count("same" + str(k) * 3)
        if trie.full():
            trie.clear()
        assert len(trie.counts) <= 101


def test_token_scores_try_only_pieces_that_end_there():
    class Tried(dict):
        tries = 0

        def get(self, *args):
            self.tries += 1
            return super().get(*args)

    word = "internationalization"
    scores = Tried(token_count.pieces(vocabulary("byte_bpe_50k.tiktoken")))
    trie = token_count.Trie(scores)
    scores.tries = 0
    ending = sum(word[k:end].encode() in scores for end in range(1, len(word) + 1) for k in range(end))
    assert trie.count(word) == brute_count(word, dict(scores), r"(?s).+")
    assert scores.tries <= ending


def test_token_automaton_and_sweeps_against_plain_counts(monkeypatch):
    """Nested pieces, ties, NULs, words that begin others, words beyond the trie; tries of any size."""
    rng = random.Random(9)
    scores = {bytes([k]): -4.0 for k in range(256)} | {p: -float(rng.randrange(2, 7)) for p in (b"ab", b"aba", b"bab", b"b\0", b"abab", b"\0\0", "é".encode(), "bé".encode(), b"aaaaaaa")}
    automaton = token_count.Automaton(scores)
    words = {"".join(rng.choice("aab\0é") for _ in range(rng.randrange(1, 14))) for _ in range(300)} | {"ab" * 40, "ab" * 40 + "a", "a" * 48, "a" * 49}
    for w in words:
        b, state = w.encode(), 0
        for end in range(1, len(b) + 1):
            state = int(automaton.table[automaton.row[state], b[end - 1]])
            at, found = int(automaton.first[state]), []
            while at:
                found.append((int(automaton.size[at]), float(automaton.gain[at])))
                at = int(automaton.link[at])
            assert found == [(end - k, scores[b[k:end]]) for k in range(end) if b[k:end] in scores]
    want = {w: brute_count(w, scores, r"(?s).+") for w in words}
    for deep, nodes in ((48, 300_000), (48, 100), (5, 20), (1, 1)):
        monkeypatch.setattr(token_count, "DEEP", deep)
        monkeypatch.setattr(token_count, "NODES", nodes)
        trie = token_count.Trie(automaton)
        trie.count_all(words)
        assert trie.counts == want


def test_token_counts_do_not_depend_on_the_table(monkeypatch):
    """Slices that find a full table, and one that alone is more than a table."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    scores = token_count.pieces(path)
    made = []
    monkeypatch.setattr(token_count, "array_udf", lambda make, kind: made.append(make()))
    rows = [t for t in texts(5, 40) if not t or len(t) < 400]
    want = [brute_count(t, scores, r"\S+|\s+") for t in rows]
    for nodes in (1, 60, 300_000):
        monkeypatch.setattr(token_count, "NODES", nodes)
        token_count.counter(path, r"\S+|\s+")
        assert [made[-1](rows[k : k + 7]).field(0).to_pylist() for k in range(0, len(rows), 7)] == [want[k : k + 7] for k in range(0, len(rows), 7)]
    assert made[-1]([None, ""]).field(1).to_pylist() == [0, 0] and len(made[-1]([])) == 0


def test_outputs_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "text", "x", "y")], "doc_id long, text string, Predicted string, SCORE string")
    out = toxicity.score_toxicity(df, toxicity.Model(constant=0.25))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.first().predicted == 0
