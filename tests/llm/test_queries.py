"""The registered queries: digests against brute force on the smallest tables, and the contract's columns."""

import hashlib
import zlib

from strataq.llm import language_id, ogg_media, queries, sentencepiece_codec, token_count, toxicity
from strataq.llm.queries import vocabulary

D = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_digests(spark):
    sp = sentencepiece_codec.load(vocabulary("piece_bpe_32k.model"))
    want = {}
    for k, t in texts(spark).items():
        ids = sp.encode(t or "") + [sp.eos_id()]
        want[k] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(sp.decode(ids).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_sentencepiece(spark, D).collect()} == want


def test_op7_digests(spark):
    want = {}
    for k, t in texts(spark).items():
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = ogg_media.mux(payload)
        want[k] = (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media))
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in queries.op7_ogg_media(spark, D).collect()}
    assert got == want


def test_op9_counts(spark):
    import public_tokenizers
    import regex

    scores = token_count.pieces(vocabulary("byte_bpe_50k.tiktoken"))
    known = {}

    def count(w):
        if w not in known:
            b = w.encode()
            best = [(0.0, 0)] + [None] * len(b)
            for end in range(1, len(b) + 1):
                best[end] = max((best[s][0] + scores[b[s:end]], best[s][1] - 1) for s in range(end) if b[s:end] in scores)
            known[w] = -best[-1][1]
        return known[w]

    want = {k: sum(map(count, regex.findall(public_tokenizers.PATTERN, t or ""))) for k, t in texts(spark).items()}
    assert {r.doc_id: r.n_tokens for r in queries.op9_token_count(spark, D).collect()} == want


def test_learned_queries_have_their_columns(spark):
    ids = set(texts(spark))
    lang = queries.op3_language_id(spark, D)
    assert lang.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert {r.doc_id: r.held_out for r in lang.collect()} == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in ids}
    toxic = queries.op10_toxicity(spark, D)
    assert toxic.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert {r.doc_id: r.held_out for r in toxic.collect()} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in ids}


def test_op3_against_plain_naive_bayes(spark):
    """Counts, log-probabilities and posteriors again, n-gram by n-gram in whole numbers."""
    import math
    import re
    from collections import Counter

    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang").collect()
    size = 1 << 64

    def buckets(text):
        codes = [ord(c) for c in re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")]
        for n in language_id.ORDERS:
            for at in range(len(codes) - n + 1):
                if n == 1 and codes[at] == 32:
                    continue
                h = 0
                for k in range(n):
                    h = (h * 0x100000001B3 + codes[at + k] + k + 1) % size
                yield ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % size) >> (65 - language_id.BUCKETS.bit_length())

    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(buckets(r.text))
    logs = {}
    for lang, c in counts.items():
        n = sum(c.values()) + 0.05 * language_id.BUCKETS
        logs[lang] = lambda b, c=c, n=n: round(math.log((c[b] + 0.05) / n) * language_id.FIXED)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op3_language_id(spark, D).collect()}
    for r in rows:
        found = list(buckets(r.text))
        if not any(c.isalpha() for c in (r.text or "")):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        sums = {lang: sum(map(f, found)) for lang, f in logs.items()}
        best = max(sorted(sums), key=sums.get)
        score = 1 / sum(math.exp(max(-700, (s - sums[best]) / language_id.FIXED)) for s in sums.values())
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - score) < 2e-6


def test_op10_against_plain_edit_distance(spark):
    """Every score again from the fitted lexicon and weights: each word against each term, each hit's window by hand."""
    import math
    import re

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert model.terms or model.stems
    known = {}

    def near(a, b):
        if a == b:
            return True
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    def kind(w):
        if w not in known:
            known[w] = 0 if w in model.terms else 2 if any(w.startswith(s) for s in model.stems) else 1 if any(len(t) >= toxicity.FUZZY and near(t, w) for t in model.terms) else None
        return known[w]

    def quoted_(text, a, b):
        def marks(lo, hi):
            n = 0
            for i in range(lo, hi):
                inside = 0 < i < len(text) - 1 and re.match(r"\w", text[i - 1]) and re.match(r"\w", text[i + 1])
                n += text[i] in "\"“”„«»‘`" or text[i] in "'’" and not inside
            return n

        lo, hi = max(0, a - toxicity.WINDOW), min(len(text), b + toxicity.WINDOW)
        before, after = re.findall(r"\w+", text[lo:a])[-4:], re.findall(r"\w+", text[b:hi])[:4]
        quote = bool(set(before) & toxicity.REPORTS) or (marks(lo, a) % 2 == 1 and marks(b, hi) > 0)
        return quote, bool(set(before + after) & toxicity.ADDRESS)

    got = {r.doc_id: (r.score, r.predicted) for r in queries.op10_toxicity(spark, d).collect()}
    for r in docs.collect():
        low = (r.text or "").lower()
        hits = [(kind(m[0]), *quoted_(low, m.start(), m.end())) for m in re.finditer(r"\w+", low) if kind(m[0]) is not None]
        x = [math.log1p(sum(k == j and q == side for k, q, _ in hits)) for side in (False, True) for j in range(3)]
        plain = sum(not q for _, q, _ in hits)
        x += [math.log1p(sum(a and not q for _, q, a in hits)), min(1.0, 10 * plain / max(10, len(re.findall(r"\w+", low))))]
        z = sum(a * b for a, b in zip(x, model.weights)) + model.bias
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert abs(got[r.doc_id][0] - score) < 2e-6 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.5), r.doc_id
