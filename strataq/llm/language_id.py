"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, hashed n-gram) in Arrow batches on the executors and sums them by shuffle in
blocks of buckets; the log-probability matrix has languages x ``BUCKETS`` entries, whatever the corpus
size, and is what each task gets. Scoring is a sparse product in numpy: the n-gram buckets of a batch are
the column indices of a CSR matrix of ones, whose rows are summed over the matrix.

Training reads at most about ``max_train_rows`` labelled rows, drawn by a hash of the row (a documented
bound; the number of labelled rows is counted first). Language priors are uniform, so that a language
that holds most of the corpus doesn't win short texts.

Defined cases: null text, or a text without a letter: ``und`` with score 0. Rows without a language never
train. Without any training row every text is ``und``. Texts are taken whole, however long: every n-gram of
a text counts once. Equal texts have equal results: log-probabilities are fixed-point integers, so sums
don't depend on order. Ties go to the language that sorts first. Repeated rows train as often as they
stand there. An empty table gives no rows. Other columns pass through; columns named like outputs are
replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import array_udf, quoted, slices, with_result

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
BLOCK = 1 << 12
FIXED = 1 << 12
#: Code points of a text that are handled at a time; the last ones of a piece stand again before the next, so that every
#: n-gram counts once, whatever the piece.
PIECE = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Per code point: itself for letters, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)], np.uint32)


def tidy(text: str | None) -> np.ndarray:
    """Code points of a lower-cased text between two spaces, where all but letters are single spaces."""
    codes = letters()[np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def _hashed(codes: np.ndarray, owner: np.ndarray, fresh: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of the n-grams of one owner each that end at a ``fresh`` code point, for each order."""
    codes, blank = codes.astype(np.uint64), codes == 32
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            ok = (owner[: len(h)] == owner[n - 1 :]) & fresh[n - 1 :]
            ok &= ~blank[: len(h)] if n == 1 else True
            mixed = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15))[ok]
            yield (mixed >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32), owner[: len(h)][ok]


def gram_parts(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """CSR views of a batch: the bucket of each n-gram, its text, and the number of letters of each text, in parts of about
    ``PIECE`` code points. An n-gram never leaves its text, and each counts once, also where a long text is in several parts."""
    most = max(ORDERS) - 1
    held: list[tuple[int, np.ndarray, int]] = []  # text, code points, how many of them an earlier part has counted
    size = 0

    def part() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.concatenate([c for _, c, _ in held])
        lens = [len(c) for _, c, _ in held]
        owner = np.repeat(np.array([k for k, _, _ in held], np.int32), lens)
        fresh = np.ones(len(codes), bool)
        for at, (_, _, known) in zip(np.cumsum([0, *lens[:-1]]).tolist(), held):
            fresh[at : at + known] = False
        n_letters = np.bincount(owner[(codes != 32) & fresh], minlength=len(texts))
        found = list(_hashed(codes, owner, fresh, buckets))
        return np.concatenate([b for b, _ in found]), np.concatenate([o for _, o in found]), n_letters

    for k, text in enumerate(texts):
        codes = tidy(text)
        for at in range(0, len(codes), PIECE):
            before = min(at, most)
            held.append((k, codes[at - before : at + PIECE], before))
            size += len(held[-1][1])
            if size >= PIECE:
                yield part()
                held, size = [], 0
    if held:
        yield part()


def grams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts of ``gram_parts`` in one."""
    found = list(gram_parts(texts, buckets)) or [(np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(len(texts), np.int64))]
    return np.concatenate([b for b, *_ in found]), np.concatenate([o for _, o, _ in found]), np.sum([n for *_, n in found], axis=0)


def count_matrix(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, block, counts): summed n-gram counts of labelled rows in blocks of ``BLOCK`` buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            at = 0
            langs = batch.column(1).to_pylist()
            for texts in slices(batch.column(0)):
                own = np.array(langs[at : at + len(texts)], object)
                at += len(texts)
                for bucket, owner, _ in gram_parts(texts):
                    for name in sorted(set(own)):
                        mine = bucket[(own == name)[owner]]
                        totals[name] = totals.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
        for name, total in totals.items():
            cut = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(cut), "block": np.arange(len(cut), dtype=np.int32), "counts": [x.astype(np.int64) for x in cut]})

    parts = rows.select(quoted(text).alias("text"), quoted(lang).alias("lang")).mapInArrow(count, "lang string, block int, counts array<long>")
    each = parts.select("lang", "block", F.posexplode("counts").alias("slot", "n")).filter("n > 0")
    return each.groupBy("lang", "block", "slot").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", max_train_rows: int = 30_000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the fixed-point log-probability matrix (bucket x language)."""
    labelled = rows.filter(quoted(lang).isNotNull() & quoted(text).isNotNull())
    total = labelled.count()
    if total > max_train_rows:
        draw = F.pmod(F.xxhash64(quoted(text), quoted(lang)), F.lit(1_000_000)) < int(1_000_000 * max_train_rows / total)
        labelled = labelled.filter(draw)
    cells = count_matrix(labelled, text, lang).groupBy("lang").agg(F.collect_list("block").alias("b"), F.collect_list("slot").alias("s"), F.collect_list("n").alias("n")).collect()
    names = sorted(r.lang for r in cells)
    counts = np.zeros((BUCKETS, len(names)))
    for r in cells:  # at most BUCKETS cells for each language
        counts[np.array(r.b) * BLOCK + np.array(r.s), names.index(r.lang)] = r.n
    probs = (counts + 0.05) / (counts.sum(0) + 0.05 * BUCKETS) if names else counts
    return names, np.round(np.log(probs) * FIXED).astype(np.int32) if names else counts.astype(np.int32)


def scorer(names: list[str], matrix: np.ndarray, spark):
    """Arrow UDF: text -> struct of the predicted language and its posterior probability."""
    held = spark.sparkContext.broadcast((names, matrix))

    def make():
        langs, logs = held.value

        def work(texts: list[str | None]) -> pa.Array:
            sums, n_letters = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts), np.int64)
            for bucket, owner, some in gram_parts(texts):
                n_letters += some
                for k in range(len(langs)):
                    sums[:, k] += np.bincount(owner, weights=logs[:, k][bucket], minlength=len(texts))
            best = sums.argmax(1)
            over = np.exp(np.clip((sums - sums.max(1, keepdims=True)) / FIXED, -700, 0))
            score = np.round(1 / over.sum(1), 6)
            known = (n_letters > 0) & bool(langs)
            out = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(np.where(known, score, 0.0))], ["lang_pred", "score"])

        return work

    return array_udf(make, "struct<lang_pred:string,score:double>")


def predict_language(df: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", max_train_rows: int = 30_000) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` of a model fitted on ``train``."""
    names, matrix = fit(train, text, lang, max_train_rows)
    return with_result(df, scorer(names, matrix, df.sparkSession)(quoted(text)), ["lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
