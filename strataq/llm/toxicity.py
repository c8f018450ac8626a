"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

Learning (on at most about ``max_train_rows`` labelled rows, drawn by a hash of the id: a documented bound): words and
word beginnings whose document counts differ between toxic and clean texts with a log-likelihood ratio above ``SURE``
become the lexicon. Matching: the automaton of words within one edit of a word walks the trie of terms; entries that are
word beginnings match exactly and accept any ending. Context: a window about each hit tells quoted or reported terms
from abuse; an apostrophe inside a word is no quotation mark. The counts of hits by kind and context feed a logistic regression.

The lexicon takes every entry that is sure enough. Each stands in four of the training texts at least, so these bound it.

Defined cases: null and empty texts have no hits and the score of such texts; with no toxic or no clean row to learn
from the lexicon is empty and every score is the share of toxic rows (0 without rows). Texts are taken whole, however long.
Equal texts have equal scores. Repeated labels of an id: the highest counts; repeated rows of an id all train. An empty table
gives no rows. Other columns pass through; ``score`` and ``predicted`` (in any case) are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import array_udf, quoted, slices, with_result
from .shared import store

SURE = 20.0
LEAN = 3.0
STEMS = range(4, 8)
#: Letters of terms that may be misspelled.
FUZZY = 5
WINDOW = 48
WORDS = 300_000
KINDS = ("exact", "fuzzy", "stem")
_WORD = re.compile(r"\w+")
#: Quotation marks; apostrophes only where they don't stand inside a word.
_QUOTE = re.compile(r"[\"“”„«»‘`]|(?<!\w)['’]|['’](?!\w)")
#: Words that report speech, and words that address someone (fixed lists; English, German, French, Spanish).
REPORTS = frozenset("said says wrote written quote quoted quotes called term word slur sagte schrieb zitat zitiert wort dit écrit cite mot terme dijo escribió cita palabra término".split())
ADDRESS = frozenset("you your youre u du dich dein deine ihr euch tu toi ton ta vous votre tú ti vos usted".split())


class Lexicon:
    """Terms and stems in one trie of dicts; '' holds an entry's kind at its end."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.least, self.most = min(map(len, terms), default=1) - 1, max(map(len, terms), default=0) + 1
        for kind, words in (("stem", stems), ("exact", terms)):
            for w in words:
                node = self.root
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = kind
        for w in terms:
            if len(w) >= FUZZY:  # with one edit, one half is whole
                self.heads.add(w[: len(w) // 2])
                self.tails.add(w[len(w) // 2 :])
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.known: dict[str, str | None] = {}

    def kind(self, word: str) -> str | None:
        """exact, fuzzy or stem for a lexicon word, one within an edit of a term, or one that begins with a stem."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= WORDS:
            self.known.clear()
        found = self.known[word] = self.match(word)
        return found

    def match(self, word: str) -> str | None:
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if node.get("") == "stem":
                stem = "stem"
        else:
            if node.get("") == "exact":
                return "exact"
        if stem:
            return stem
        if self.least <= len(word) <= self.most and (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)) and self.within_one(word):
            return "fuzzy"
        return None

    def within_one(self, word: str) -> bool:
        """Whether the Levenshtein automaton of one edit for ``word`` and the trie accept a common term of ``FUZZY``
        letters or more. States: (trie node, letters read, edits, letters of the term)."""
        stack = [(self.root, 0, 0, 0)]
        n = len(word)
        while stack:
            node, i, edits, depth = stack.pop()
            if node.get("") == "exact" and depth >= FUZZY and n - i + edits <= 1:
                return True
            if i < n and (below := node.get(word[i])) is not None:
                stack.append((below, i + 1, edits, depth + 1))
            if not edits:
                for c, below in node.items():
                    if c:
                        stack.append((below, i, 1, depth + 1))  # a letter of the term is missing
                        if i < n and c != word[i]:
                            stack.append((below, i + 1, 1, depth + 1))  # a wrong letter
                if i < n:
                    stack.append((node, i + 1, 1, depth))  # a letter too many
        return False


def context(text: str, start: int, end: int) -> tuple[bool, bool]:
    """(quoted, addressed): whether a hit stands in quotation marks or after a word of reporting, and whether its window
    addresses someone."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    near = set(_WORD.findall(left)[-4:])
    quote = bool(near & REPORTS) or (_marks(text, max(0, start - WINDOW), start) % 2 == 1 and _marks(text, end, min(len(text), end + WINDOW)) > 0)
    return quote, bool((near | set(_WORD.findall(right)[:4])) & ADDRESS)


def _marks(text: str, start: int, end: int) -> int:
    """Quotation marks of a stretch, judged with the characters about it."""
    return sum(m.start() < end for m in _QUOTE.finditer(text, start, min(len(text), end + 1)))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """ln(1 + hits) by kind, plain and quoted; ln(1 + hits that address someone); hits by words."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    plain, quote, addressed, total = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0), 0, 0
    if any(map(lexicon.kind, set(words))):
        for m in _WORD.finditer(low):
            kind = lexicon.kind(m[0])
            if kind:
                q, a = context(low, m.start(), m.end())
                (quote if q else plain)[kind] += 1
                addressed += a and not q
                total += not q
    return [*(math.log1p(plain[k]) for k in KINDS), *(math.log1p(quote[k]) for k in KINDS), math.log1p(addressed), min(1.0, 10 * total / max(10, len(words)))]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * 8)
    bias: float = 0.0
    constant: float | None = 0.0

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        z = np.array(rows).reshape(len(rows), len(self.weights)) @ np.array(self.weights) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_train_rows: int) -> DataFrame:
    """(text, label) of the rows to learn from, at most about ``max_train_rows``."""
    own = labels.filter(quoted(label).isNotNull() & quoted(doc_id).isNotNull()).groupBy(quoted(doc_id).cast("long").alias("id")).agg(F.max(quoted(label).cast("int")).alias("label"))
    own = own.filter(~held_out(F.col("id")))
    total = own.count()
    if total > max_train_rows:
        own = own.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_train_rows / total))
    texts = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text"))
    return texts.join(F.broadcast(own), "id").select("text", "label")  # at most about max_train_rows rows of two numbers


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): documents of each class with a word, or with a longer word that begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            marks, at = batch.column(1).to_pylist(), 0
            for texts in slices(batch.column(0)):
                for t in texts:
                    words = set(_WORD.findall((t or "").lower()))
                    found = {(w, False) for w in words if 3 <= len(w) <= 40} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}
                    for x in found:
                        counts.setdefault(x, [0, 0])[0 if marks[at] else 1] += 1
                    at += 1
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    parts = rows.mapInArrow(run, "term string, stem boolean, toxic long, clean long")
    return parts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(counts: dict) -> pa.RecordBatch:
    keys, values = list(counts), list(counts.values())
    return pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in keys], pa.string()), "stem": pa.array([k[1] for k in keys], pa.bool_()), "toxic": pa.array([v[0] for v in values], pa.int64()), "clean": pa.array([v[1] for v in values], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train_rows: int = 16_000) -> Model:
    """The model of ``labels`` (an id and 0 or 1) joined with ``docs``; rows that ``held_out`` names are not read."""
    rows, _ = store(labelled(docs, labels, doc_id, text, label, max_train_rows))
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), sum(totals.values()) - totals.get(1, 0)
    if not bad or not good:
        return Model(constant=bad / max(1, bad + good))
    t, c, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(bad + good)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen * n / ((t + c) * of))).otherwise(0.0)
    sure = 2 * (part(t, float(bad)) + part(c, float(good)))
    lean = F.log((t + 0.5) / (bad + 1.0)) - F.log((c + 0.5) / (good + 1.0))
    top = term_counts(rows).filter((F.col("toxic") >= 4)).withColumns({"sure": sure, "lean": lean}).filter((F.col("sure") >= SURE) & (F.col("lean") >= F.when(F.col("stem"), LEAN + 1).otherwise(LEAN)))
    top = top.select("term", "stem").collect()
    stems: list[str] = []
    for s in sorted({r.term for r in top if r.stem}, key=lambda s: (len(s), s)):
        if not s.startswith(tuple(stems)):
            stems.append(s)
    model = Model(terms=sorted(r.term for r in top if not r.stem), stems=stems, constant=None)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(held.value.terms, held.value.stems)
        for batch in batches:
            rows = [features(t, lexicon) for texts in slices(batch.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    # at most about max_train_rows rows of eight numbers; alike ones are counted
    seen = rows.mapInArrow(run, "x array<double>, label int").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    seen.sort(key=lambda r: (r.x, r.label))
    model.weights, model.bias = logistic(np.array([r.x for r in seen]), np.array([r.label for r in seen], float), np.array([r.n for r in seen], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> tuple[list[float], float]:
    """Weights and bias by Newton steps; the weights shrink, the bias doesn't."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink), x.T @ (n * (y - p)) - shrink * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w[:-1]], round(float(w[-1]), 9)


def scorer(model: Model, spark):
    """Arrow UDF: text -> score."""
    held = spark.sparkContext.broadcast(model)

    def make():
        lexicon = Lexicon(held.value.terms, held.value.stems)
        return lambda texts: pa.array(held.value.scores([features(t, lexicon) for t in texts]), pa.float64())

    return array_udf(make, "double")


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 where the score is 0.5 or more)."""
    kind = F.struct(scorer(model, df.sparkSession)(quoted(text)).alias("score"))
    out = with_result(df, kind, ["score"])
    kept = [quoted(c) for c in out.columns if c.lower() != "predicted"]
    return out.select(*kept, (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
