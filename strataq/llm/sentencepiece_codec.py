"""SentencePiece encoding and decoding over a distinct-chunk table.

A text is escaped (spaces become the marker U+2581) and cut before every run of markers. Where no piece
of the model has a marker after another character, no piece and no merge can span such a cut, so each
distinct marked word is segmented once in a task and its ids are joined back by position.

Defined cases: null text counts as empty; an empty text has the end id alone (where one is asked for);
a text of any length is taken whole; equal texts have equal results; other columns pass through, and a
column named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import array_udf, quoted, with_result

MARK = "▁"
#: A worker's table is emptied at this many distinct chunks; results don't depend on it.
TABLE_LIMIT = 120_000


@lru_cache(maxsize=2)
def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def separable(sp) -> bool:
    """Whether pieces keep to marked words: no marker after another character, and the escaping that the
    chunk table assumes (a dummy prefix, spaces kept, no normalisation)."""
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return False
    probes = ["a", " a", "a  b ", "ﬁÅ", "  "]
    return all(sp.decode(sp.encode(p)) == p for p in probes)


class ChunkTable:
    """Distinct marked words of one task with their ids, laid out flat."""

    chunk = re.compile(" +[^ ]*")

    def __init__(self, sp, limit: int = TABLE_LIMIT):
        self.sp, self.limit, self.whole = sp, limit, not separable(sp)
        self.lone = [sp.piece_to_id(MARK)]
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.empty(0, np.int32)]
        self.lens: list[np.ndarray] = [np.empty(0, np.int64)]

    def add(self, chunks: set[str]) -> None:
        """Segments chunks that the table lacks; each starts with a space, which stands for the prefix."""
        new = list(chunks)
        found = [self.lone if c == " " else x for c, x in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1))]
        base = len(self.code)
        self.code.update(zip(new, range(base, base + len(new))))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.lens.append(lens)
        self.ids.append(np.fromiter((i for x in found for i in x), np.int32, int(lens.sum())))

    def encode(self, texts: list[str | None], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if self.whole:
            each = [self.sp.encode(t or "") + end for t in texts]
            lens = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter((i for x in each for i in x), np.int32, int(lens.sum())), lens
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                found = self.chunk.findall(" " + t.replace(MARK, " "))
                counts[k] = len(found)
                words += found
        fresh = set(words).difference(self.code)
        if len(self.code) + len(fresh) > self.limit:
            self.clear()
            fresh = set(words)
        if fresh:
            self.add(fresh)
        if len(self.ids) > 1:
            self.ids, self.lens = [np.concatenate(self.ids)], [np.concatenate(self.lens)]
        ids, lens = self.ids[0], self.lens[0]
        starts = np.cumsum(lens) - lens
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        size = lens[codes]
        past = np.cumsum(size)
        flat = ids[np.repeat(starts[codes] - (past - size), size) + np.arange(past[-1] if len(past) else 0)]
        ends = np.concatenate([[0], past])[np.cumsum(counts)] if len(texts) else np.empty(0, np.int64)
        lens = np.diff(ends, prepend=0)
        if end:
            flat = np.insert(flat, np.repeat(ends, len(end)), np.tile(np.asarray(end, np.int32), len(ends)))
        return flat.astype(np.int32, copy=False), lens + len(end)


def encoder(model: str, add_end: bool = True, limit: int = TABLE_LIMIT):
    """Arrow UDF: text -> array<int> of ids."""

    def make():
        sp = load(model)
        table, end = ChunkTable(sp, limit), [sp.eos_id()] if add_end else []

        def work(texts: list[str | None]) -> pa.Array:
            flat, lens = table.encode(texts, end)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

        return work

    return array_udf(make, "array<int>")


def decoder(model: str):
    """Arrow UDF: array<int> of ids -> text, by the library's decode; null ids give an empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = load(model)
        for batch in batches:
            parts, step = [], 256
            for at in range(0, len(batch), step):
                ids = [x or [] for x in batch.slice(at, step).to_pylist()]
                parts.append(pa.array([sp.decode(x) for x in ids], pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, "string")


def codec(model: str, add_end: bool = True):
    """Arrow UDF: text -> struct of ids and of the text that the library decodes from them, in one pass."""

    def make():
        sp = load(model)
        table, end = ChunkTable(sp), [sp.eos_id()] if add_end else []

        def work(texts: list[str | None]) -> pa.Array:
            flat, lens = table.encode(texts, end)
            offsets = np.concatenate([[0], np.cumsum(lens)])
            back = pa.array([sp.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
            return pa.StructArray.from_arrays([ids, back], ["ids", "decoded"])

        return work

    return array_udf(make, "struct<ids:array<int>,decoded:string>")


def encode_text(df: DataFrame, model: str, text: str = "text", add_end: bool = True) -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``decoded`` (the library's decode of those ids)."""
    return with_result(df, codec(model, add_end)(quoted(text)), ["ids", "decoded"])


def ids_digest(ids: Column) -> Column:
    """Hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
