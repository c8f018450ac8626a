"""Embedders: a deterministic offline one, and the seam for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..functions.arrow import lengths, release, runs


class Embedder(Protocol):
    """A model: made once in a task, then given batches of texts; ``task`` is ``document`` or ``query``."""

    dim: int

    def embed(self, texts: list[str], task: str) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs into unit vectors; the same on every machine."""

    def __init__(self, dim: int = config.EMBED_DIM):
        self.dim = dim

    def embed(self, texts: list[str], task: str = "document") -> np.ndarray:
        from zlib import crc32

        cells: list[int] = []
        counts = []
        for text in texts:
            words = " ".join(text.lower().split()).encode().split()  # no word has ASCII white space left, and no other byte is cut at
            hashes = [*map(crc32, words)]
            hashes += map(crc32, [b" " + w for w in words[1:]], hashes[: max(0, len(words) - 1)])  # a pair goes on from its first word
            cells += hashes
            counts.append(len(hashes))
        h = np.array(cells, np.int64)
        at = h % self.dim + np.repeat(np.arange(len(texts)) * self.dim, counts)
        out = np.bincount(at, np.where(h >> 31, 1.0, -1.0), len(texts) * self.dim).astype(np.float32).reshape(len(texts), self.dim)
        size = np.sqrt((out * out).sum(1))
        out /= np.where(size > 0, size, np.float32(1))[:, None]
        return out


def embed(text: Column, make: Callable[[], Embedder] = HashEmbedder, task: str = "document", batch: int = 256) -> Column:
    """Vectors (array<float>) of a text column; null counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for column in batches:
            for first, last in runs(lengths(column)):  # each part's vectors leave the worker before the next are made
                for at in range(first, last, batch):
                    vectors = model.embed([t or "" for t in column.slice(at, min(batch, last - at)).to_pylist()], task)
                    offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
                    yield pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))
        release()

    return F.arrow_udf(run, "array<float>")(text)


def embed_query(text: str, make: Callable[[], Embedder] = HashEmbedder) -> list[float]:
    return make().embed([text], "query")[0].tolist()
