"""Helpers shared by the Arrow-backed operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import SLICE_CHARS, release, runs, slices  # noqa: F401  also imported from here

def with_result(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """``df`` plus the fields ``names`` of the struct column ``result``; a column of ``df`` that has one
    of these names (in any case) is replaced."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    hold = free_name(df, "__result")
    out = df.withColumn(hold, result)
    return out.select(*[quoted(c) for c in keep], *[F.col(hold)[n].alias(n) for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def array_udf(make: Callable[[], Callable[[list], pa.Array]], kind: str):
    """An Arrow UDF over one string column. ``make`` runs once in each task and returns the function that
    maps a list of texts to an Arrow array of as many values; batches are cut into bounded slices, and each slice's result
    leaves the worker before the next is made."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            for texts in slices(batch):
                yield work(texts)
        del work
        release()

    return F.arrow_udf(run, kind)
