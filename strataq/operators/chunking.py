"""Chunking: fixed word windows, recursive separators, sentence groups."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import config
from ..functions import text as tx
from ..functions.arrow import lengths, release, runs, slices
from .pages import page_of

CHUNK = "struct<chunk_index:int,text:string,char_start:int,char_end:int>"

#: Abbreviations whose dot doesn't end a sentence, in the order in which they are looked for.
ABBREVIATIONS = ("Dr.", "Prof.", "Fig.", "Tab.", "Eq.", "et al.", "e.g.", "i.e.", "vs.", "approx.", "No.", "Vol.", "p.", "pp.", "ibid.")


def _exploded(df: DataFrame, chunks: Column, text: str, pages: str | None) -> DataFrame:
    """One row per chunk, with tokens and, where ``pages`` names an array of pages, page_start and page_end. The outer form with a
    filter after it: of the inner one the optimizer makes a filter on the array before it, which computes the array again."""
    keep = [c for c in df.columns if c != text]
    out = df.withColumn("__c", F.explode_outer(chunks)).filter(F.col("__c").isNotNull()).select(*keep, "__c.*").withColumn("token_count", tx.estimate_tokens(F.col("text")))
    if pages:
        out = out.withColumns({"page_start": page_of(F.col("char_start"), F.col(pages)), "page_end": page_of(F.col("char_end"), F.col(pages))}).drop(pages)
    return out


def fixed_step(size: int | Column, overlap: int | Column) -> int | Column:
    if isinstance(size, Column) or isinstance(overlap, Column):
        return F.greatest(F.lit(1), F.lit(size) - F.least(F.lit(overlap), F.floor(F.lit(size) / 2).cast("int")))
    return max(1, size - min(overlap, size // 2))


def fixed(df: DataFrame, text: str = "text", size: int | Column = config.CHUNK_SIZE, overlap: int | Column = config.CHUNK_OVERLAP, pages: str | None = None, offsets: bool = True) -> DataFrame:
    """Windows of ``size`` words that start every ``size - overlap`` words (numbers, or int columns with a row's own); a text
    without words gives none.

    Native, and a window is made before rows are exploded, so a row never carries its whole text. A window's offset is
    that of its first word, where words are set apart by spaces, tabs and line ends; a word that only other white space
    sets apart has none of its own, and the offset is 0 beyond the last."""
    step = fixed_step(size, overlap)
    body = F.regexp_replace(F.col(text), r"^[ \t\n]+", "")
    gap = r"[ \t\n]+"

    def starts(bare: Column) -> Column:
        """Offsets of every ``step``-th word: running sums of block lengths, words and the gaps after them."""
        zipped = F.arrays_zip(F.filter(F.split(bare, gap), lambda w: w != "").alias("w"), F.regexp_extract_all(bare, F.lit(gap), F.lit(0)).alias("s"))
        each = F.transform(zipped, lambda x: F.length(F.coalesce(x.w, F.lit(""))) + F.length(F.coalesce(x.s, F.lit(""))))

        def blocks(p: Column) -> Column:
            return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / step).cast("int")), lambda k: F.aggregate(F.slice(p, k * step + 1, F.lit(step)), F.lit(0), lambda t, x: t + x)))

        return let(each, blocks)

    def windows(w: Column, lead: Column, known: Column) -> Column:
        def window(k: Column) -> Column:
            shown = F.array_join(F.slice(w, k * step + 1, F.lit(size)), " ")
            start = F.lit(None).cast("int")
            if offsets:
                start = F.when(k < F.size(known), lead + F.aggregate(F.slice(known, F.lit(1), k), F.lit(0), lambda t, x: t + x)).otherwise(0)
            return F.struct(k.cast("int").alias("chunk_index"), shown.alias("text"), start.cast("int").alias("char_start"))

        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / step).cast("int")), window))

    if offsets:
        made = let(body, lambda bare: let(F.struct(tx.words(F.col(text)).alias("w"), (F.length(text) - F.length(bare)).alias("lead"), starts(bare).alias("b")), lambda v: windows(v.w, v.lead, v.b)))
    else:
        made = let(tx.words(F.col(text)), lambda w: windows(w, F.lit(0), F.array()))
    ended = F.transform(made, lambda c: F.struct(c.chunk_index, c.text, c.char_start, (c.char_start + F.length(c.text)).cast("int").alias("char_end")))
    out = _exploded(df, ended.cast(f"array<{CHUNK}>"), text, pages)
    return out if offsets else out.drop("char_start", "char_end")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable, where the optimizer would copy a column's expression into
    every use."""
    return F.transform(F.array(value), body)[0]


# --- recursive -------------------------------------------------------------------------------------------------------


def _cut(pattern: str, size: int):
    """The parts of a piece that is too long, stripped and not blank; else the piece as it is."""

    def cut(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, pattern), tx.strip), lambda x: x != "")
        return F.when(tx.estimate_tokens(p) <= size, F.array(p)).otherwise(parts)

    return cut


def recursive_pieces(text: Column, size: int, separators: tuple[str, ...] = config.SEPARATORS) -> Column:
    """Pieces of at most ``size`` tokens as far as the separators go; one level of splitting for each separator."""
    pieces = F.array(text)
    for sep in separators:
        pieces = F.flatten(F.transform(pieces, _cut(r"\Q" + sep + r"\E", size)))
    return pieces


def merge_pieces(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks of whole pieces up to ``size`` tokens; each begins with the last ``overlap`` words of the one before
    (none where it is 0)."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def tail(text: Column) -> Column:
        if not overlap:
            return F.lit("")
        words = tx.words(text)
        return F.when(F.size(words) > overlap, F.array_join(F.slice(words, -overlap, F.lit(overlap)), " ")).otherwise(text)

    def add(s: Column, p: Column) -> Column:
        n = tx.estimate_tokens(p)
        closed = let(tail(s.cur), lambda t: F.struct(F.concat(s.out, F.array(s.cur)).alias("out"), F.concat_ws(" ", F.nullif(t, F.lit("")), p).alias("cur"), (tx.estimate_tokens(t) + n).alias("n")))
        longer = F.struct(s.out.alias("out"), F.concat_ws(" ", s.cur, p).alias("cur"), (s.n + n).alias("n"))
        return F.when(s.cur.isNotNull() & (s.n + n > size), closed).otherwise(longer)

    return F.aggregate(pieces, start, add, lambda s: F.filter(F.when(s.cur.isNull(), s.out).otherwise(F.concat(s.out, F.array(s.cur))), lambda c: tx.strip(c) != ""))


def place_chunks(text: Column, chunks: Column) -> Column:
    """Chunks with offsets by search from a cursor that moves one past each start; a miss starts at the cursor."""
    start = F.struct(F.array().cast(f"array<{CHUNK}>").alias("out"), F.lit(0).alias("at"))

    def add(s: Column, c: Column) -> Column:
        found = F.call_function("locate", c, text, s.at + 1) - 1
        begin = F.when(found >= 0, found).otherwise(s.at)
        one = F.struct(F.size(s.out).alias("chunk_index"), tx.strip(c).alias("text"), begin.cast("int").alias("char_start"), (begin + F.length(c)).cast("int").alias("char_end"))
        return F.struct(F.concat(s.out, F.array(one)).cast(f"array<{CHUNK}>").alias("out"), F.greatest(s.at, begin + 1).cast("int").alias("at"))

    return F.aggregate(chunks, start, add, lambda s: s.out)


class RecursiveSplitter:
    """The rules of ``recursive_pieces``, ``merge_pieces`` and ``place_chunks`` over one text, for Arrow batches."""

    def __init__(self, size: int, overlap: int, separators: tuple[str, ...]):
        self.size, self.overlap, self.separators = size, overlap, separators

    @staticmethod
    def tokens(text: str) -> int:
        return max(1, len(text) >> 2)

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """Where the pieces stand in the text: splitting and stripping leave each a part of it."""
        done: list[tuple[int, int]] = []
        todo = [(0, len(text), 0)]  # a stack in reading order: no recursion, however deep the separators go
        while todo:
            start, end, level = todo.pop()
            if level == len(self.separators) or self.tokens(text[start:end]) <= self.size:
                done.append((start, end))
                continue
            parts, separator = [], self.separators[level]
            while start <= end:
                cut = text.find(separator, start, end)
                stop = end if cut < 0 else cut
                part = text[start:stop]
                bare = part.lstrip()
                if bare:
                    begin = start + len(part) - len(bare)
                    parts.append((begin, begin + len(bare.rstrip()), level + 1))
                if cut < 0:
                    break
                start = cut + len(separator)
            todo.extend(reversed(parts))
        return done

    def chunks(self, text: str) -> list[tuple[str, int, int]]:
        """Each chunk with the start of its first word and the end of its last word in the text."""
        out: list[tuple[str, int, int]] = []
        held: list[str] = []
        spots: list[tuple[int, int]] = []
        total = 0

        def close() -> str:
            chunk = " ".join(held)
            if spots:
                out.append((chunk, spots[0][0], spots[-1][1]))
            return chunk

        for start, end in self.pieces(text):
            piece = text[start:end]
            n = self.tokens(piece)
            if held and total + n > self.size:
                chunk = close()
                if len(spots) > self.overlap:
                    spots = spots[len(spots) - self.overlap :]
                    chunk = " ".join(chunk.split()[-self.overlap :]) if self.overlap else ""
                held, total = [chunk] if chunk else [], self.tokens(chunk)
            held.append(piece)
            spots = spots + [(start + m.start(), start + m.end()) for m in _WORD.finditer(piece)]
            total += n
        if held:
            close()
        return out

    def placed(self, text: str, exact: bool = False) -> list[tuple[str, int, int]]:
        """Chunks with offsets: by search from a cursor, or (``exact``) those that were carried along."""
        out, cursor = [], 0
        for c, begin, end in self.chunks(text):
            if not exact:
                begin = text.find(c, cursor)
                begin = cursor if begin < 0 else begin
                end = begin + len(c)
                cursor = max(cursor, begin + 1)
            out.append((c.strip(), begin, end))
        return out


_WORD = re.compile(r"\S+")


def chunk_lists(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    """An array of lists of ``CHUNK`` from the (text, start, end) of each row's chunks."""
    offsets = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
    flat = [c for r in rows for c in r]
    numbers = [np.array([k for r in rows for k in range(len(r))], np.int32), *(np.fromiter((c[j] for c in flat), np.int32, len(flat)) for j in (1, 2))]
    fields = [pa.array(numbers[0]), pa.array([c[0] for c in flat], pa.string()), pa.array(numbers[1]), pa.array(numbers[2])]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["chunk_index", "text", "char_start", "char_end"]))


def recursive(df: DataFrame, text: str = "text", size: int | Column = config.CHUNK_SIZE, overlap: int | Column = config.CHUNK_OVERLAP, separators: tuple[str, ...] = config.SEPARATORS, pages: str | None = None, engine: str = "arrow", offsets: str = "search") -> DataFrame:
    """Chunks of separator-bounded pieces. ``engine`` is ``arrow`` (an Arrow UDF, several times faster for this order-dependent
    fold) or ``native`` (higher-order functions); both give the same rows. ``offsets`` is ``search`` (a cursor search, which misses
    where joining changed the white space) or ``exact`` (Arrow only). ``size`` and ``overlap`` are numbers, or int columns with a
    row's own (Arrow only)."""
    own = isinstance(size, Column) or isinstance(overlap, Column)
    if own and engine == "native":
        raise ValueError("sizes by row need the arrow engine")
    overlap = F.least(F.lit(overlap), F.floor(F.lit(size) / 4).cast("int")) if own else min(overlap, size // 4)
    if engine == "native":
        pieces = recursive_pieces(F.col(text), size, separators)
        rows = df.withColumn("__m", merge_pieces(pieces, size, overlap)).withColumn("__made", place_chunks(F.col(text), F.col("__m"))).drop("__m")
        return _exploded(rows, F.col("__made"), text, pages).drop("__made")
    exact = offsets == "exact"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        splitter = RecursiveSplitter(size, overlap, tuple(separators))
        for batch in batches:
            for texts in slices(batch):  # each slice's chunks leave the worker before the next are made
                yield chunk_lists([splitter.placed(t or "", exact) for t in texts])
        release()

    def run_own(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for start, end in runs(lengths(columns[0])):
                rows = zip(*(c.slice(start, end - start).to_pylist() for c in columns))
                yield chunk_lists([RecursiveSplitter(n, o, tuple(separators)).placed(t or "", exact) for t, n, o in rows])
        release()

    made = F.arrow_udf(run_own, f"array<{CHUNK}>")(F.col(text), F.lit(size), overlap) if own else F.arrow_udf(run, f"array<{CHUNK}>")(F.col(text))
    return _exploded(df.withColumn("__made", made), F.col("__made"), text, pages).drop("__made")


# --- sentences and semantic groups -----------------------------------------------------------------------------------


def sentences(text: Column, word_bounds: bool = False) -> Column:
    """Sentences of more than 15 characters: cut after ``.``, ``!`` or ``?`` before white space and a capital or digit, but not
    after an abbreviation. Abbreviations are taken at the end of any word, as their pattern has no word boundary, and come
    back as they are listed; with ``word_bounds`` only as words of their own."""
    c = text
    for k, a in enumerate(ABBREVIATIONS):
        bound = r"\b" if word_bounds else ""
        c = F.regexp_replace(c, f"(?i){bound}{re.escape(a)}", _held(k))
    parts = F.split(c, rf"(?<=[.!?]){SPACE_RUN}(?=[A-Z0-9])")

    def restore(s: Column) -> Column:
        for k, a in enumerate(ABBREVIATIONS):
            s = F.replace(s, F.lit(_held(k)), F.lit(a))
        return tx.strip(s)

    return F.filter(F.transform(parts, restore), lambda s: F.length(s) > config.MIN_SENTENCE_CHARS)


def _held(k: int) -> str:
    """A character of the private use area in place of abbreviation k."""
    return chr(0xF000 + k)


SPACE_RUN = tx.SPACE + "+"


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def breakpoint_groups(rows: DataFrame, doc: str, order: str, embedding: str = "embedding", threshold: float = config.BREAKPOINT) -> DataFrame:
    """``rows`` with ``similarity`` to the row before and ``group_id``: a new group begins where that is below the threshold."""
    w = Window.partitionBy(doc).orderBy(order)
    sim = F.when(F.lag(order).over(w).isNotNull(), cosine(F.lag(embedding).over(w), F.col(embedding)))
    out = rows.withColumn("similarity", sim).withColumn("__new", (F.col("similarity") < threshold).cast("int"))
    return out.withColumn("group_id", F.coalesce(F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")).drop("__new")


def merge_small_groups(rows: DataFrame, doc: str, order: str, group: str = "group_id", tokens: str = "token_count", least: int = config.SMALL_GROUP_TOKENS) -> DataFrame:
    """``rows`` with ``merged_id``: a group of fewer tokens joins the one before; the first never does."""
    sizes = rows.withColumn("__size", F.sum(tokens).over(Window.partitionBy(doc, group)))
    first = F.row_number().over(Window.partitionBy(doc, group).orderBy(order)) == 1
    opens = first & ((F.col("__size") >= least) & (F.col(group) > 0))
    marked = sizes.withColumn("__open", opens.cast("int"))
    run = F.sum("__open").over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("merged_id", run.cast("int")).drop("__size", "__open")


def semantic(df: DataFrame, embed, doc: str, text: str = "text", threshold: float = config.BREAKPOINT, pages: str | None = None) -> DataFrame:
    """Groups of sentences whose neighbours are alike. ``embed`` maps a text column to a column of vectors.

    Nothing is shuffled: a row's sentences stay one after the other, its other columns go with the first of them, and vectors are
    compared where they come from the model, so that no more than a part of a batch is held (with the sentences of one row)."""
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(held.alias("__row"), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    rows = rows.select(F.when(F.col("pos") == 0, F.col("__row")).alias("__row"), "pos", "sentence").withColumn("embedding", embed(F.col("sentence")))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, said, breaks, last = None, [], [], None

        def made(heads: list, lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(heads), chunk_lists(lists)], ["__row", "__made"])

        def close() -> list[tuple[str, int, int]]:
            return place_groups(row.field(place)[0].as_py() or "", merged_groups(said, breaks))

        for b in batches:
            for at in range(0, b.num_rows, SENTENCES):
                part = b.slice(at, SENTENCES)
                first = part.column(1).to_numpy() == 0
                sims, last = neighbour_cosines(part.column(3), last)
                new = sims < threshold
                heads, lists = [], []
                for k, sentence in enumerate(part.column(2).to_pylist()):
                    if first[k]:
                        if row is not None:
                            lists.append(close())
                            heads.append(row)
                        row, said, breaks = part.column(0).slice(k, 1), [], []
                    said.append(sentence)
                    breaks.append(bool(new[k]) and not first[k])
                if heads:
                    yield made(heads, lists)
            if row is not None:
                row = row.take(pa.array([0]))  # a copy, so that the batch can go
        if row is not None:
            yield made([row], [close()])
        release()

    kind = StructType([StructField("__row", df.schema), StructField("__made", ArrayType(StructType([StructField("chunk_index", IntegerType()), StructField("text", StringType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType())])))])
    out = rows.mapInArrow(run, kind).select("__row.*", "__made")
    return _exploded(out, F.col("__made"), text, pages).drop("__made")


#: Sentences whose vectors are compared at a time.
SENTENCES = 1024


def neighbour_cosines(vectors: pa.Array, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """``cosine`` of each vector with the one before (of the first with ``last``), and the last vector. NaN where one is missing or
    has nulls, which is below no threshold. Sums run from the first to the last value, as the column expression's do."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    n = int(sizes[0]) if len(sizes) else 0
    if n > 0 and (sizes == n).all() and (last is None or len(last) == n):
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        before = np.concatenate([np.full((1, n), np.nan) if last is None else last[None], x[:-1]])
        dot, size = np.cumsum(before * x, 1)[:, -1], np.sqrt(np.cumsum(x * x, 1)[:, -1])
        size = size * np.concatenate([np.sqrt(np.cumsum(before[:1] * before[:1], 1)[:, -1]), size[:-1]])
        return np.where(size == 0, 0.0, dot / np.where(size == 0, 1.0, size)), x[-1].copy()
    out = np.full(len(vectors), np.nan)
    for k, v in enumerate(vectors.to_pylist()):
        x = None if v is None else np.array([np.nan if e is None else e for e in v], np.float64)
        if x is not None and last is not None:
            m = min(len(x), len(last))
            size = math.sqrt(_summed(last * last)) * math.sqrt(_summed(x * x))
            out[k] = 0.0 if size == 0 else _summed(last[:m] * x[:m]) / size
        last = x
    return out, last


def _summed(x: np.ndarray) -> float:
    return float(np.cumsum(x)[-1]) if len(x) else 0.0


def merged_groups(said: list[str], breaks: list[bool], least: int = config.SMALL_GROUP_TOKENS) -> list[list[str]]:
    """Sentences in groups that begin at ``breaks``; a group of fewer tokens joins the one before, the first never does."""
    groups: list[list[str]] = []
    for s, new in zip(said, breaks):
        if new or not groups:
            groups.append([])
        groups[-1].append(s)
    merged = groups[:1]
    for g in groups[1:]:
        if sum(RecursiveSplitter.tokens(s) for s in g) >= least:
            merged.append(g)
        else:
            merged[-1] += g
    return merged


def place_groups(text: str, groups: list[list[str]]) -> list[tuple[str, int, int]]:
    """Joined groups with offsets: a search for the first sentence from a cursor that moves one past each start; a miss starts at it."""
    out, at = [], 0
    for g in groups:
        body, begin = " ".join(g), text.find(g[0], at)
        begin = at if begin < 0 else begin
        out.append((body.strip(), begin, begin + len(body)))
        at = max(at, begin + 1)
    return out


def by_strategy(df: DataFrame, embed, doc: str, strategy: str = "chunk_strategy", text: str = "text", size: int | Column = config.CHUNK_SIZE, overlap: int | Column = config.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of each document by its own strategy (and, where they are columns, size and overlap); an unknown strategy is
    recursive, and semantic groups have no size."""
    own = F.lower(F.coalesce(F.col(strategy), F.lit("recursive")))
    columns = [doc, strategy, "chunk_index", "text", "char_start", "char_end", "token_count"]
    rest = df.filter(~own.isin("fixed", "semantic"))
    parts = [fixed(df.filter(own == "fixed"), text, size, overlap), semantic(df.filter(own == "semantic"), embed, doc, text), recursive(rest, text, size, overlap)]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def long_enough(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of more than 20 characters; their numbers keep their gaps."""
    return chunks.filter(F.length(tx.strip(F.col(text))) > config.MIN_CHUNK_CHARS)
