"""Vector tables: scopes, exact top-k search, upserts, deletes, completeness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .chunking import norm


def collection_name(document: Column, user: Column, strategy: str = "per_document") -> Column:
    """Name of the partition that holds a chunk's vector."""
    if strategy == "per_document":
        return F.when(document.isNotNull(), F.concat(F.lit("doc_"), F.replace(document.cast("string"), F.lit("-"), F.lit("")))).otherwise(config.GLOBAL_COLLECTION)
    if strategy == "per_user":
        return F.when(user.isNotNull(), F.concat(F.lit("user_"), user.cast("string"))).otherwise(config.GLOBAL_COLLECTION)
    if strategy not in config.COLLECTION_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.lit(config.GLOBAL_COLLECTION)


def scope(vectors: DataFrame, document=None, document_ids=None, user=None, doc: str = "document_id", owner: str = "user_id") -> DataFrame:
    """The vectors that a search may see: one document, else some documents, else all; of one user where given. Plain
    equality and IN filters, so they reach the scan and prune partitions."""
    if user is not None and owner in vectors.columns:
        vectors = vectors.filter(F.col(owner) == user)
    if document is not None:
        return vectors.filter(F.col(doc) == document)
    if document_ids:
        ids = list(document_ids)
        return vectors.filter(F.col(doc) == ids[0]) if len(ids) == 1 else vectors.filter(F.col(doc).isin(ids))
    return vectors


def similarity(embedding: Column, query: list[float], size: Column | None = None) -> Column:
    """Cosine of a column with one vector, in double precision, as a sum that the compiler unrolls into whole-stage code."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt((q * q).sum()))
    if not length:
        return F.lit(0.0)
    values = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with(embedding, values, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = norm(embedding) if size is None else size
    return F.when(size == 0, 0.0).otherwise(dot / (size * length))


def score(cos: Column) -> Column:
    """(1 + cos) / 2 to four places: 1 less half the cosine distance."""
    return F.round((1 + cos) / 2, 4)


def comparable(embedding: Column, size: int) -> Column:
    """Whether a vector can be compared with a query of this length: not null, as long, without nulls or NaN."""
    return (F.size(embedding) == size) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x))


def topk(vectors: DataFrame, query: list[float], k: int = config.RETRIEVE_K, embedding: str = "embedding", key: str = "chunk_id", size: str | None = None) -> DataFrame:
    """The k vectors nearest to a query, with ``score`` and ``rank``; ties go to the smaller key, vectors that aren't ``comparable``
    are skipped. Each task keeps k rows (TakeOrderedAndProject), so nothing else is shuffled."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    cos = similarity(F.col(embedding), query, F.col(size) if size else None)
    best = vectors.filter(comparable(F.col(embedding), len(query))).withColumn("__cos", cos).orderBy(F.desc("__cos"), key).limit(k).withColumn("score", score(F.col("__cos")))
    ranked = Window.orderBy(F.desc("__cos"), key)  # over k rows
    return best.withColumn("rank", F.row_number().over(ranked)).drop("__cos")


def clamp_k(k: int | None, default: int = config.RETRIEVE_K, most: int = config.SEARCH_K_MOST) -> int:
    k = min(k or default, most)
    if k < 1:
        raise ValueError("k must be 1 or more")
    return k


#: Queries of one broadcast; more are dealt to several, each with a scan of its own.
QUERIES = 1 << 16


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products along the last axis, added from the first to the last as the column expressions do it."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for k in range(x.shape[-1]):
        out = out + x[..., k] * y[..., k]
    return out


class _Best:
    """The best k (cosine, key) of each query of one length, over the batches of a task."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.length = q, k, np.sqrt((q * q).sum(1))
        self.cos: list[np.ndarray] = [np.empty(0)] * len(q)
        self.keys: list[list] = [[] for _ in q]

    def add(self, x: np.ndarray, keys: list, block: int) -> None:
        size = np.sqrt(_in_order(x, x))
        unit = x / np.where(size > 0, size, 1.0)[:, None]
        for at in range(0, len(self.q), block):
            q, length = self.q[at : at + block], self.length[at : at + block]
            rough = (q / np.where(length > 0, length, 1.0)[:, None]) @ unit.T
            cut = np.partition(rough, -self.k, axis=1)[:, -self.k] if len(x) > self.k else np.full(len(q), -2.0)
            held = np.array([c[-1] if len(c) >= self.k else -2.0 for c in self.cos[at : at + block]])
            row, col = np.nonzero(rough >= (np.maximum(cut, held) - 1e-9)[:, None])  # a product's last digits vary with its place
            both = size[col] * length[row]
            exact = np.where(both > 0, _in_order(x[col], q[row]) / np.where(both > 0, both, 1.0), 0.0)
            for j, start, end in zip(np.unique(row), *self.cuts(row)):
                cos = np.concatenate([self.cos[at + j], exact[start:end]])
                names = self.keys[at + j] + [keys[c] for c in col[start:end].tolist()]
                order = sorted(range(len(names)), key=lambda i: (-cos[i], names[i]))[: self.k]
                self.cos[at + j], self.keys[at + j] = cos[order], [names[i] for i in order]

    @staticmethod
    def cuts(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        return starts, np.append(starts[1:], len(row))


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int = config.RETRIEVE_K, query_id: str = "query_id", query: str = "query", embedding: str = "embedding", key: str = "chunk_id", block: int = 256) -> DataFrame:
    """(query_id, key, score, rank) for a table of queries: what ``topk`` gives for each, ties and skipped vectors included.

    The queries are a stated set that is broadcast, ``QUERIES`` at a time (their number is counted first); each task multiplies its
    Arrow batches with all of them, ``block`` at a time, in one scan, and keeps its best k of each query; only those are shuffled
    to the final rank. Null queries, or such with nulls, have no rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = vectors.sparkSession
    asked = queries.select(query_id, query).filter(comparable(F.col(query), F.size(query)))
    deals = max(1, -(-asked.count() // QUERIES))
    exact = [to_arrow_type(vectors.schema[key].dataType), to_arrow_type(queries.schema[query_id].dataType)]
    kinds = (vectors.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString())
    parts = []
    for deal in range(deals):
        rows = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(deals)) == deal).collect()
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r[1]), []).append(r)
        held = spark.sparkContext.broadcast({n: ([r[0] for r in part], np.array([r[1] for r in part], np.float64)) for n, part in by_size.items() if n})

        def run(batches, held=held):
            best = {n: _Best(q, k) for n, (_, q) in held.value.items()}
            for b in batches:
                lists = b.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for n in best:
                    at = np.flatnonzero(sizes == n)
                    if len(at):
                        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
                        fine = ~np.isnan(flat).any(1)  # a null is NaN here; as a filter before, this would embed a second time
                        if fine.any():
                            best[n].add(flat[fine], b.column(0).take(pa.array(at[fine])).to_pylist(), block)
            for n, top in best.items():
                ids = held.value[n][0]
                found = [(ids[j], name, c) for j in range(len(ids)) for name, c in zip(top.keys[j], top.cos[j].tolist())]
                yield pa.RecordBatch.from_pydict({"q": pa.array([f[0] for f in found], exact[1]), "key": pa.array([f[1] for f in found], exact[0]), "cos": pa.array([f[2] for f in found], pa.float64())})

        parts.append(vectors.select(key, embedding).mapInArrow(run, f"q {kinds[1]}, key {kinds[0]}, cos double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "key")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("key").alias(key), score(F.col("cos")).alias("score"), "rank")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, key: str = "chunk_id", doc: str = "document_id") -> DataFrame:
    """Hits with their chunk (and document); hits without a chunk go. Order: score, then rank."""
    rows = hits.join(chunks.drop(*[c for c in hits.columns if c != key and c in chunks.columns]), key)
    if documents is not None:
        rows = rows.join(documents, doc)
    return rows.orderBy(F.desc("score"), "rank")


def latest(rows: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """The row with the highest version of each key, by aggregation (partial before the shuffle), not by a window."""
    others = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(version, *ties)).alias("__r"))
    return top.select(key, "__r.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str = "chunk_id", version: str | None = None) -> DataFrame:
    """``table`` with ``changes`` in place of the rows that have their keys. Of repeated changes the last counts: the one with the
    highest ``version`` (a column of ``changes`` that isn't stored where the table lacks it), then the greatest row."""
    others = [c for c in changes.columns if c != key]
    order = F.struct(*([version] if version else []), *others)
    new = changes.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(key, "__r.*")
    if version and version not in table.columns:
        new = new.drop(version)
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_document(vectors: DataFrame, document, doc: str = "document_id") -> tuple[DataFrame, int]:
    """``vectors`` without a document's, and how many those are."""
    gone = vectors.filter(F.col(doc) == document).count()
    return vectors.filter((F.col(doc) != document) | F.col(doc).isNull()), gone


def mark_embedded(chunks: DataFrame, done: DataFrame, at: Column, model: str = config.EMBED_MODEL, key: str = "chunk_id") -> DataFrame:
    """``chunks`` with the embedded flag, time and model set for the keys of ``done``."""
    hit = done.select(key).distinct().withColumn("__done", F.lit(True))
    joined = chunks.join(hit, key, "left")
    yes = F.col("__done").isNotNull()
    return joined.withColumns({
        "is_embedded": yes | F.col("is_embedded"), "embedded_at": F.when(yes, at).otherwise(F.col("embedded_at")), "embedding_model": F.when(yes, F.lit(model)).otherwise(F.col("embedding_model")),
    }).select(*chunks.columns)


def completeness(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, id: str = "id", doc: str = "document_id") -> DataFrame:
    """Ready documents with chunk_count, embedded_chunks, vector_count and whether all are indexed."""
    c = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if("is_embedded").alias("embedded_chunks"))
    v = vectors.groupBy(doc).agg(F.count(F.lit(1)).alias("vector_count"))
    ready = documents.filter(F.col("status") == "ready").withColumnRenamed(id, doc)
    joined = ready.select(doc).join(c, doc, "left").join(v, doc, "left").na.fill(0, ["chunk_count", "embedded_chunks", "vector_count"])
    return joined.withColumn("fully_indexed", F.col("vector_count") == F.col("chunk_count"))


def unembedded(documents: DataFrame, chunks: DataFrame, force: bool = False, id: str = "id", doc: str = "document_id") -> DataFrame:
    """Documents with a chunk that has no vector yet; with ``force`` all ready ones."""
    ready = documents.filter(F.col("status") == "ready")
    if force:
        return ready
    open_ = chunks.filter(~F.col("is_embedded")).select(F.col(doc).alias(id))
    return ready.join(open_, id, "left_semi")
