"""Embedding near-duplicates by int8 quantised tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale and the exact norm of the quantisation error of each. A tile is a
product of two blocks of such vectors (whole numbers below 2**24, so float32 holds them exactly). With
x = s q + e, |x.y - s_x s_y q_x.q_y| <= |e_x| + |e_y| (1 + |e_x|), so only pairs whose product comes within that of
the threshold are recomputed in double precision. No pair at or above the threshold is lost.

Which blocks meet: every vector has a home cell, that of its nearest pivot. A pair across two cells can only be close
if the vector of the lower cell lies within the threshold's chord of the plane between the two pivots; it then visits
the higher cell as a guest. Cells are cut into blocks, so a cell that holds most vectors is many tiles, not one task.
Equal vectors are joined to one representative before; a tile emits link counts and a spanning forest, not pairs.

Facts of a vector go back to its rows by two hashes of it (128 bits), so vectors aren't shuffled again, and those of a vector
that many rows have are broadcast (at most a thousand), so its rows stay where they are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link
with nothing. Vectors of different lengths don't link. Rows that repeat an id and vector count as vectors of their own.
Vectors are taken whole, however long. An empty table gives no rows. Other columns of the input are not returned, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import quoted
from .shared import attach, components, hot_bound, store

HOME_BLOCK = 4096
GUEST_BLOCK = 16384
#: Pivots are broadcast: at most this many vectors, whatever the input.
MOST_PIVOTS = 4096
STRIP = 512
TASK = "cell long, i int, kind int, j int, side int, rep long, copies long, q binary, scale double, err double, raw binary"


def usable(vector: Column) -> Column:
    """Whether a vector can link at all."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of norm 1, in double precision, also for very large and very small components."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of what they leave over (rounded up)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return q, scale, err


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


def visits(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of every block membership of unit vectors."""
    sims = x @ pivots.T
    home = sims.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    chord = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    close = sims[np.arange(len(x)), home][:, None] - sims <= chord * apart[home] + 1e-9
    close &= np.arange(len(pivots))[None, :] > home[:, None]
    row, cell = np.nonzero(close)
    rows = np.concatenate([np.arange(len(x)), row])
    return rows, np.concatenate([home, cell]), np.concatenate([np.zeros(len(x), np.int64), np.ones(len(row), np.int64)])


def _vectors(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of a batch's vectors by length."""
    lists = batch.column(batch.schema.get_field_index("vector"))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), n).astype(kind, copy=False)


def dedup(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = df.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(vector).alias("vector"))
    fit = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    good = rows.filter(fit)
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(7), F.col("vector")).alias("k2")]
    distinct, _ = store(good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    sizes = {r.n: r.many for r in distinct.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("many")).collect()}
    main = max(sizes, key=lambda n: (sizes[n], n), default=0)
    want = min(MOST_PIVOTS, max(1, -(-sizes.get(main, 0) // HOME_BLOCK)))
    chosen = distinct.filter(F.size("vector") == main).orderBy(F.xxhash64("rep"), "rep").limit(want).collect()
    held = spark.sparkContext.broadcast(unit(np.array([r.vector for r in chosen])) if chosen else None)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at, raw in _vectors(batch, kind):
            x = unit(raw)
            if raw.shape[1] == main:
                row, cell, guest = visits(x, held.value, threshold)
            else:  # one cell for each other length
                row, cell, guest = np.arange(len(at)), np.full(len(at), -raw.shape[1]), np.zeros(len(at), np.int64)
            yield at, raw, x, row, cell, guest

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for *_, cell, guest in placed(batch):
                pairs, n = np.unique(np.stack([cell, guest]), axis=1, return_counts=True)
                for c, g, k in zip(*pairs.tolist(), n.tolist()):
                    total[c, g] = total.get((c, g), 0) + k
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([k[0] for k in keys], pa.int64()), "guest": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([total[k] for k in keys], pa.int64())})

    counted = distinct.select("rep", "copies", "vector").mapInArrow(tally, "cell long, guest int, n long").groupBy("cell", "guest").agg(F.sum("n").alias("n"))
    blocks: dict[int, list[int]] = {}
    for r in counted.collect():  # at most two rows for each pivot and vector length
        blocks.setdefault(r.cell, [0, 0])[r.guest] = -(-r.n // (GUEST_BLOCK if r.guest else HOME_BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                reps, copies = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("rep", "copies"))
                for at, raw, x, row, cell, guest in placed(batch):
                    q, scale, err = quantise(x)
                    n_home, n_guest = np.array([blocks[c] for c in cell.tolist()], np.int64).reshape(-1, 2).T
                    mine = (_mix(reps[at][row]) % np.maximum(1, np.where(guest == 1, n_guest, n_home)).astype(np.uint64)).astype(np.int64)
                    times = np.where(guest == 1, n_home, n_home + n_guest)
                    each = np.repeat(np.arange(len(row)), times)
                    k = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                    g, b, h = guest[each] == 1, mine[each], n_home[each]
                    with_guest = g | (k >= h)
                    i = np.where(g, k, np.where(with_guest, b, np.minimum(b, k)))
                    j = np.where(g, b, np.where(with_guest, k - h, np.maximum(b, k)))
                    side = np.where(g, 1, np.where(with_guest, 0, (k < b).astype(np.int64)))
                    take = row[each]
                    q_bytes, raw_bytes = [v.tobytes() for v in q], [v.tobytes() for v in raw]
                    taken = take.tolist()
                    yield pa.RecordBatch.from_pydict({
                        "cell": cell[each].astype(np.int64), "i": i.astype(np.int32), "kind": with_guest.astype(np.int32), "j": j.astype(np.int32), "side": side.astype(np.int32),
                        "rep": reps[at][take], "copies": copies[at][take], "q": pa.array([q_bytes[t] for t in taken], pa.binary()), "scale": scale[take], "err": err[take], "raw": pa.array([raw_bytes[t] for t in taken], pa.binary()),
                    })

    def tile(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = table["kind"][0].as_py() == 0 and table["i"][0].as_py() == table["j"][0].as_py()
        reps, copies, scale, err = (table[n].to_numpy() for n in ("rep", "copies", "scale", "err"))
        q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(len(reps), -1)
        raw = np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(len(reps), -1)
        links, root = tile_links(q, scale, err, raw, copies, left, left if alone else right, alone, threshold)
        one, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(reps)))
        return pa.table({
            "a": pa.array(np.concatenate([reps[one], reps[joined]]), pa.int64()),
            "b": pa.array([None] * len(one) + reps[root[joined]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([links[one], np.zeros(len(joined), np.int64)]), pa.int64()),
        })

    tasks = distinct.select("rep", "copies", "vector").mapInArrow(deal, TASK)
    found, _ = store(tasks.groupBy("cell", "i", "kind", "j").applyInArrow(tile, "a long, b long, n long"))
    groups = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    facts = distinct.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select(*keys, "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = attach(good.select("vec_id", *keys), facts, ["k1", "k2"], "copies", hot_bound(good.count())).select("vec_id", "n_links", "component_id")
    lone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def tile_links(q, scale, err, raw, copies, left, right, alone, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of links of each row of a tile, and the first row (index) of its connected part."""
    n = len(q)
    links, root = np.zeros(n, np.int64), np.arange(n)
    if not len(left) or not len(right):
        return links, root
    exact = unit(raw)
    qr = q[right].astype(np.float32).T.copy()
    worst = err.max()
    least = threshold - worst - worst * (1 + worst) - 1e-9
    for start in range(0, len(left), STRIP):
        rows = left[start : start + STRIP]
        product = q[rows].astype(np.float32) @ qr
        # whole numbers, exact in float32; a first cut by the largest scales, then each pair's own bound
        cut = least / (scale[rows].max() * scale[right].max())
        p, c = np.divmod(np.flatnonzero(product.ravel() >= np.float32(cut * (1 - 1e-6) if cut > 0 else cut * (1 + 1e-6))), len(right))
        if alone:
            ahead = c > p + start
            p, c = p[ahead], c[ahead]
        value = product[p, c].astype(np.float64) * scale[rows[p]] * scale[right[c]]
        a, b = rows[p], right[c]
        near = value >= threshold - err[a] - err[b] * (1 + err[a]) - 1e-9
        a, b = a[near], b[near]
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            hit = np.einsum("ij,ij->i", exact[x], exact[y]) >= threshold
            x, y = x[hit], y[hit]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            while True:
                rx, ry = root[x], root[y]
                differ = rx != ry
                if not differ.any():
                    break
                np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
                while (root[root] != root).any():
                    root = root[root]
    return links, root
