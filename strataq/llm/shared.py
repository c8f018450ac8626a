"""Tables in the folder that driver and executors share, joins that split hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import release

#: A key of more rows than this, and than a thousandth of all rows, is hot: at most ``HOT_KEYS`` keys are.
LEAST_HOT, HOT_KEYS = 50, 1000
#: Edges (16 MB) that one task joins to the end; more take rounds over all tasks, each of which costs the driver ten shuffles.
TREE = 1 << 20


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on one machine (a local master, as in
    tests); on a cluster, whose machines share no such folder, it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/strataq-shared"
    return named.rstrip("/")


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage; and the path."""
    spark = df.sparkSession
    path = f"{folder(spark)}/strataq-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hot_bound(total: int) -> int:
    """The most rows of a key that isn't hot among ``total`` rows: a power of two, so that plans of about equal sizes have
    equal generated code, which executors compile once."""
    return 1 << (max(LEAST_HOT, -(-total // HOT_KEYS)) - 1).bit_length()


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], times: str, bound: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row for each key), null where it has none; ``facts`` is dropped of
    ``times``, which counts a key's rows in ``rows``.

    Facts of keys with more than ``bound`` rows, of which there are ``HOT_KEYS`` at most (see ``hot_bound``), are
    broadcast, so that the rows of a hot key stay where they are; other rows are shuffled by key, few of each."""
    facts = facts.withColumn("__hot", F.col(times) > bound)
    hot = facts.filter("__hot").drop(times)
    met = rows.join(F.broadcast(hot), keys, "left")
    cold = met.filter("__hot is null").select(*rows.columns).join(facts.filter("not __hot").drop(times), keys, "left")
    return met.filter("__hot").drop("__hot").unionByName(cold.drop("__hot"))


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (lo, hi), and whether every hi has one lo that is no hi itself: stars about the smallest nodes."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("n"), F.lit(False).alias("low")).unionByName(edges.select(F.col("lo").alias("x"), F.lit(0).alias("n"), F.lit(True).alias("low")))
    nodes = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
    row = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if((F.col("n") > 1) | (F.col("low") & (F.col("n") > 0))).alias("open")).first()
    return row.n, not row.open


def stars(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (lo, hi) from the smallest node of each connected part to its others. Every root is tied to the smallest root that an
    edge leads to, until no edge leads to another; roots halve in two rounds."""
    nodes, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = ends[: len(lo)], ends[len(lo) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    others = root != np.arange(len(nodes))
    return nodes[root[others]], nodes[others]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all edges (lo, hi) of a task."""
    table = pa.Table.from_batches(batches, pa.schema([("lo", pa.int64()), ("hi", pa.int64())]))
    lo, hi = stars(table["lo"].to_numpy(), table["hi"].to_numpy())
    for at in range(0, len(lo), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(lo[at : at + 100_000]), pa.array(hi[at : at + 100_000])], ["lo", "hi"])
    del table, lo, hi
    release()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a and b, longs): component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. ("Connected Components in MapReduce and
    Beyond") as aggregations and joins until only stars about smallest nodes are left; each round is stored in the shared
    folder and the round before removed. With edges as (lo, hi), the large step moves an edge's lower end to that end's own
    smallest neighbour, the small step ties the lower ends of a node to the smallest of them; a node of many edges is
    met by broadcast (``attach``), and a node that has only one lower end is left out. As soon as ``TREE`` edges or fewer are
    left, one task joins them to the end. Nulls and loops are dropped."""
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    now, path = store(ordered)
    for _ in range(most_rounds):
        total, settled = _settled(now)
        if settled:
            break
        if total <= TREE:
            now, _ = store(now.coalesce(1).mapInArrow(_joined, "lo long, hi long"))
            remove(spark, path)
            break
        bound = hot_bound(total)
        below = now.select(F.col("hi").alias("lo"), F.col("lo").alias("m"), F.lit(0).alias("n"))
        above = now.select("lo", F.lit(None).cast("long").alias("m"), F.lit(1).alias("n"))
        ends = below.unionByName(above).groupBy("lo").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
        moved = attach(now, ends.filter((F.col("n") > bound) | (F.col("m").isNotNull() & (F.col("n") > 0))), ["lo"], "n", bound)
        large = moved.select(F.coalesce("m", "lo").alias("lo"), "hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        met = attach(large, low.filter("n > 1"), ["hi"], "n", bound)
        small = met.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct()
        now, new_path = store(small)
        remove(spark, path)
        path = new_path
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
