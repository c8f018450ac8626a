"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump of Lamping and Veach ("A Fast, Minimal Memory, Consistent Hash Algorithm"): a key's shard follows
from the key and the number of shards alone, without a ring table, and one more shard takes keys only into
itself. The 64-bit generator runs on 32-bit halves held in longs, so nothing overflows under ANSI mode.

Slots number a shard's rows from 0 without gaps. They come from counts: equal rows are counted before the
shuffle, a shard is cut into buckets by a hash, buckets get their offsets from bucket counts, and only rows
of one bucket are ever sorted together.

Defined cases: a null key counts as key 0; null values in other columns are values like others; repeated rows
share a shard and have slots of their own; texts are taken whole; an empty table gives no rows. A column named like
an output (``shard``, ``slot``, ``grown_shard``, in any case) is replaced; where it is the key or one of ``columns``,
it is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import free_name, quoted

#: Multiplier of the generator in the published algorithm, as high and low 32 bits.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Jumps tried before the exact tail: more are needed with a chance below 1e-20 at a million shards.
JUMPS = 64
#: Slots of equal rows made from one row at a time.
RUN = 10_000


def _step(high: str, low: str) -> tuple[str, str]:
    """SQL for key * MULTIPLIER + 1 modulo 2**64 on halves."""
    p0 = f"(({low} & 65535) * {LOW}L)"
    p1 = f"(shiftright({low}, 16) * {LOW}L)"
    q1 = f"(shiftright({high}, 16) * {LOW}L)"
    s = f"({p0} + shiftleft({p1} & 65535, 16) + 1L)"
    new_low = f"({s} & {MASK}L)"
    carry = f"(shiftright({s}, 32) + shiftright({p1}, 16))"
    cross = f"((({high} & 65535) * {LOW}L + shiftleft({q1} & 65535, 16)) & {MASK}L)"
    new_high = f"(({carry} + {cross} + (({low} * {HIGH}L) & {MASK}L)) & {MASK}L)"
    return new_high, new_low


def _jumps(key: str, shards: int, steps: int) -> str:
    """SQL: the state (high, low, b, j) after jumping until j reaches ``shards`` or the steps are used up."""
    h, lo = _step("s.h", "s.l")
    start = f"named_struct('h', shiftrightunsigned({key}, 32), 'l', {key} & {MASK}L, 'b', -1L, 'j', 0L)"
    moved = f"transform(array(named_struct('h', {h}, 'l', {lo}, 'b', s.j)), x -> named_struct('h', x.h, 'l', x.l, 'b', x.b, 'j', cast(floor((x.b + 1) * (2147483648D / (shiftright(x.h, 1) + 1))) as bigint)))[0]"
    return f"aggregate(sequence(1, {steps}), {start}, (s, i) -> if(s.j >= {shards}, s, {moved}))"


def jump_shard(key: str, shards: int) -> Column:
    """Shard (int, 0 to ``shards`` - 1) of a SQL expression of type bigint."""
    if not 1 <= shards <= 1 << 30:
        raise ValueError("shards must be 1 or more")
    key = f"coalesce({key}, 0L)"
    short = _jumps(key, shards, min(JUMPS, shards))
    if shards <= JUMPS:
        return F.expr(f"cast(({short}).b as int)")
    whole = _jumps(key, shards, shards)
    return F.expr(f"transform(array({short}), s -> cast(if(s.j >= {shards}, s.b, ({whole}).b) as int))[0]")


OUTPUT = ("shard", "slot", "grown_shard")


def shard_rows(df: DataFrame, key: str = "doc_id", shards: int = 8, columns: dict[str, str] | None = None, rows_per_bucket: int = 50_000) -> DataFrame:
    """The rows of ``df`` with ``shard``, ``grown_shard`` (with one more shard) and ``slot`` within its shard. With ``columns`` (name to
    SQL) rows have the key and these columns only, and others aren't read. Slots follow (bucket, key, hash, other columns)."""
    if taken := {c.lower() for c in (key, *(columns or ()))} & set(OUTPUT):
        raise ValueError(f"{sorted(taken)} would be there twice")
    if columns is None:
        rows = df.select(*[quoted(c) for c in df.columns if c.lower() not in OUTPUT])
    else:
        rows = df.select(quoted(key), *[F.expr(v).alias(n) for n, v in columns.items()])
    names = [quoted(c) for c in rows.columns]
    times, bucket, digest, sums, start, at, run = (free_name(rows, f"__{x}") for x in ("times", "bucket", "digest", "sums", "start", "at", "run"))
    equal = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(times)).withColumn(digest, F.xxhash64(*names) if columns is None else F.lit(0))
    buckets = max(1, -(-df.count() // (rows_per_bucket * shards)))
    sql = "`" + key.replace("`", "``") + "`"
    equal = equal.withColumns({"shard": jump_shard(sql, shards), "grown_shard": jump_shard(sql, shards + 1), bucket: F.pmod(F.xxhash64(*names), F.lit(buckets))})
    per = equal.groupBy("shard", bucket).agg(F.sum(times).alias(sums))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("shard", bucket, F.coalesce(F.sum(sums).over(before), F.lit(0)).alias(start))
    order = [quoted(key).asc_nulls_first(), F.col(digest), *[c.asc_nulls_first() for c in names]]
    within = Window.partitionBy("shard", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = equal.withColumn(at, F.coalesce(F.sum(times).over(within), F.lit(0))).join(starts, ["shard", bucket])
    first = F.col(start) + F.col(at)
    runs = joined.withColumn(run, F.explode(F.sequence(first, first + F.col(times) - 1, F.lit(RUN))))
    numbered = runs.withColumn("slot", F.explode(F.sequence(F.col(run), F.least(F.col(run) + RUN, first + F.col(times)) - 1)))
    return numbered.select(*names, "shard", "slot", "grown_shard")
