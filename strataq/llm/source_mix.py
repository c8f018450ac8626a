"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are summed into cells (source, language, topic). Raking multiplies the cells by target / current for one
margin after the other until source, language and topic shares all meet their targets; the ratio of a raked cell to its
tokens is the probability with which its documents are sampled. No probability passes 1: a cell counts with its tokens at
most, and a factor is that which meets the target with the full cells held (a Newton step on a concave sum), so the other
cells take over what a full cell can't give, and the budget is met. A value whose target is more than all its tokens is kept
whole, and the other values of its margin share the rest in their proportions. Raking ends when every margin is within
``SETTLED`` of its targets, relatively, or after ``ROUNDS`` rounds (where targets contradict each other); ``report`` gives
target, wanted and achieved shares.

Only the cell table is raked, and only margins, aggregated by partial sums, travel: they are broadcast up to ``FEW`` values, which
are counted first; a table of ``FEW`` cells or less is one partition, which needs no shuffle at all. The corpus is read twice, never sorted, and its hot source is summed before any shuffle.

Targets: a margin's target shares are its token shares to the power ``temper`` (1 keeps them, 0 makes them equal), or
shares given by value in ``targets`` (values that are not named get nothing).

Defined cases: null and empty categories are one category, ''; null text weighs one token, as does an empty one; a
budget above all tokens that have a target keeps them all; equal ids share their fate, repeated rows too; texts are taken
whole, however long; an empty table gives no rows. Other columns pass through; one that is named like an output (``__source``,
``__lang``, ``__topic``, ``__tokens``, ``__p``, in any case) is replaced. Sampling compares the probability with a uniform
number made from the id alone (or the text, without an id), so it is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import free_name, quoted
from .shared import remove, store

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
#: Rounds of raking at most, and the relative error of the margins at which it ends.
ROUNDS, SETTLED = 100, 1e-9
#: Rounds in one plan where the cells are one partition; the cells are stored between.
ROUNDS_A_JOB = 5
#: Values of a margin that are broadcast at most, and cells that are one partition at most.
FEW = 50_000
OUTPUT = ("__source", "__lang", "__topic", "__tokens", "__p")


def tokens(text: Column) -> Column:
    """Four characters to a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.expr("1L") * F.floor((F.coalesce(F.length(text), F.lit(0)) + 3) / 4)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from what a text holds; the first that fits."""
    return (
        F.when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("rights reserved")), "licence")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+1 (")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.length(text) < 1000, "note")
        .otherwise("article")
    )


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


class Margins:
    """The margins of a cell table, and which of them have few values."""

    def __init__(self, cells: DataFrame):
        row = cells.agg(F.count(F.lit(1)).alias("cells"), *[F.count_distinct(m).alias(m) for m in MARGINS]).first()
        self.few = {m: row[m] <= FEW for m in MARGINS}
        self.together = row.cells <= FEW

    def laid(self, cells: DataFrame) -> DataFrame:
        return cells.coalesce(1) if self.together else cells

    def attach(self, cells: DataFrame, m: str, **sums: Column) -> DataFrame:
        """``cells`` with sums over the cells of each value of a margin."""
        if self.together:
            return cells.withColumns({name: c.over(Window.partitionBy(m)) for name, c in sums.items()})
        table = cells.groupBy(m).agg(*[c.alias(name) for name, c in sums.items()])
        return cells.join(F.broadcast(table) if self.few[m] else table, m)


def with_goals(cells: DataFrame, margins: Margins, temper: dict[str, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` with ``all_`` (tokens of the value) and ``goal_`` (its target share) for each margin."""
    targets = targets or {}
    for m in MARGINS:
        cells = margins.attach(cells, m, **{f"all_{m}": F.sum(F.col("n_tokens").cast("double"))})
        if m in targets:
            total = sum(targets[m].values())
            goal = F.coalesce(*[F.when(F.col(m) == v, F.lit(s / total)) for v, s in targets[m].items()], F.lit(0.0))
        else:
            powers = cells.groupBy(m).agg(F.first(f"all_{m}").alias("t")).agg(F.sum(F.pow("t", F.lit(temper[m])))).first()[0] or 1.0
            goal = F.pow(f"all_{m}", F.lit(temper[m])) / F.lit(powers)
        cells = cells.withColumn(f"goal_{m}", goal)
    return cells


def level(cells: DataFrame, m: str, budget: float) -> float:
    """The factor at which the sum of least(tokens, factor x goal) over a margin's values is ``budget``.

    With the values that are full at a factor held, the others give the next one; it only rises, until no more are full."""
    values = cells.groupBy(m).agg(F.first(f"all_{m}").alias("most"), F.first(f"goal_{m}").alias("goal")).filter("goal > 0")
    factor = 0.0
    while True:
        full = F.col("most") <= F.lit(factor) * F.col("goal")
        row = values.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("goal"))).alias("open")).first()
        if not row.open:
            return max(factor, 1e300)
        after = (budget - row.held) / row.open
        if after <= factor * (1 + 1e-15):
            return factor
        factor = after


def fitted(cells: DataFrame, margins: Margins, most: Column, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``part``, raked from their ``part`` until least(``most``, part) meets ``to_`` in each margin."""
    spark = cells.sparkSession
    now, path = store(cells)
    now = margins.laid(now)
    done = 0
    while done < rounds:
        steps = min(rounds - done, ROUNDS_A_JOB if margins.together else 1)
        done += steps
        for m in MARGINS * steps:
            full = F.col("part") >= most
            sums = {"__held": F.sum(F.when(full, most).otherwise(0.0)), "__open": F.sum(F.when(full, 0.0).otherwise(F.col("part")))}
            to = F.col(f"to_{m}")
            step = F.when((to > F.col("__held")) & (F.col("__open") > 0), (to - F.col("__held")) / F.col("__open")).otherwise(to / (F.col("__held") + F.col("__open")))
            now = margins.attach(now, m, **sums).withColumn("part", F.col("part") * step).drop("__held", "__open")
        now, new_path = store(now)
        now = margins.laid(now)
        remove(spark, path)
        path = new_path
        off = [now.groupBy(m).agg((F.abs(F.sum(F.least(most, "part")) / F.first(f"to_{m}") - 1)).alias("e")).select("e") for m in MARGINS]
        if (off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("e")).first()[0] or 0.0) < SETTLED:
            break
    return now


def rake(cells: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the margins and n_tokens) with ``weight``: shares of all tokens (they sum to 1) that meet the margins' targets, however
    few tokens a cell has; and ``goal_`` and the margin's name."""
    margins = Margins(cells)
    goals, _ = store(with_goals(margins.laid(cells), margins, temper, targets))
    open_ = goals.filter(" and ".join(f"goal_{m} > 0" for m in MARGINS)).withColumn("part", F.col("n_tokens").cast("double"))
    done = fitted(open_.withColumns({f"to_{m}": F.col(f"goal_{m}") for m in MARGINS}), margins, F.lit(float("inf")), rounds)
    total = done.agg(F.sum("part")).first()[0] or 1.0
    columns = [*MARGINS, "n_tokens", "weight", *[f"goal_{m}" for m in MARGINS]]
    none = goals.filter(" or ".join(f"goal_{m} <= 0" for m in MARGINS)).withColumn("weight", F.lit(0.0))
    return done.withColumn("weight", F.col("part") / F.lit(total)).select(*columns).unionByName(none.select(*columns))


def rates(cells: DataFrame, fraction: float, temper: dict[str, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (the margins and n_tokens) that have a target, with ``goal_`` and ``share_`` (target and wanted share: the
    target as far as the value has tokens) of each margin, and ``p``, the probability of their documents."""
    cells, path = store(cells)
    margins = Margins(cells)
    goals, goals_path = store(with_goals(margins.laid(cells), margins, temper, targets))
    goals = margins.laid(goals)
    open_ = goals.filter(" and ".join(f"goal_{m} > 0" for m in MARGINS))
    budget = fraction * (goals.agg(F.sum("n_tokens")).first()[0] or 0)
    budget = float(min(budget, open_.agg(F.sum("n_tokens")).first()[0] or 0))
    for m in MARGINS:  # tokens of cells without a target don't count
        open_ = margins.attach(open_.drop(f"all_{m}"), m, **{f"all_{m}": F.sum(F.col("n_tokens").cast("double"))})
    open_, open_path = store(open_)
    open_ = margins.laid(open_)
    wanted = {f"to_{m}": F.least(f"all_{m}", F.lit(level(open_, m, budget)) * F.col(f"goal_{m}")) for m in MARGINS} if budget else {f"to_{m}": F.lit(0.0) for m in MARGINS}
    most = F.col("n_tokens").cast("double")
    done = fitted(open_.withColumns(wanted).withColumn("part", most), margins, most) if budget else open_.withColumns(wanted).withColumn("part", F.lit(0.0))
    shares = [(F.col(f"to_{m}") / F.lit(budget or 1.0)).alias(f"share_{m}") for m in MARGINS]
    out, _ = store(done.select(*MARGINS, "n_tokens", *[f"goal_{m}" for m in MARGINS], *shares, F.round(F.least(F.lit(1.0), F.col("part") / F.col("n_tokens")), 9).alias("p")))
    for p in (path, goals_path, open_path):
        remove(cells.sparkSession, p)
    return out


def report(rated: DataFrame) -> DataFrame:
    """(margin, value, target, wanted, achieved): shares of the expected tokens of ``rates``' cells; a value without any has no
    row. ``achieved`` less ``wanted`` is the residual of the raking."""
    kept = F.col("n_tokens") * F.col("p")
    total = rated.agg(F.sum(kept)).first()[0] or 1.0
    parts = [rated.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"goal_{m}").alias("target"), F.first(f"share_{m}").alias("wanted"), (F.sum(kept) / F.lit(total)).alias("achieved")) for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cell_table(rows: DataFrame) -> DataFrame:
    """The cells of ``categorised`` rows."""
    return rows.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__tokens").alias("n_tokens"))


def categorised(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic_of: Column | None = None, *more: Column) -> DataFrame:
    """``df`` with ``__source``, ``__lang``, ``__topic`` and ``__tokens`` (and ``more``) in place of columns of such names."""
    kinds = {"source": quoted(source), "lang": quoted(lang), "topic": topic(quoted(text)) if topic_of is None else topic_of}
    kept = [quoted(c) for c in df.columns if c.lower() not in OUTPUT]
    return df.select(*kept, *[F.coalesce(v.cast("string"), F.lit("")).alias(f"__{k}") for k, v in kinds.items()], tokens(quoted(text)).alias("__tokens"), *more)


def mix(df: DataFrame, fraction: float = 0.5, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The sampled rows of ``df``, with ``__source``, ``__lang``, ``__topic``, ``__tokens`` and ``__p``, their probability.

    ``fraction`` of all tokens is expected, with source, language and topic shares at their targets as far as the values have the
    tokens for it."""
    rated = rates(cell_table(categorised(df, text, source, lang)), fraction, temper or TEMPER, targets)
    draw = free_name(df, "__draw")
    rows = categorised(df, text, source, lang, None, uniform(quoted(doc_id), quoted(text)).alias(draw))
    joined = rows.join(rated.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("p").alias("__p")), [f"__{m}" for m in MARGINS])
    kept = joined.filter(F.col(draw) < F.col("__p"))
    return kept.select(*[quoted(c) for c in df.columns if c.lower() not in OUTPUT], *OUTPUT)
