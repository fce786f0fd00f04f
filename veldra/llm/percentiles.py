"""Exact percentiles per group by bisection over the ordered bits of doubles.

For each group and percentile an interval of values is kept that holds the target rank. A pass
counts the rows of each interval below its midpoints - of ``bits`` bisections at once - and narrows
the interval to the part with the target. Counts of partitions, pieces or days add up, so a pass
is one partial and one final aggregation; an interval with a single value left is resolved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldra.plans.scratch import Scratch

#: Thousandths.
PERCENTILES = (10, 50, 250, 500, 750, 900, 950, 990)
#: Bisections in a pass; a double is resolved after 64.
BITS = 13
#: Unresolved intervals sent to all tasks at once; more are met by a join that shuffles counts only.
FEW = 200_000
_GROUP = ["kind", "value_of"]


def _ordered(x: Column) -> Column:
    """A bigint that orders as the double does."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def _rows(df: DataFrame, groups: dict[str, Column], value: str) -> DataFrame:
    """kind, value_of, v, key, w: a row of weight 1 for each group that a row belongs to; null and NaN left out."""
    x = F.col(value).cast("double")
    clean = df.where(x.isNotNull() & ~F.isnan(x)).select(F.when(x == 0, 0.0).otherwise(x).alias("v"), *[g.cast("string").alias(f"g{i}") for i, g in enumerate(groups.values())])
    keyed = clean.withColumn("key", _ordered(F.col("v")))
    member = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"g{i}").alias("value_of")) for i, k in enumerate(groups)])
    return keyed.select("v", "key", F.explode(member).alias("g")).select("g.kind", "g.value_of", "v", "key", F.lit(1).cast("bigint").alias("w"))


def _counts(rows: DataFrame, part: Column, parents: list[str]) -> DataFrame:
    return rows.groupBy(*_GROUP, *parents, part.alias("part")).agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _narrow(counts: DataFrame, targets: DataFrame, parents: list[str]) -> DataFrame:
    """Each target with the part that holds its rank: part, low, high, and its rank within."""
    w = Window.partitionBy(*_GROUP, *parents).orderBy("part")
    below = counts.withColumn("upto", F.sum("n").over(w))
    hit = below.alias("c").join(targets.alias("t"), _same("c", "t", [*_GROUP, *parents]) & (F.col("t.rank") <= F.col("c.upto")) & (F.col("t.rank") > F.col("c.upto") - F.col("c.n")))
    return hit.select("t.kind", "t.value_of", "t.total", "t.pct", "t.goal", (F.col("t.rank") - F.col("c.upto") + F.col("c.n")).alias("rank"), "c.part", "c.low", "c.high")


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def exact_percentiles(df: DataFrame, groups: dict[str, Column], value: str, percentiles: Sequence[int] = PERCENTILES, bits: int = BITS, relative_error: float = 0.0, few: int = FEW) -> DataFrame:
    """``kind``, ``value_of``, ``n``, ``pct``, ``value`` for each group of each kind in ``groups``.

    ``percentiles`` are thousandths; the value is that of rank ceil(pct * n / 1000), at least 1, in
    ascending order, exact if ``relative_error`` is 0. Otherwise bisection ends as soon as an
    interval's ends differ by at most that share and its upper end is given. Null and NaN values are left out; null group
    values form a group of their own; -0.0 counts as 0.0; infinities take part. Groups without a
    value don't come out; an empty table gives no rows.
    """
    wanted = lambda totals: totals.select(*_GROUP, "total", F.explode(F.array(*[F.lit(p) for p in percentiles])).alias("pct")).withColumn("goal", F.expr(_RANK))
    return _resolve(_rows(df, groups, value), wanted, bits, relative_error, few).select(*_GROUP, F.col("total").alias("n"), "pct", F.col("high").alias("value"))


_RANK = "greatest(1L, (pct * total + 999) div 1000)"


def _resolve(rows: DataFrame, wanted, bits: int = BITS, relative_error: float = 0.0, few: int = FEW) -> DataFrame:
    """The value of each rank ``goal`` that ``wanted`` gives for the groups' total weights."""
    scratch = Scratch(rows.sparkSession, "percentiles")
    shift = 64 - bits
    counts = scratch.put(_counts(rows, F.shiftright("key", shift), []), "counts-0")
    totals = counts.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    targets = wanted(totals).withColumn("rank", F.col("goal"))
    targets = scratch.put(_narrow(counts, targets, []), "targets-0")
    scratch.drop("counts-0")
    resolved = (F.col("low") == F.col("high")) | (F.col("high") - F.col("low") <= relative_error * F.greatest(F.abs("low"), F.abs("high")))
    done, k = [targets.where(resolved)], 0
    while shift > 0:
        k += 1
        open_ = targets.where(~resolved).select(*_GROUP, "total", "pct", "goal", "rank", F.col("part").alias("within"))
        live = open_.select(*_GROUP, "within").distinct()
        n_live = live.count()
        if not n_live:
            break
        parent, shift = shift, max(0, shift - bits)
        inside = rows.withColumn("within", F.shiftright("key", parent))
        if n_live <= few:
            met = inside.alias("r").join(F.broadcast(live).alias("l"), _same("r", "l", [*_GROUP, "within"]), "left_semi").select("r.*")
            counts = _counts(met, F.shiftright("key", shift), ["within"])
        else:  # counts first, so that a hot group is a few rows of each task before it is shuffled
            every = _counts(inside, F.shiftright("key", shift), ["within"])
            counts = every.alias("r").join(live.alias("l"), _same("r", "l", [*_GROUP, "within"]), "left_semi").select("r.*")
        targets = scratch.put(_narrow(counts, open_, ["within"]), f"targets-{k}")
        done.append(targets if shift == 0 else targets.where(resolved))
    return reduce(DataFrame.unionByName, done)


def percentile_grids(df: DataFrame, groups: dict[str, Column], value: str, piece: Column, steps: int = 200) -> DataFrame:
    """A combinable summary of each piece: ``piece``, ``kind``, ``value_of``, ``n``, ``rank``, ``value``.

    For every piece and group the exact values of ranks 1 and ceil(i * n / steps), i from 1 to
    ``steps``: at most steps + 1 rows, however many rows a piece has, and all n of a smaller one.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    sep = "\u001f"
    joined = {k: F.concat(mark(piece), F.lit(sep), mark(g)) for k, g in groups.items()}
    step = F.expr(f"transform(sequence(1, {steps}), i -> (i * total + {steps - 1}) div {steps})")
    ranks = F.when(F.col("total") <= steps, F.sequence(F.lit(1).cast("bigint"), "total")).otherwise(F.array_distinct(F.concat(F.array(F.lit(1).cast("bigint")), step)))
    wanted = lambda totals: totals.select(*_GROUP, "total", F.lit(0).alias("pct"), F.explode(ranks).alias("goal"))
    grid = _resolve(_rows(df, joined, value), wanted)
    parts = F.split("value_of", sep, 2)
    clean = lambda c: F.when(c != "", F.substring(c, 2, 1 << 30))
    return grid.select(clean(parts[0]).alias("piece"), "kind", clean(parts[1]).alias("value_of"), F.col("total").alias("n"), F.col("goal").alias("rank"), F.col("high").alias("value"))


def combine_grids(grids: DataFrame, percentiles: Sequence[int] = PERCENTILES, steps: int = 200) -> DataFrame:
    """``kind``, ``value_of``, ``n``, ``pct``, ``value``, ``rank_error`` over all pieces of ``grids``.

    Between two neighbouring ranks of a piece's grid lie fewer than n / steps + 1 of its rows, and
    none if n is at most ``steps``. So ``value`` stands in the union of all pieces at a rank that
    differs from the target by at most ``rank_error``, the sum of these. Only grids are read; each of
    their rows weighs as many ranks as it is from the one before, and the weighted rows are bisected
    as any others, so a group of very many pieces is partial sums in each task.
    """
    w = Window.partitionBy("piece", *_GROUP).orderBy("rank")
    weighted = grids.select(*_GROUP, F.col("value").alias("v"), _ordered(F.col("value")).alias("key"), (F.col("rank") - F.coalesce(F.lag("rank").over(w), F.lit(0))).cast("bigint").alias("w"), "rank", "n")
    rows = Scratch(grids.sparkSession, "grids").put(weighted, "rows")
    gap = F.when(F.col("n") > steps, F.expr(f"n div {steps} + 1")).otherwise(0)
    errors = rows.where("rank = n").groupBy(*_GROUP).agg(F.sum(gap).alias("rank_error"))
    wanted = lambda totals: totals.select(*_GROUP, "total", F.explode(F.array(*[F.lit(p) for p in percentiles])).alias("pct")).withColumn("goal", F.expr(_RANK))
    found = _resolve(rows.drop("rank", "n"), wanted).alias("f")
    joined = found.join(errors.alias("e"), _same("f", "e", _GROUP))
    return joined.select("f.kind", "f.value_of", F.col("f.total").alias("n"), "f.pct", F.col("f.high").alias("value"), "e.rank_error")


def ranks_within(df: DataFrame, groups: dict[str, Column], value: str, combined: DataFrame) -> DataFrame:
    """``kind``, ``value_of``, ``n``, ``pct``, ``within``: whether combined values stand within their ``rank_error``.

    Counts the rows below and up to each value; the target rank must lie no farther from these ranks
    than ``rank_error``. A group's values are met by its rows; counts add up in each task before the shuffle.
    """
    listed = combined.withColumn("total", F.col("n")).groupBy(*_GROUP).agg(F.collect_list(F.struct("pct", "value", "total", F.expr(_RANK).alias("goal"), "rank_error")).alias("c"))
    met = _rows(df, groups, value).alias("r").join(F.broadcast(listed).alias("l"), _same("r", "l", _GROUP)).select("l.kind", "l.value_of", "r.v", F.explode("l.c").alias("c"))
    counted = met.groupBy(*_GROUP, "c").agg(F.count_if(F.col("v") < F.col("c.value")).alias("below"), F.count_if(F.col("v") <= F.col("c.value")).alias("upto"))
    off = F.greatest(F.col("below") + 1 - F.col("c.goal"), F.col("c.goal") - F.col("upto"), F.lit(0).cast("bigint"))
    return counted.select(*_GROUP, F.col("c.total").alias("n"), F.col("c.pct").alias("pct"), (off <= F.col("c.rank_error")).alias("within"))
