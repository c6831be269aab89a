"""Exact quantiles over the cluster by selection of ranks: no task sorts, or holds, a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelframe.operators import graph

#: A sketch's ranks are wrong by a share of 1 / ACCURACY at most; brackets reach twice as far, which leaves room
#: for the ranks' rounding in groups of more than FEW values.  Smaller groups keep all of theirs.
ACCURACY = 1000
FEW = 5 * ACCURACY


def _compressed(rows: DataFrame, shares: list[float]) -> DataFrame:
    """g, v, w, exact: the values of each group (g, v) as few rows in their order.  A sketch brackets every rank
    sought; each value within a bracket is a row with its weight, and all values between two brackets are
    one row, which has their smallest.  Both passes combine before they shuffle.  Values stay where they are:
    only groups of more than FEW values need their sketch, and those are sent round, at most one row in FEW."""
    reach = 2 / ACCURACY
    ends = [e for s in shares for e in (max(0.0, s - reach), min(1.0, s + reach))]
    sketch = rows.groupBy("g").agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("e"), F.count("*").alias("all"))
    large = sketch.filter(F.col("all") > FEW).select(F.col("g").alias("of"), "e")
    at = rows.join(F.broadcast(large), F.col("g").eqNullSafe(F.col("of")), "left")
    lows, highs = [F.col("e")[2 * k] for k in range(len(shares))], [F.col("e")[2 * k + 1] for k in range(len(shares))]
    inside, above = F.col("e").isNull(), F.lit(0)
    for low, high in zip(lows, highs):
        inside, above = inside | ((F.col("v") >= low) & (F.col("v") <= high)), above + (F.col("v") > low).cast("int")
    at = at.withColumns({"own": F.when(inside, F.col("v")), "above": F.when(~inside, above)})
    return at.groupBy("g", "above", "own").agg(F.min("v").alias("v"), F.count("*").alias("w")).select("g", "v", "w", F.col("above").isNull().alias("exact"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """Per group ``by`` (or one row for all): n, the number of values, and q0, q1, ... at the shares, on the line
    between the two nearest ranks.  ``df`` is read twice.

    What the two passes leave of the values is dealt by ranges of (group, value), so what is near a rank of a
    large group may lie in several partitions, one after the other.  The weights of each (group, partition)
    tell which of them hold the ranks sought; only those are put in order.

    Nulls are left out, and a group without values has no row; NaN comes after all numbers."""
    group = F.struct(*by) if by else F.lit(0)
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    rows = graph.cut(_compressed(rows, shares).repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    held = rows.groupBy("g", "part").agg(F.sum("w").alias("held"))
    # A row per group and partition it lies in: a group has several only if it fills them.
    at = Window.partitionBy("g")
    before = F.coalesce(F.sum("held").over(at.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"n": F.sum("held").over(at), "before": before})
    spot = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    ranks = [f(spot(s)).cast("long") for s in shares for f in (F.floor, F.ceil)]
    sought = F.exists(F.array(*ranks), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))
    near = rows.join(held.filter(sought).drop("held"), ["g", "part"])
    last = F.col("before") + F.sum("w").over(Window.partitionBy("g", "part").orderBy("v"))
    near = near.withColumn("last", last)
    missed = F.raise_error(F.lit("a sketch was wrong by more than its bound")).cast("double")
    mine = F.when(F.col("exact"), F.col("v")).otherwise(missed)
    holds = lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("w"))
    found = near.groupBy("g", "n").agg(*(F.max(F.when(holds(r), mine)).alias(f"r{k}") for k, r in enumerate(ranks)))
    low, high = lambda k: F.col(f"r{2 * k}"), lambda k: F.col(f"r{2 * k + 1}")
    share = lambda s: spot(s) - F.floor(spot(s))
    line = [F.when(low(k) == high(k), low(k)).otherwise(low(k) + (high(k) - low(k)) * share(s)).alias(f"q{k}") for k, s in enumerate(shares)]
    return found.select(*(F.col("g")[c].alias(c) for c in by), "n", *line)
