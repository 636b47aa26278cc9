"""Exact ranks within groups of any size: no window, buffer or task holds a group.

Equal values are counted first, on the map side too. The counts are dealt to tasks by ranges of (group, value), so a group
that holds a third of all rows is spread over many. One row a (range, group) says how many rows come before it. A rank is
then looked for in the one range that holds it, and a row's standing is a running count within its range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.shared import stored


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


class Standing:
    """Counts of `value` by group, in ranges. Null values take no part."""

    def __init__(self, rows: DataFrame, groups: Sequence[str], value: str):
        self.groups, self.value = list(groups), value
        counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
        # Written: a range's number must stay the same wherever it is read.
        self.counts = stored(counts.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()), "ranks")
        sums = self.counts.groupBy("_part", *groups).agg(F.sum("_n").alias("_here"))
        whole = Window.partitionBy(*groups)  # one row a range and group
        before = F.coalesce(F.sum("_here").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.spans = sums.select("_part", *groups, "_here", before.alias("_before"), F.sum("_here").over(whole).alias("n"))

    def at(self, ranks: Mapping[str, Column]) -> DataFrame:
        """groups and, for each name, the value at that rank: a Column of n, counted from 1; null where there is none."""
        asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
        spans = self.spans.withColumn("_a", asked).select("*", "_a.*")
        held = spans.filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_here")))
        met = self.counts.alias("c").join(held.alias("h"), (F.col("c._part") == F.col("h._part")) & _same("c", "h", self.groups))
        met = met.select("h.*", F.col(f"c.{self.value}").alias("_v"), "c._n")
        # The rows of one range.
        running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part", *self.groups, "name").orderBy("_v"))
        found = met.withColumn("_upto", running).filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_n") < F.col("rank")))
        picked = [F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks]
        return found.groupBy(*self.groups).agg(*picked)

    def upto(self) -> DataFrame:
        """groups, value, n and upto: how many rows of the group are at most that value."""
        own = F.sum("_n").over(Window.partitionBy("_part", *self.groups).orderBy(self.value))
        met = self.counts.withColumn("_own", own).alias("c").join(self.spans.alias("s"), (F.col("c._part") == F.col("s._part")) & _same("c", "s", self.groups))
        return met.select(*[f"c.{g}" for g in self.groups], f"c.{self.value}", "s.n", (F.col("s._before") + F.col("c._own")).alias("upto"))


def nearest_rank(q: float, n: str = "n") -> Column:
    """Rank of the q-quantile, ceil form: the ceil(q n)-th smallest."""
    return F.greatest(F.ceil(F.lit(q) * F.col(n)), F.lit(1))


def rounded_rank(q: float, n: str = "n") -> Column:
    """Rank of the q-quantile by round((n - 1) q), half to even."""
    return F.bround((F.col(n) - 1) * F.lit(q), 0).cast("long") + 1


def middle_ranks(n: str = "n") -> dict[str, Column]:
    """The two ranks whose values' mean is the median."""
    return {"_low": F.floor((F.col(n) + 1) / 2), "_high": F.floor(F.col(n) / 2) + 1}


def median() -> Column:
    return F.col("_low") * 0.5 + F.col("_high") * 0.5
