"""DataFrame transforms that several plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.numeric import tolerance


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest row of each key out of both; of equal versions the change."""
    both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col(version).desc_nulls_last(), F.col("_change").desc()]).drop("_change")


def bridge(left: Column, right: Column, required: bool = True, share: float = 0.005, least: float = 2.0) -> Column:
    """Status of left = right: a missing side is a warning (skipped where optional), else pass or fail by the tolerance."""
    missing = F.lit("warning" if required else "skipped")
    return F.when(left.isNull() | right.isNull(), missing).when(F.abs(left - right) <= tolerance(left, right, share, least), "pass").otherwise("fail")


def rolled_up(statuses: str) -> Column:
    """Any fail is a fail, any warning a warning, any pass a pass, else skipped."""
    s = F.col(statuses)
    return F.when(F.bool_or(s == "fail"), "fail").when(F.bool_or(s == "warning"), "warning").when(F.bool_or(s == "pass"), "pass").otherwise("skipped")


def interval_overlap(left: DataFrame, right: DataFrame, key: str, bin_size: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of one key whose [lo, hi) overlap: an equi-join on time bins, each pair kept in its first common bin only."""
    binned = lambda d: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size))))
    a, b = binned(left).alias("a"), binned(right).alias("b")
    start = F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}"))
    met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.bin") == F.col("b.bin"))
    return a.join(b, met).filter((start < F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}"))) & (F.floor(start / bin_size) == F.col("a.bin")))


def salted_sum(rows: DataFrame, keys: Sequence[str], value: Column, salts: int = 64, name: str = "total") -> DataFrame:
    """A sum in two steps for keys that hold much of the data (and aggregates that can't combine early)."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).groupBy(*keys, "_salt").agg(F.sum(value).alias("_s"))
    return part.groupBy(*keys).agg(F.sum("_s").alias(name))
