"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: monotonically_increasing_id() holds the partition above this many bits.
PART_BITS = 33


def part_of(at: str) -> Column:
    return F.shiftrightunsigned(F.col(at), PART_BITS)


def laid_out(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows`, from a written table, dealt to tasks by ranges of `order` (ascending, nulls first), sorted within them and
    written with _at: a number that rises in that order and counts without a gap within each range, whose number is
    part_of("_at"). Rows that are equal in all of `order` are parted by their place in the table they come from, so any
    number of them spreads over tasks."""
    placed = rows.withColumn("_seq", F.monotonically_increasing_id())
    spread = placed.repartitionByRange(*[F.col(c) for c in [*order, "_seq"]]).sortWithinPartitions(*order, "_seq")
    return written(spread.drop("_seq").withColumn("_at", F.monotonically_increasing_id()), label)


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows` with place: 0, 1, 2 and so on in that order."""
    laid = laid_out(rows, order, label)
    # One row a range: as few as there are shuffle partitions, whatever the number of rows.
    sizes = laid.groupBy(part_of("_at").alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return laid.withColumn("_part", part_of("_at")).join(F.broadcast(starts), "_part").withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
