"""Peers of a company on the narrowest level that has enough of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYWORD, ALL = "keyword", "all"


def peers(companies: DataFrame, id_col: str, levels: Sequence[str], ready: Column, keyword: Column, least: int, most: int | None = None) -> DataFrame:
    """id, level, status, n_peers, and peer and nth for each of up to `most` (`least` if not given) peers, in the order of
    their ids; a target without a peer has one row with nulls.

    levels: columns, the narrowest first. The first with `least` ready peers is it ("ready"). If none has, the level with
    the most peers, narrower ones first ("below_minimum"). A target without any level's value takes the ready companies
    of the keyword if it has that too ("review"), else all ready ones ("review").

    Sizes of all levels come from one aggregate by grouping sets, and each group gives only as many members as a target may
    need, so a group of any size is a few rows a task; targets meet those, never each other."""
    most = most or least
    named = [*levels, KEYWORD]
    rows = companies.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in levels], F.when(F.coalesce(keyword, F.lit(False)), "yes").alias(KEYWORD), F.coalesce(ready, F.lit(False)).alias("ready"))
    value = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.col(c)) for i, c in enumerate(named)])
    level = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.lit(c)) for i, c in enumerate(named)], F.lit(ALL))
    flags = [F.grouping(c).alias(f"_{i}") for i, c in enumerate(named)]
    sizes = rows.filter("ready").groupingSets([[c] for c in named] + [[]], *named).agg(*flags, F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(level.alias("level"), value.alias("value"), "n").filter((F.col("level") == ALL) | F.col("value").isNotNull())
    # What a target may be measured by: the values of its levels; or, if it has none, its keyword, or everyone.
    bare = F.coalesce(*[F.col(c) for c in levels]).isNull()
    own = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(c).alias("level"), F.col(c).alias("value"))) for i, c in enumerate(levels)]
    own.append(F.when(bare & F.col(KEYWORD).isNotNull(), F.struct(F.lit(len(levels)).alias("rank"), F.lit(KEYWORD).alias("level"), F.lit("yes").alias("value"))))
    own.append(F.when(bare & F.col(KEYWORD).isNull(), F.struct(F.lit(len(levels) + 1).alias("rank"), F.lit(ALL).alias("level"), F.lit("").alias("value"))))
    asked = rows.select("id", "ready", F.explode(F.array_compact(F.array(*own))).alias("a")).select("id", "ready", "a.*")
    sizes = sizes.withColumn("value", F.coalesce("value", F.lit("")))
    met = asked.join(sizes, ["level", "value"], "left").withColumn("n_peers", F.coalesce("n", F.lit(0)) - F.when(F.col("ready"), 1).otherwise(0))
    # Enough: the narrowest; else the largest, then the narrowest.
    enough = F.col("n_peers") >= least
    order = F.when(enough, F.struct(F.lit(0).alias("late"), F.lit(0).cast("long").alias("less"), F.col("rank"))).otherwise(F.struct(F.lit(1).alias("late"), (-F.col("n_peers")).alias("less"), F.col("rank")))
    status = F.when(F.col("level").isin(KEYWORD, ALL), "review").when(enough, "ready").otherwise("below_minimum")
    chosen = met.groupBy("id").agg(F.min_by(F.struct("level", "value", "n_peers", status.alias("status")), order).alias("c")).select("id", "c.*")
    # One more than a target needs, as it may be among them itself.
    member = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("level"), F.col(c).alias("value"))) for c in named], F.struct(F.lit(ALL).alias("level"), F.lit("").alias("value")))))
    members = rows.filter("ready").select(F.col("id").alias("peer"), member.alias("m")).select("peer", "m.*")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("level", "value").orderBy("peer"))).filter(F.col("_n") <= most + 1).drop("_n")
    lists = first.groupBy("level", "value").agg(F.sort_array(F.collect_list("peer")).alias("list"))
    others = F.slice(F.filter("list", lambda x: x != F.col("id")), 1, most)
    found = chosen.join(lists, ["level", "value"], "left").select("id", "level", "status", "n_peers", F.posexplode_outer(F.coalesce(others, F.array().cast(lists.schema["list"].dataType))).alias("nth", "peer"))
    return found.select(F.col("id").alias(id_col), "level", "status", "n_peers", "peer", (F.col("nth") + 1).alias("nth"))
