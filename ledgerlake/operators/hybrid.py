"""Hybrid search out of several groups of candidates, as one plan: groups, fusion, boosts, diversity, re-rank, final order.

Every way of asking is a Spec: nearest vectors, or words that source and text must hold, each with its own limit. One scan
of the chunks judges all specs at once and sends on only what meets one; Spark keeps each spec's best within each task
before it shuffles. From there on tables are as small as the limits together. Chunks beside an exact hit, and the texts of
the few that are re-ranked, are fetched by key: a join that broadcasts those keys, as many as the limits allow.
Where a candidate comes from goes with it to the end: each group that named it, with its best place there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.retrieval import dot, reranked

EXACT = "article:"
#: Most rows of one spec, whatever it asks for.
MOST = 300


@dataclass(frozen=True)
class Spec:
    """One way of asking. group: the list its hits join, in the order of specs. vector: nearest by inner product; else
    chunks that hold all of source_has and text_has, in the order of their keys, at a fixed score."""

    group: str
    limit: int
    reason: str | None = None
    vector: tuple[float, ...] | None = None
    source_has: tuple[str, ...] = ()
    text_has: tuple[str, ...] = ()
    score: float = 0.0
    boost: float = 0.0

    def matches(self) -> Column:
        parts = [F.col("source").contains(t) for t in self.source_has] + [F.col("text").contains(t) for t in self.text_has]
        return reduce(Column.__and__, parts, F.col("v").isNotNull() if self.vector is not None else F.lit(True))


@dataclass(frozen=True)
class Weights:
    vector: float = 0.65
    keyword: float = 0.35
    rrf: float = 0.25
    #: What a boost counts before and after the re-rank.
    boost: float = 1.4
    reranked_boost: float = 0.9


def candidates(chunks: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """path, chunk_index, source, group, spec, place (within the spec, from 1), vector_score, keyword_score, boost, reason.
    chunks: path, chunk_index, source, text, v."""
    hits = []
    for n, s in enumerate(specs):
        none = F.lit(None).cast("double")
        near = F.round(dot(F.col("v"), F.array(*map(F.lit, s.vector))), 6) if s.vector is not None else none
        hit = F.struct(F.lit(n).alias("spec"), F.lit(s.group).alias("group"), F.lit(min(s.limit, MOST)).alias("limit"), near.alias("vector_score"), (none if s.vector is not None else F.lit(float(s.score))).alias("keyword_score"), F.lit(float(s.boost)).alias("boost"), F.lit(s.reason).cast("string").alias("reason"))
        hits.append(F.when(s.matches(), hit))
    met = chunks.select("path", "chunk_index", "source", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "chunk_index", "source", "h.*")
    w = Window.partitionBy("spec").orderBy(F.col("vector_score").desc_nulls_last(), "path", "chunk_index")
    best = met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST)
    return best.filter(F.col("place") <= F.col("limit")).drop("limit")


def beside(chunks: DataFrame, hits: DataFrame, radius: int = 1, group: str = "neighbor", spec: int = 1 << 20) -> DataFrame:
    """Candidates up to `radius` chunks beside exact hits of the same path; chunks count from 1."""
    offsets = F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])
    keys = hits.select("path", F.col("chunk_index").alias("_at"), F.col("source").alias("_of"), F.greatest(F.coalesce("keyword_score", F.lit(0.0)) - 0.08, F.lit(0.55)).alias("keyword_score"), F.explode(offsets).alias("_d"))
    keys = keys.select("path", (F.col("_at") + F.col("_d")).alias("chunk_index"), "keyword_score", F.concat(F.lit("neighbor:"), "_of", F.lit("#"), F.col("_at").cast("string")).alias("reason"), "_at").filter("chunk_index > 0")
    keys = keys.dropDuplicates(["path", "chunk_index", "_at"])
    met = chunks.select("path", "chunk_index", "source").join(F.broadcast(keys), ["path", "chunk_index"])  # twice the radius for each of the exact hits
    place = F.row_number().over(Window.orderBy("path", "_at", "chunk_index"))
    return met.select("path", "chunk_index", "source", F.lit(group).alias("group"), F.lit(spec).alias("spec"), F.lit(None).cast("double").alias("vector_score"), "keyword_score", F.lit(0.0).alias("boost"), "reason", place.alias("place"))


def fused(hits: DataFrame, rrf_k: int = 40, group_limits: dict[str, int] | None = None) -> DataFrame:
    """One row a chunk: the best of each score, the sum of reciprocal places over all groups, the first reason, and the
    groups with the best place in each."""
    at = F.row_number().over(Window.partitionBy("group").orderBy("spec", "place"))
    listed = hits.withColumn("at", at)
    for group, limit in (group_limits or {}).items():
        listed = listed.filter((F.col("group") != group) | (F.col("at") <= limit))
    named = F.struct("spec", "place")
    one = listed.groupBy("path", "chunk_index", "source", "group").agg(
        F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"), F.max("boost").alias("boost"), F.min("at").alias("at"),
        F.sum(1.0 / (rrf_k + F.col("at"))).alias("rrf"), F.min_by("reason", F.when(F.col("reason").isNotNull(), named)).alias("reason"), F.min(F.when(F.col("reason").isNotNull(), named)).alias("_named"),
    )
    whence = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "group", F.col("at").cast("string")))), ",")
    return one.groupBy("path", "chunk_index", "source").agg(
        F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"), F.max("boost").alias("boost"),
        F.round(F.sum("rrf"), 9).alias("rrf"), F.min_by("reason", "_named").alias("reason"), whence.alias("groups"),
    )


def scored(merged: DataFrame, weights: Weights, preferred: Sequence[str] = (), known: Sequence[str] = (), penalty: float = 0.0) -> DataFrame:
    """Boost by source (0.25 preferred, 0.10 known, 0.25 exact), a penalty for sources that none of `preferred` names, and
    the score without a re-rank."""
    anyone = lambda terms: reduce(Column.__or__, [F.col("source").contains(t) for t in terms], F.lit(False))
    exact = F.coalesce(F.col("reason").startswith(EXACT), F.lit(False))
    by_source = F.greatest(F.when(anyone(preferred), 0.25).otherwise(0.0), F.when(anyone(known), 0.10).otherwise(0.0), F.when(exact, 0.25).otherwise(0.0))
    out = merged.withColumn("boost", F.greatest("boost", by_source)).withColumn("exact", F.when(exact, 1.0).otherwise(0.0))
    out = out.withColumn("penalty", F.when(F.lit(bool(preferred)) & ~anyone(preferred), float(penalty)).otherwise(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.col("exact") + weights.boost * F.col("boost") + weights.vector * zero("vector_score") + weights.keyword * zero("keyword_score") + weights.rrf * F.least(F.col("rrf") * 10, F.lit(1.0)) - F.col("penalty")
    return out.withColumn("score", F.round(score, 8))


def hybrid_search(
    chunks: DataFrame, specs: Sequence[Spec], weights: Weights = Weights(), *, exact_group: str = "exact", radius: int = 1, rrf_k: int = 40, group_limits: dict[str, int] | None = None,
    preferred: Sequence[str] = (), known: Sequence[str] = (), penalty: float = 0.0, per_source: int = 2, pool: int = 30, top: int = 8, query: str = "", client=None,
) -> DataFrame:
    """rank, path, chunk_index, source, the scores, boost, reason and groups of the `top` best. client: the re-ranking model,
    a function of (query, texts); without one, or where it fails, the score before the re-rank decides."""
    hits = candidates(chunks, specs)
    if radius:
        hits = hits.unionByName(beside(chunks, hits.filter(F.col("group") == exact_group), radius))
    order = [F.col("score").desc(), F.col("path"), F.col("chunk_index")]
    ranked = scored(fused(hits, rrf_k, group_limits), weights, preferred, known, penalty)
    diverse = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("_n") <= per_source).drop("_n") if per_source else ranked
    best = diverse.orderBy(*order).limit(pool)
    final = F.col("score")
    if client is not None:
        texts = chunks.select("path", "chunk_index", "text").join(F.broadcast(best.select("path", "chunk_index")), ["path", "chunk_index"])  # `pool` rows
        judged = reranked(texts.withColumn("rerank", F.lit(None).cast("double")), query, client, score_col="rerank").select("path", "chunk_index", "rerank")
        best = best.join(F.broadcast(judged), ["path", "chunk_index"], "left")
        final = F.when(F.col("rerank").isNull(), final).otherwise(F.round(F.col("rerank") + F.col("exact") + weights.reranked_boost * F.col("boost") - F.col("penalty"), 8))
    place = F.row_number().over(Window.orderBy(F.col("final").desc(), F.col("score").desc(), "path", "chunk_index"))  # `pool` rows
    return best.withColumn("final", final).withColumn("rank", place).filter(F.col("rank") <= top)
