"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components become integers, floor(256 * x). Candidates are dealt into blocks; each block's index is built once and written.
It holds postings (candidate, dimension, sign) in segments of descending quantised impact: a component's size in LEVELS
equal steps of the block's largest. All postings of a segment count the same, the middle of their step. Components under
one step have no posting.

A block of queries takes the segments in that order and adds up what they contribute. What the sum after a segment lacks
is at most |query| * |what the segments so far leave of the candidate|; these norms, quantisation and untaken components
together, are in the index. A query stops only when this proves that few candidates can be among its k best, or after the
last segment; whoever can still be among them is rescored exactly, from the stored integers.

Blocks of candidates are the larger side and are moved once; the queries' blocks, of which every candidate block needs
each, are copied. A block of queries gives k rows a query, and the k best of all blocks are ranked by a window over those.

Edge cases. Null vectors, vectors with a null or non-finite component, and null ids take no part. Candidates of another
length than the query take no part in its search. Rows that share the query's id count as its own; an id that is asked
twice is asked once, with the smallest vector. Equal scores go to the smaller id. Fewer than k candidates give as many
rows. An empty table gives no rows; extra columns are ignored. Components may be as large as keeps a score a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE, K, EVERY = 256, 5, 50
CANDIDATES, QUERIES = 4096, 512
#: Steps of the quantised impact, so many segments at most.
LEVELS = 16
#: Contributions that are added up at a time.
CELLS = 1 << 20
#: A query is rescored as soon as no more candidates than this are possible.
POSSIBLE = 64


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v (array of longs) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine.eqNullSafe(True))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes a number, and the numbers in as few as hold them all."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, values.astype(f"<i{width}").tobytes()


def blocks(rows: DataFrame, size: int, indexed: bool) -> tuple[DataFrame, int]:
    """Rows packed `size` or so together: dim, block, ids, width and vals (binary), with an index or null; and the number
    of blocks."""
    count = max(1, -(-rows.count() // size))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        dim, block = int(part["dim"].iloc[0]), int(part["block"].iloc[0])
        values = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim)
        row = (dim, block, part["id"].to_numpy(np.int64).tobytes(), *narrow(values), *(built(values) if indexed else (None, None, None, None)))
        return pd.DataFrame([row], columns=["dim", "block", "ids", "width", "vals", "ends", "docs", "dims", "rest"])

    schema = "dim int, block int, ids binary, width int, vals binary, ends binary, docs binary, dims binary, rest binary"
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(count)).cast("int").alias("block"))
    return written(dealt.groupBy("dim", "block").applyInPandas(pack, schema), "vector-blocks"), count


def built(values: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """The index of one block: where each segment ends, postings (candidate; dimension, or its complement for a negative
    component) in segments of descending impact, and the norms of what is left of each candidate before the first segment
    and after each."""
    n, dim = values.shape
    x = values.astype(np.float64)
    step = step_of(values)
    level = np.minimum(np.floor(np.abs(x) / step), LEVELS - 1).astype(np.int64)
    left, rest, docs, dims, ends = x.copy(), [np.sqrt((x * x).sum(1))], [], [], []
    for at in range(LEVELS - 1, 0, -1):
        doc, d = np.nonzero(level == at)  # in order of the candidates
        left[doc, d] -= np.sign(x[doc, d]) * (at + 0.5) * step
        docs.append(doc.astype("<u4"))
        dims.append(np.where(x[doc, d] < 0, ~d, d).astype("<i4"))
        ends.append(sum(map(len, docs)))
        rest.append(np.sqrt((left * left).sum(1)))
    return np.array(ends, "<i8").tobytes(), np.concatenate(docs).tobytes(), np.concatenate(dims).tobytes(), np.array(rest).tobytes()


def step_of(values: np.ndarray) -> float:
    return max(1.0, float(np.abs(values.astype(np.float64)).max(initial=0)) / LEVELS)


class ImpactIndex:
    """One block as it is stored. taken: how many segments each query took."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, index: tuple[bytes, bytes, bytes, bytes] | None = None):
        ends, docs, dims, rest = index or built(values)
        self.ids, self.values, self.step = ids, values, step_of(values)
        self.ends, self.docs, self.dims = np.frombuffer(ends, "<i8"), np.frombuffer(docs, "<u4").astype(np.int64), np.frombuffer(dims, "<i4")
        self.rest = np.frombuffer(rest, np.float64).reshape(LEVELS, len(ids))
        self.taken: list[int] = []

    def add(self, scores: np.ndarray, queries: np.ndarray, segment: int) -> None:
        """What a segment contributes to the scores of some queries."""
        at, end = int(self.ends[segment - 1]) if segment else 0, int(self.ends[segment])
        many = max(1, CELLS // max(1, len(queries)))
        while at < end:
            stop = min(end, at + many)
            docs, dims = self.docs[at:stop], self.dims[at:stop]
            parts = np.where(dims < 0, -1.0, 1.0) * queries[:, np.where(dims < 0, ~dims, dims)]
            starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            scores[:, docs[starts]] += np.add.reduceat(parts, starts, axis=1) * ((LEVELS - 1 - segment + 0.5) * self.step)
            at = stop

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, id, score) of each query's k best here."""
        n, asked = len(self.ids), queries.astype(np.float64)
        norms = np.sqrt((asked * asked).sum(1))
        own = self.ids[None, :] == query_ids[:, None]
        active, scores = np.arange(len(query_ids)), np.zeros((len(query_ids), n))
        for segment in range(LEVELS - 1):
            self.add(scores, asked[active], segment)
            # A little more than the bound, for the rounding of sums.
            slack = norms[active, None] * (self.rest[segment + 1] + 1e-9 * self.rest[0])[None, :] + 1e-6
            low = np.where(own[active], -np.inf, scores - slack)
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            possible = (scores + slack >= bar[:, None]) & ~own[active]
            done = (possible.sum(1) <= max(POSSIBLE, k)) | (segment == LEVELS - 2)
            for row in np.flatnonzero(done):
                self.taken.append(segment + 1)
                yield from self._rescored(query_ids[active[row]], queries[active[row]], np.flatnonzero(possible[row]), k)
            active, scores = active[~done], scores[~done]
            if not len(active):
                return

    def _rescored(self, query_id: int, query: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        scores = self.values[at].astype(np.int64) @ query.astype(np.int64)
        for i in np.lexsort((self.ids[at], -scores))[:k]:
            yield int(query_id), int(self.ids[at[i]]), int(scores[i])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """Both: id, v (integers()). Returns query_id, rank, vec_id, score."""
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    c, n_c = blocks(candidates, candidate_block, True)
    q, _ = blocks(asked, query_block, False)
    index = c.withColumns({"cb": F.col("block"), "kind": F.lit(0)})
    copies = q.withColumns({"cb": F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))), "kind": F.lit(1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, at = None, None
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                values = np.frombuffer(row.vals, f"<i{row.width}").reshape(len(ids), row.dim)
                if row.kind == 0:
                    here, at = ImpactIndex(ids, values, (row.ends, row.docs, row.dims, row.rest)), (row.dim, row.cb)
                elif at == (row.dim, row.cb):  # else no candidates of that length are in the block
                    yield pd.DataFrame(list(here.best(ids, values, k)), columns=["query_id", "vec_id", "score"], dtype="int64")

    # An index comes first, then the queries' blocks one by one: a task holds one of each.
    met = index.unionByName(copies).repartition(n_c, "dim", "cb").sortWithinPartitions("dim", "cb", "kind", "block")
    found = met.mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(c: Column, by: int) -> Column:
    return F.pmod(c, F.lit(by)) == 0


def op10_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(divisible(F.col("id"), EVERY)))
