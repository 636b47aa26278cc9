"""Retrieval: vectors, BM25, fusion, chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import tokens
from ledgerlake.sources.shared import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Vectors and queries that are scored against each other at a time.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024


def nearest(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = None, digits: int = 4, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score (inner product), rn: each query's k best vectors but its own, ties to the smaller id.

    queries: query_id, q; vectors: vec_id, v; both with the column `group` where only vectors of the query's group count.
    Both sides are dealt into blocks and meet block against block, as two matrices that are multiplied; of each block a
    query keeps its k best (and what rounding to `digits` may tie with them). A task holds one block of each side at a
    time, whatever the sizes of groups. Null vectors, and those of another length than the query, take no part."""
    g = F.col(group) if group else F.lit(0)
    # Place in the table parts rows that repeat an id, so that they spread too.
    v = vectors.filter("v IS NOT NULL").select(g.alias("g"), F.size("v").alias("dim"), "vec_id", F.col("v").cast("array<double>").alias("v"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("h"))
    q = queries.filter("q IS NOT NULL").select(g.alias("g"), F.size("q").alias("dim"), "query_id", F.col("q").cast("array<double>").alias("q"), F.xxhash64("query_id", F.monotonically_increasing_id()).alias("h"))
    blocks = lambda rows, size, name: rows.groupBy("g", "dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = blocks(v, vector_block, "vbs").join(blocks(q, query_block, "qbs"), ["g", "dim"])
    keys = ["g", "dim", "vb", "qb"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    left = v.join(sizes, ["g", "dim"]).select("g", "dim", own("vbs").alias("vb"), each("qbs").alias("qb"), "vec_id", "v")
    right = q.join(sizes, ["g", "dim"]).select("g", "dim", each("vbs").alias("vb"), own("qbs").alias("qb"), "query_id", "q")

    def best(_, these: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(these) and len(asked):
            scores = np.stack(asked["q"]) @ np.stack(these["v"]).T
            ids, asking = these["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            scores[asking[:, None] == ids[None, :]] = -np.inf
            bar = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - 2 * 10.0**-digits
            row, at = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
            out = list(zip(asking[row].tolist(), ids[at].tolist(), scores[row, at].tolist()))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    id_type = lambda rows, c: rows.schema[c].dataType.simpleString()
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {id_type(queries, 'query_id')}, vec_id {id_type(vectors, 'vec_id')}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    scored = met.withColumn("score", F.round("score", digits))
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores over the pool `docs` for the query's terms, repeated terms counted again. Texts are cut into words once: lengths
    and the asked words' counts are written as a narrow table, which the statistics and the scores come from."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    asked = {t: terms.count(t) for t in dict.fromkeys(terms)}
    # One pass over the words: the number of each asked one.
    start = F.array(*[F.lit(0)] * len(asked))
    places = F.create_map(*[F.lit(x) for i, t in enumerate(asked) for x in (t, i)])
    held = F.filter("w", lambda x: x.isin(*asked))
    counts = F.aggregate(held, start, lambda s, x: F.transform(s, lambda n, i: n + F.when(i == F.element_at(places, x), 1).otherwise(0)))
    counted = stored(words.select("doc_id", F.size("w").alias("len"), counts.alias("counts")), "bm25-counts")
    n, mean, *df = counted.agg(F.count(F.lit(1)), F.avg("len"), *[F.count_if(F.get("counts", F.lit(i)) > 0) for i in range(len(asked))]).first()
    score = F.lit(0.0)
    for i, (times, d) in enumerate(zip(asked.values(), df)):
        tf = F.get("counts", F.lit(i))
        idf = math.log(1 + (n - d + 0.5) / (d + 0.5))
        score = score + F.when(tf > 0, times * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))).otherwise(0.0)
    return counted.filter(F.exists("counts", lambda c: c > 0)).select("doc_id", F.round(score, 6).alias("score"))


def overfetch(limit: int, factor: int = 4, most: int = 50) -> int:
    """How many candidates to ask for where some will be left out."""
    return max(limit, min(most, limit * factor))


def fused(dense: DataFrame, lexical: DataFrame, key: str, k: int = 40, dense_weight: float = 0.55, lexical_weight: float = 0.45) -> DataFrame:
    """Reciprocal-rank fusion of (key, dense_rank) and (key, lexical_rank); what one side lacks adds nothing."""
    both = dense.join(lexical, key, "full")
    score = F.coalesce(dense_weight / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(lexical_weight / (k + F.col("lexical_rank")), F.lit(0.0))
    return both.withColumn("score", F.round(score, 8))


def paragraph_chunks(text: str | None, size: int = 900, overlap: int = 120) -> list[str]:
    """Paragraphs packed greedily up to a size; a chunk starts with the end of the one before."""
    chunks, now = [], ""
    for para in (p.strip() for p in (text or "").split("\n") if p.strip()):
        while len(para) > size:
            if now:
                chunks.append(now)
                now = ""
            chunks.append(para[:size])
            para = para[size - overlap :]
        if now and len(now) + 1 + len(para) > size:
            chunks.append(now)
            tail = now[-overlap:]
            now = tail if len(tail) + 1 + len(para) <= size else ""
        now = f"{now}\n{para}" if now else para
    return [*chunks, now] if now else chunks


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 900, overlap: int = 120) -> DataFrame:
    """Packing is sequential within a text, so each task packs its own texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, c) for i, t in zip(batch["id"], batch["text"]) for n, c in enumerate(paragraph_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL").mapInPandas(run, "doc_id long, chunk_index int, chunk string")


def embedded(rows: DataFrame, client, dimension: int, text_col: str = "text") -> DataFrame:
    """An `embedding` column at length one from any client: a function of a list of texts that gives as many vectors.
    It is called a batch at a time in the tasks; a vector of another length is an error."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        vectors = client([t or "" for t in texts])
        if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
            raise ValueError(f"the client must give one vector of {dimension} numbers for each text")
        return pd.Series([list(map(float, v)) for v in vectors])

    return rows.withColumn("embedding", embed(F.col(text_col))).withColumn("embedding", unit(F.col("embedding")))


def reranked(hits: DataFrame, query: str, client, text_col: str = "text", score_col: str = "score", failures=None, errors: tuple[type[Exception], ...] = (OSError, TimeoutError, ValueError)) -> DataFrame:
    """Scores by an outside model: a function of (query, texts). Where it fails with one of `errors` (what a client that is
    unreachable or answers badly raises), the scores stay as they were and the texts are added to `failures`, an accumulator
    of the caller's; any other exception is a fault of the code and ends the job."""

    @F.pandas_udf("double")
    def judge(texts: pd.Series, scores: pd.Series) -> pd.Series:
        try:
            found = client(query, list(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} scores for {len(texts)} texts")
            return pd.Series(found, dtype=float)
        except errors:
            if failures is not None:
                failures.add(len(texts))
            return scores

    return hits.withColumn(score_col, judge(F.col(text_col), F.col(score_col)))
