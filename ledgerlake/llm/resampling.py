"""Importance resampling towards a target distribution, with a cutoff that a quantile sketch brackets.

Features are hashed runs of one to three words. Tasks count them in an array a task; the counts of all documents and of the
target texts give each of BUCKETS buckets a gain, and a second look at the texts adds up the gains by indexing that array.
Noise from the document's id (Gumbel-distributed) turns "the highest scores" into a weighted draw without replacement.

The cutoff among the scores needs no sort of all of them. A mergeable quantile sketch gives two scores about the wanted
rank; exact counts of what lies above the upper and from the lower on show whether the rank is between them, and widen the
bracket by another look at the sketch where it isn't. Only the rows within the bracket are sorted, over tasks, to find the
cutoff. The rows above it are drawn whatever their order; they are numbered apart, for the contract asks for ranks.

What comes to the driver: two arrays of BUCKETS numbers, and single rows of counts. The gains go to the tasks with the code.

Edge cases. Null and empty texts have no features: weight 0. Null ids stand for an empty number in the noise and come last
among equal scores. Rows that repeat an id have the same noise; ties between them go by weight, then by the number of
features, and of equal rows any is as good. A draw of no rows, an empty table and an empty target (all gains from the
documents' side) work as any other. Texts of any length are cut into stretches of STRETCH words with two words carried over.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, ids_back, table, written
from .ordering import numbered

BUCKETS, LONGEST_RUN, SEED = 10_000, 3, 42
#: Documents of fewer words are not drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 5
#: Words that are hashed at a time.
STRETCH = 1 << 17
#: Relative error of the sketch is its inverse.
ACCURACY = 10_000
#: Word lengths with a table of their own; longer ones are hashed one by one.
TABLED = 48
#: A to Z in lower case, digits, a to z and all bytes beyond ASCII as they are, anything else a space.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shift_tables() -> np.ndarray:
    """[length, byte, value]: what `length` more bytes make of a crc32 that has the value in that byte."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for length in range(TABLED + 1):
        zeros = bytes(length)
        base = zlib.crc32(zeros)
        for bit in range(32):
            v = zlib.crc32(zeros, 1 << bit) ^ base
            byte, at = bit >> 3, 1 << (bit & 7)
            out[length, byte, at : 2 * at] = out[length, byte, :at] ^ np.uint32(v)
    return out


class Words(dict):
    """Numbers of the words of a group of stretches, in order of their first use; a look-up of a new word adds it."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Hasher:
    """crc32 of runs of words joined by a space: a run's crc is that of the run before its last word, moved on by the last
    word's bytes, and the last word's own."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.shift = np.uint32(buckets), _shift_tables()

    def _then(self, crc: np.ndarray, codes: np.ndarray, own: np.ndarray, length: np.ndarray, spaced: list[bytes]) -> np.ndarray:
        """crc of runs, each with one more word."""
        n, s = np.minimum(length[codes], TABLED), self.shift
        out = s[n, 0, crc & 255] ^ s[n, 1, crc >> 8 & 255] ^ s[n, 2, crc >> 16 & 255] ^ s[n, 3, crc >> 24] ^ own[codes]
        for i in np.flatnonzero(length[codes] > TABLED):
            out[i] = zlib.crc32(spaced[codes[i]], int(crc[i]))
        return out

    def runs(self, pieces: list[tuple[int, int, list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """pieces: document, how many words at the start are carried over, words. Gives, for runs of each length, the
        document and bucket of those that end in a word that isn't carried over."""
        known = Words()
        codes = np.array([known[w] for _, _, words in pieces for w in words], np.int64)
        if not len(codes):
            return
        spaced = [b" " + w for w in known]
        first = np.array([zlib.crc32(w) for w in known], np.uint32)
        own, length = np.array([zlib.crc32(w) for w in spaced], np.uint32), np.array([len(w) for w in spaced])
        sizes = np.array([len(words) for _, _, words in pieces])
        doc = np.repeat([d for d, _, _ in pieces], sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        new = place >= np.repeat([c for _, c, _ in pieces], sizes)
        crc = first[codes]
        for run in range(1, LONGEST_RUN + 1):
            if run > 1:  # crc[i]: the run that ends at i
                crc = np.concatenate([crc[:1], self._then(crc[:-1], codes[1:], own, length, spaced)])
            ends = new & (place >= run - 1)
            yield doc[ends], crc[ends] % self.buckets


def stretches(texts: list[str | None]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """The words of whole texts in groups of about STRETCH."""
    group, size = [], 0
    for d, text in enumerate(texts):
        words = text.encode().translate(AS_WORDS).split() if text else []
        for at in range(0, len(words), STRETCH):
            carry = min(at, LONGEST_RUN - 1)
            part = words[at - carry : at + STRETCH]
            group.append((d, carry, part))
            size += len(part)
            if size >= STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts; a task sends one row a bucket it has met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for group in stretches(list(batch["text"])):
                for _, bucket in hasher.runs(group):
                    counts += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": met.astype(np.int32), "n": counts[met]})

    parts = texts.select(F.col(text_col).alias("text")).mapInPandas(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed shares, in thousandths."""
    all_s, all_t, n = float(documents.sum()), float(target.sum()), float(len(documents))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def noise(doc_id: str | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(len(gain))
        for batch in batches:
            n = len(batch)
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for group in stretches(list(batch["text"])):
                for run_length, (doc, bucket) in enumerate(hasher.runs(group)):
                    count = np.bincount(doc, minlength=n)
                    features += count
                    if run_length == 0:
                        words += count
                    # Documents ascend, so each one's gains are a stretch of one running sum: whole numbers stay exact.
                    ends = np.concatenate([[0], np.cumsum(gain[bucket])])
                    stop = np.cumsum(count)
                    weight += ends[stop] - ends[stop - count]
            ids = [None if pd.isna(i) else i for i in batch["doc_id"]]
            yield pd.DataFrame({"doc_id": ids, "n_words": words, "n_features": features, "weight": weight, "score": weight + np.array([noise(i, seed) for i in ids], np.int64)})

    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, "doc_id string, n_words long, n_features long, weight long, score long"))


def bracket(scores: DataFrame, k: int, n: int, by: str = "score", accuracy: int = ACCURACY) -> tuple[float, float, int]:
    """low, high and how many lie above high: the k-th highest of n scores is from low to high, as exact counts show."""
    slack = 2 / accuracy
    while True:
        share = 1 - k / n
        # Beyond the ends there is nothing to ask the sketch for.
        asked = [max(0.0, share - slack), min(1.0, share + slack)]
        low, high = scores.agg(F.percentile_approx(by, asked, accuracy)).first()[0]
        low, high = -math.inf if asked[0] == 0 else low, math.inf if asked[1] == 1 else high
        above, within = scores.agg(F.count_if(F.col(by) > high), F.count_if((F.col(by) >= low) & (F.col(by) <= high))).first()
        if above < k <= above + within:
            return low, high, above
        slack *= 4


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores from a written table, with rank: 1, 2, 3 of the drawn rows, null of all others."""
    able = scores.filter(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    if not k:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(able, k, n)
    s = F.col("score")
    ordered = able.withColumns({"_down": -s, "_null": F.col("doc_id").isNull(), "_weight": -F.col("weight")})
    order = ["_down", "_null", "doc_id", "_weight", "n_features"]
    near = numbered(ordered.filter((s >= low) & (s <= high)), order, "bracket")
    rank = F.col("place") + above + 1
    near = near.withColumn("rank", F.when(rank <= k, rank))
    parts = [near, scores.filter(F.coalesce(F.col("n_words") < least_words, F.lit(True)) | (s < low)).withColumn("rank", F.lit(None).cast("long"))]
    if above:
        parts.append(numbered(ordered.filter(s > high), order, "above").withColumn("rank", F.col("place") + 1))
    columns: list[str | Column] = [*scores.columns, "rank"]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(columns))
    return out


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; the drawn have a rank."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    return drawn(written(scored(docs, gain, seed=seed), "scores"), percent, least_words)


def op11_bracketed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
