"""Quality by hierarchical empirical Bayes: a document's own evidence with the standing of its host and path.

A logistic classifier, fitted on a bounded sample of labelled documents (labelled.SAMPLE), gives each document a
probability from the look of its whole text. Sums of these per path, and of the paths per host, give posterior means
in two levels: a host's mean is drawn to the corpus mean, a path's to its host's, each by a prior strength that is
estimated from the data by the method of moments: the variance between hosts, and between the paths of one host, against
that within them. So sparse sites stay near the prior. A document's own share is taken out of its host and path before
they speak for it. The final log odds
are the document's, plus how far its path's log odds lie from the corpus's, at a set weight.

Sums are pre-aggregated before any shuffle, so a source of any size is one row a task. The site table goes back to the
documents by a join on (host, path) of narrow rows, that adaptive execution can split where a site is hot.

Edge cases. Null hosts or paths are sites of their own, beside those of an empty name. Null and empty texts have the features of an
empty text. Without labels of both kinds every document has even odds. A single site has no variance between sites and
gets the strongest prior. Rows that repeat an id are judged one by one; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_back, table, words_of, written
from .labelled import SAMPLE, labelled_sample
from .lines import FEATURES, line_masks, repeat_words

STEPS, RATE, NORM = 400, 0.2, 1e-3
#: Weight of a site's log odds beside the document's, bounds of a prior's strength in documents.
SITE_WEIGHT = 0.5
STRENGTHS = (1.0, 1e6)
KEEP_FROM = 0.5
#: Stands for a null host or path.
NONE = "\0none"
BITS = np.arange(len(FEATURES))


def features(text: str | None) -> np.ndarray:
    """Shares of words in lines of each kind, repeats, size."""
    masks, counts = line_masks(text)
    words = words_of(text)
    n = len(words)
    out = np.zeros(len(FEATURES) + 4)
    if n:
        out[: len(FEATURES)] = np.asarray(counts, float) @ ((np.asarray(masks)[:, None] >> BITS) & 1) / n
        out[-4] = repeat_words(words) / n
        out[-3] = len(set(words)) / n
    out[-2] = np.log1p(n) / 10
    out[-1] = n < 20
    return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m1, m2 = np.zeros(x.shape[1]), 0.0, 0.0
    if len(set(y.tolist())) < 2:
        return w
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (y - p) / len(y) - NORM * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w = w + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "x": [features(t) for t in batch["text"]], "label": batch["label"]})

    rows = labelled_sample(docs, labels, "quality", most).mapInPandas(run, "_id long, x array<double>, label int").toPandas()
    rows = rows.sort_values("_id", kind="stable")
    return fit(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES) + 4), rows["label"].to_numpy(float))


def evidence(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, p: the classifier's probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES) + 4)
            z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            yield batch[["doc_id", "host", "path"]].assign(p=1 / (1 + np.exp(-z)))

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(host, F.lit(NONE)).alias("host"), F.coalesce(path, F.lit(NONE)).alias("path"), F.col(text_col).alias("text"))
    return ids_back(rows.mapInPandas(run, "doc_id string, host string, path string, p double"))


def strength(groups: DataFrame, parent: str | None = None) -> float:
    """Prior strength of groups with n, s (sum) and q (sum of squares), by the method of moments: how far groups of one
    parent (None: of all) lie apart, against how far documents of one group do. One row comes back."""
    parents = groups.groupBy(F.col(parent) if parent else F.lit("all")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    row = parents.agg(
        F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum(F.col("q") - F.col("own")).alias("within"), F.sum(F.col("k") - 1).alias("free"),
        F.sum(F.col("own") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("n") - F.col("squares") / F.col("n")).alias("size"),
    ).first()
    low, high = STRENGTHS
    if not row["k"] or row["free"] < 1 or row["n"] <= row["k"]:
        return high
    within = max(1e-9, row["within"] / (row["n"] - row["k"]))
    spread = (row["between"] - row["free"] * within) / max(1e-9, row["size"])
    return float(min(high, max(low, within / spread))) if spread > 0 else high


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def combined(scores: DataFrame, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """scores: doc_id, host, path, p from a written table. Adds host_quality, path_quality, quality, kept."""
    paths = written(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    by_host, by_path = strength(hosts), strength(paths, "host")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, "host").select("host", "path", "n", "s", "host_n", "host_s")
    # A document speaks for itself once: its share is out of its host's and its path's sums.
    host = (F.col("host_s") - F.col("p") + by_host * mean) / (F.col("host_n") - 1 + by_host)
    own = (F.col("s") - F.col("p") + by_path * F.col("host_quality")) / (F.col("n") - 1 + by_path)
    joined = scores.join(sites, ["host", "path"]).withColumn("host_quality", host).withColumn("path_quality", own)
    odds = _odds(F.col("p")) + site_weight * (_odds(F.col("path_quality")) - _odds(F.lit(float(mean))))
    quality = 1 / (1 + F.exp(-odds))
    known = lambda c: F.nullif(F.col(c), F.lit(NONE)).alias(c)
    return joined.select("doc_id", known("host"), known("path"), "p", "host_quality", "path_quality", quality.alias("quality"), (quality >= KEEP_FROM).alias("kept"))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a web address."""
    text = url.cast("string")
    return F.lower(F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def op1_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no address: their source stands for the host, their language for the path."""
    docs = table(spark, sf_dir, "documents")
    weights = trained(docs, table(spark, sf_dir, "labels"))
    return combined(written(evidence(docs, weights, F.col("source"), F.col("lang")), "evidence"))
