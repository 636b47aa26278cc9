"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(score - threshold_k) with one score for all k and thresholds in ascending order. The score is
a weighted sum over a vocabulary of log(1 + occurrences) of each word, and of the vocabulary's toxic words taken
together: their number, and their number per word of text. The whole text is read; the output is the expected severity, the sum of P(grade >= k).

The vocabulary is chosen by grouped aggregation over a bounded sample of labelled documents (SAMPLE): all words whose
presence tells toxic from other documents beyond chance. What counts as chance follows the number of labels and words: a
share of FALSE of the chosen words is expected to be there by chance (Benjamini and Hochberg's bound on the likelihood
ratios' tail probabilities, over all words that are tested, those of SUPPORT documents or more). A word must also stand
behind about as many different words as it has documents: the words of one much copied document don't. How many words have
which counts is enough to find the bound; the chosen words alone come to the driver.

Grades are those of the labels: of labels 0 and 1 there is one threshold, severity is 0 or 1 and the expected severity the
probability of being toxic. The output's column grades says how many there were to learn from. Weights are fitted on that
sample by gradient ascent.

Edge cases. Null and wordless texts have no features and the grade that the thresholds give to a score of zero. Without
labels of both kinds nothing is toxic. A text of any length counts whole. Rows that repeat an id are scored one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, ids_back, table, written
from .labelled import labelled_sample

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
FALSE = 0.05
#: Documents that a word is in at least to be tested: fewer prove nothing.
SUPPORT = 3
STEPS, RATE, NORM = 400, 0.1, 1e-3
TOXIC_FROM = 0.5

WORD = re.compile(r"[^\W\d_]+").findall


class Severity:
    """weights: word to weight; toxic: the words that count together; thresholds ascending, one fewer than grades."""

    def __init__(self, weights: dict[str, float], toxic: frozenset[str], together: tuple[float, float], thresholds: list[float]):
        self.weights, self.toxic, self.together, self.thresholds = weights, toxic, together, thresholds

    def score(self, text: str | None) -> tuple[float, list[float]]:
        words = WORD(text.lower()) if text else []
        weights = self.weights
        seen = Counter([w for w in words if w in weights])
        score = sum(weights[w] * np.log1p(n) for w, n in seen.items())
        score += sum(w * x for w, x in zip(self.together, together(sum(n for w, n in seen.items() if w in self.toxic), len(words))))
        return float(score), [float(1 / (1 + np.exp(min(700.0, t - score)))) for t in self.thresholds]


def together(hits: int, words: int) -> tuple[float, float]:
    return float(np.log1p(hits)), float(np.log1p(100 * hits / words)) if words else 0.0


def likelihood_ratio(a: np.ndarray, n: float, b: np.ndarray, m: float) -> np.ndarray:
    """Twice the log likelihood ratio of presence in a of n against b of m documents."""

    def part(k, of, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


def beyond_chance(ratios: np.ndarray, counts: np.ndarray, false: float = FALSE) -> float:
    """The least ratio that counts: of the words from there on a share of `false` is expected by chance. counts: how many
    words have each ratio."""
    order = np.argsort(-ratios, kind="stable")
    chance = np.array([math.erfc(math.sqrt(max(r, 0.0) / 2)) for r in ratios[order]])  # of chi-square with one degree of freedom
    so_far = np.cumsum(counts[order])
    held = np.flatnonzero(chance <= false * so_far / counts.sum())
    return float(ratios[order][held[-1]]) if len(held) else math.inf


def vocabulary(sample: DataFrame, support: int = SUPPORT) -> list[tuple[str, int]]:
    """The words that tell, with 1 for those of toxic documents and 0 for those of others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["word", "before", "toxic", "first"]
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"]):
                words = WORD((text or "").lower())
                seen: set[str] = set()
                for w, before in dict.fromkeys(zip(words, ["", *words])):
                    rows.append((w, before, int(label > 0), int(w not in seen)))
                    seen.add(w)
                if len(rows) > 50_000:  # a text gives a row a word: not all of a batch's at once
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    sizes = {int(r["toxic"]): r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    n, m = sizes[1], sizes[0]
    bad, good = F.col("toxic") * F.col("first"), (1 - F.col("toxic")) * F.col("first")
    rows = sample.mapInPandas(run, "word string, before string, toxic int, first int")
    seen = rows.groupBy("word", "before").agg(F.sum(bad).alias("a"), F.sum(good).alias("b"), F.max("toxic").alias("in_a"), F.max(1 - F.col("toxic")).alias("in_b"))
    words = seen.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("a", "b", "in_a", "in_b")]).filter("2 * in_a >= a and 2 * in_b >= b")
    words = written(words.filter(F.col("a") + F.col("b") >= support).select("word", "a", "b"), "tested-words")
    # How many words are in a toxic and b other documents: pairs of small numbers, at most one for each document of the sample and few more.
    pairs = words.groupBy("a", "b").agg(F.count(F.lit(1)).alias("words")).toPandas()
    if pairs.empty:
        return []
    ratios = likelihood_ratio(pairs["a"].to_numpy(float), n, pairs["b"].to_numpy(float), m)
    told = pairs[ratios >= beyond_chance(ratios, pairs["words"].to_numpy())]
    if told.empty:
        return []
    chosen = sample.sparkSession.createDataFrame(told[["a", "b"]].astype("int64"))
    found = words.join(F.broadcast(chosen), ["a", "b"]).toPandas().sort_values("word")
    return list(zip(found["word"], (found["a"] / n > found["b"] / m).astype(int).tolist()))


def fit(x: np.ndarray, grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds; the gaps between thresholds are exponentials, so their order holds."""
    n, k = x.shape
    y = (grades[:, None] >= np.arange(1, levels)).astype(float)
    w, first, gaps = np.zeros(k), 0.0, np.zeros(levels - 2)
    moment = [np.zeros(k + levels - 1), np.zeros(k + levels - 1)]

    def thresholds() -> np.ndarray:
        return first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])

    for step in range(1, STEPS + 1):
        z = np.clip((x @ w)[:, None] - thresholds(), -500, 500)
        # Categories' probabilities are differences of neighbouring cumulative ones.
        upper = 1 / (1 + np.exp(-z))
        cum = np.hstack([np.ones((n, 1)), upper, np.zeros((n, 1))])
        own = np.clip(cum[np.arange(n), grades] - cum[np.arange(n), grades + 1], 1e-12, None)
        slope = np.hstack([np.zeros((n, 1)), upper * (1 - upper), np.zeros((n, 1))])
        by_z = np.zeros((n, levels + 1))
        by_z[np.arange(n), grades] += slope[np.arange(n), grades] / own
        by_z[np.arange(n), grades + 1] -= slope[np.arange(n), grades + 1] / own
        by_z = by_z[:, 1:levels]
        grad_w, grad_t = x.T @ by_z.sum(1) / n, -by_z.sum(0) / n
        tails = np.cumsum(grad_t[::-1])[::-1]
        grad = np.concatenate([grad_w - NORM * w, [tails[0]], tails[1:] * np.exp(gaps)])
        moment = [0.9 * moment[0] + 0.1 * grad, 0.999 * moment[1] + 0.001 * grad**2]
        move = RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w + move[:k], first + float(move[k]), np.clip(gaps + move[k + 1 :], -5, 5)
    return w, thresholds()


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Severity:
    sample = labelled_sample(docs, labels, "toxic", most)
    words = vocabulary(sample)
    if not words:
        return Severity({}, frozenset(), (0.0, 0.0), [50.0])
    at = {w: i for i, (w, _) in enumerate(words)}
    toxic = frozenset(w for w, is_toxic in words if is_toxic)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label, doc_id in zip(batch["text"], batch["label"], batch["_id"]):
                found = WORD((text or "").lower())
                seen = Counter([w for w in found if w in at])
                hits = sum(n for w, n in seen.items() if w in toxic)
                rows.append((doc_id, label, [at[w] for w in seen], list(seen.values()), list(together(hits, len(found)))))
            yield pd.DataFrame(rows, columns=["_id", "label", "words", "counts", "density"])

    rows = sample.mapInPandas(run, "_id long, label int, words array<int>, counts array<int>, density array<double>").toPandas().sort_values("_id", kind="stable")
    x = np.zeros((len(rows), len(words) + 2))
    for i, (ids, counts, density) in enumerate(zip(rows["words"], rows["counts"], rows["density"])):
        x[i, np.asarray(ids, int)] = np.log1p(np.asarray(counts, float))
        x[i, -2:] = density
    grades = rows["label"].to_numpy(int)
    w, thresholds = fit(x, grades, int(grades.max()) + 1)
    return Severity({word: float(v) for (word, _), v in zip(words, w)}, toxic, (float(w[-2]), float(w[-1])), thresholds.tolist())


def scored(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_severity, severity (most likely grade), p_toxic, toxic, grades."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                score, over = model.score(text)
                cum = [1.0, *over, 0.0]
                grade = int(np.argmax([a - b for a, b in zip(cum, cum[1:])]))
                rows.append((score, sum(over), grade, over[0], over[0] >= TOXIC_FROM, len(over) + 1))
            out = pd.DataFrame(rows, columns=["score", "expected_severity", "severity", "p_toxic", "toxic", "grades"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = "doc_id string, score double, expected_severity double, severity int, p_toxic double, toxic boolean, grades int"
    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema))


def filtered(docs: DataFrame, model: Severity) -> DataFrame:
    """The documents that are not toxic, with all their columns, in one pass."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t)[1][0] < TOXIC_FROM for t in texts], dtype=bool)

    return docs.filter(keep("text"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
