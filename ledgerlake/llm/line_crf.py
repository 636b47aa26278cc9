"""Quality rules by line-sequence labelling.

A linear-chain conditional random field marks each line as content or boilerplate; Viterbi decoding finds the best
labelling of the whole text, and the share of words in content lines decides whether the text is kept. Words are
counted, and lines labelled, over the whole text.

The field is fitted on the lines of a bounded sample of labelled documents (labelled.SAMPLE), STRETCHES * STRETCH of them at
most, drawn by hash from all over whole texts: a few very long ones don't decide the driver's memory. Lines of good documents stand for content, lines of bad ones for boilerplate, but a line that repeats an earlier one is boilerplate
anywhere. The model is a few dozen numbers, fitted by gradient ascent on the conditional likelihood.

Edge cases. Null, empty and wordless texts have no words and fail the base rule. A text of any length is labelled in
time linear in its lines. Ties between labellings go to content. Without labels of both kinds every line is content.
Rows that repeat an id are judged one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, ids_back, table
from .labelled import SAMPLE, labelled_sample
from .lines import FEATURES, base_counts, bits, line_masks

#: In fitting, texts are cut into stretches of so many lines, all of which are used: only the steps from one stretch to
#: the next are not. Decoding runs over whole texts.
STRETCH = 64
#: Stretches of the sample that the model is fitted on, at most: those of the smallest hash of document and place.
STRETCHES = 8000
CONTENT_SHARE = 0.5
LEAST_WORDS = 50
DUPLICATE = 1 << FEATURES.index("repeats an earlier line")
#: Steps of gradient ascent, their size, and the weight of the squared norm.
STEPS, RATE, NORM = 120, 0.1, 1e-3


class LineField:
    """Scores: a line's features times `weights` plus `bias` speak for boilerplate; `steps[a][b]` for label b after a."""

    def __init__(self, weights: np.ndarray, bias: float, steps: np.ndarray):
        self.weights, self.bias, self.steps = weights, bias, steps
        self.known: dict[int, float] = {}

    def score(self, mask: int) -> float:
        found = self.known.get(mask)
        if found is None:
            found = self.known[mask] = self.bias + float(sum(w for i, w in enumerate(self.weights) if mask >> i & 1))
        return found

    def labels(self, masks: list[int]) -> list[int]:
        """Viterbi: 0 content, 1 boilerplate."""
        if not masks:
            return []
        (cc, cb), (bc, bb) = self.steps.tolist()
        c, b, back = 0.0, self.score(masks[0]), []
        for mask in masks[1:]:
            from_c, from_b = c + cb >= b + bb, c + cc >= b + bc
            back.append((0 if from_b else 1, 0 if from_c else 1))
            c, b = (c + cc if from_b else b + bc), (c + cb if from_c else b + bb) + self.score(mask)
        label = 0 if c >= b else 1
        out = [label]
        for to_c, to_b in reversed(back):
            label = to_b if label else to_c
            out.append(label)
        return out[::-1]


def fit(sequences: list[list[int]], labels: list[int]) -> LineField:
    """sequences: the line masks of each document; labels: 1 for a good document, 0 for a bad one."""
    k = len(FEATURES)
    kept = [(s[at : at + STRETCH], good) for s, good in zip(sequences, labels) for at in range(0, len(s), STRETCH)]
    if len({good for _, good in kept}) < 2:
        return LineField(np.zeros(k), -1.0, np.zeros((2, 2)))
    n, t = len(kept), max(len(s) for s, _ in kept)
    x, y, here = np.zeros((t, n, k)), np.zeros((t, n), int), np.zeros((t, n), bool)
    for i, (s, good) in enumerate(kept):
        x[: len(s), i], here[: len(s), i] = bits(s), True
        y[: len(s), i] = [int(not good or bool(m & DUPLICATE)) for m in s]
    w, bias, steps = np.zeros(k), 0.0, np.zeros((2, 2))
    total = here.sum()
    pairs = np.zeros((2, 2))
    both = here[1:] & here[:-1]
    np.add.at(pairs, (y[:-1][both], y[1:][both]), 1)
    moment = [np.zeros(k + 5), np.zeros(k + 5)]
    for step in range(1, STEPS + 1):
        emit = np.zeros((t, n, 2))
        emit[:, :, 1] = x @ w + bias
        alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
        alpha[0] = emit[0]
        for j in range(1, t):
            new = np.logaddexp(alpha[j - 1, :, None, 0] + steps[0], alpha[j - 1, :, None, 1] + steps[1]) + emit[j]
            alpha[j] = np.where(here[j][:, None], new, alpha[j - 1])
        for j in range(t - 2, -1, -1):
            ahead = beta[j + 1] + emit[j + 1]
            new = np.logaddexp(steps[:, 0] + ahead[:, None, 0], steps[:, 1] + ahead[:, None, 1])
            beta[j] = np.where(here[j + 1][:, None], new, 0.0)
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z) * here
        off = (y - p1) * here
        joint = np.exp(alpha[:-1, :, :, None] + steps + (emit + beta)[1:, :, None, :] - z[None, :, None, None]) * both[:, :, None, None]
        grad = np.concatenate([np.einsum("tnk,tn->k", x, off), [off.sum()], (pairs - joint.sum((0, 1))).ravel()]) / total
        params = np.concatenate([w, [bias], steps.ravel()])
        grad -= NORM * params
        moment = [0.9 * moment[0] + 0.1 * grad, 0.999 * moment[1] + 0.001 * grad**2]
        params += RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w, bias, steps = params[:k], float(params[k]), params[k + 1 :].reshape(2, 2)
    return LineField(w, bias, steps)


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, stretches: int = STRETCHES) -> LineField:
    """Features are taken on the executors; only masks of the bounded sample come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(batch["_id"], batch["text"], batch["label"]):
                masks = line_masks(text)[0]
                rows += [(doc_id, at, masks[at : at + STRETCH], label) for at in range(0, len(masks), STRETCH)]
            yield pd.DataFrame(rows, columns=["_id", "at", "masks", "label"])

    rows = labelled_sample(docs, labels, "quality", most).mapInPandas(run, "_id long, at int, masks array<int>, label int")
    rows = rows.orderBy(F.xxhash64("_id", "at"), "_id", "at").limit(stretches).toPandas().sort_values(["_id", "at"], kind="stable")
    return fit([list(m) for m in rows["masks"]], rows["label"].tolist())


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(text: str | None, field: LineField) -> tuple:
    n_words, chars, symbols, dup, repeats = base_counts(text)
    failed = n_words < LEAST_WORDS or 100 * repeats > 50 * n_words
    masks, counts = line_masks(text)
    content = sum(n for n, label in zip(counts, field.labels(masks)) if not label)
    share = content / n_words if n_words else 0.0
    return n_words, chars, symbols, dup, repeats, failed, share, not failed and share >= CONTENT_SHARE


def judged(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([judge(t, field) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, "doc_id string, " + JUDGED))


def filtered(docs: DataFrame, field: LineField) -> DataFrame:
    """The documents that are kept, with all their columns and in one pass over the texts."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t, field)[-1] for t in texts], dtype=bool)

    return docs.filter(keep("text"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, trained(docs, table(spark, sf_dir, "labels")))
