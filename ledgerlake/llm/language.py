"""Language by a convolutional network over bytes.

A text, in lower case and UTF-8, is cut into windows of WINDOW bytes, the last one filled up with zeros. Filters of several
widths slide over a window; as the input is one byte of 256 at each place, a filter is a table of weights by offset and byte,
and its value at a place is the sum of as many look-ups as it is wide. The highest value of each filter within the window
(max pooling, cut off at zero) goes to a layer with softmax. A text's probabilities are the mean of its windows', each window
counted by its letters (bytes of letters a to z and beyond ASCII), over the whole text.

Training is plain numpy on the driver: Adam on cross entropy, where only the place that won a filter's pooling gets a
gradient. It sees at most LANGUAGES languages (those with the most labelled texts), of each at most PER_LANGUAGE labelled
texts (those of the smallest hash of id and text), and of each text at most PER_TEXT windows, spread evenly over all of it:
PER_LANGUAGE * PER_TEXT * WINDOW bytes a language, whatever the size of texts and tables.

Edge cases. Null texts and texts without a letter (Unicode) are UNKNOWN with score 0, and so is every text if no language was
learned; a single language learned is everyone's. Null ids have the text "" where their crc32 is asked for; labels that are
null teach nothing. Rows that repeat an id are judged one by one. Texts of any length go through in batches of BATCH windows.
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, ids_back, table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
#: The bounds of what is learned from.
LANGUAGES, PER_LANGUAGE, PER_TEXT = 64, 400, 4
EPOCHS, STEP, RATE, DECAY, SEED = 12, 64, 0.01, 1e-4, 7
#: Windows in the network at a time.
BATCH = 512
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]").search
IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def has_letter(text: str) -> bool:
    """LETTER also meets numerals that are no digits; isalpha() has the last word."""
    found = LETTER(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


def windows(text: str | None) -> np.ndarray:
    """All bytes of the text as rows of WINDOW."""
    raw = (text or "").lower().encode()
    rows = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class ByteNetwork:
    """filters: for each width an array [offset, byte, filter]; biases of all filters, then the last layer's weights."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> ByteNetwork:
        r = np.random.default_rng(seed)
        filters = [(r.normal(0, 0.3, (w, 256, FILTERS)) / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(languages, filters, np.zeros(n, np.float32), r.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the filters' values [window, place, filter]."""
        for w, width in zip(self.filters, WIDTHS):
            places = x.shape[1] - width + 1
            z = w[0].take(x[:, :places], axis=0)
            for j in range(1, width):
                z += w[j].take(x[:, j : j + places], axis=0)
            yield z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([z.max(axis=1) for z in self.responses(x)], axis=1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted cross entropy, in the order of parameters()."""
        best = [(z.argmax(axis=1), z) for z in self.responses(x)]
        pooled = np.concatenate([np.take_along_axis(z, at[:, None], axis=1)[:, 0] for at, z in best], axis=1) + self.bias
        hidden = np.maximum(pooled, 0)
        d = softmax(hidden @ self.out + self.out_bias)
        d[np.arange(len(y)), y] -= 1
        d *= (weight / weight.sum())[:, None]
        back = (d @ self.out.T) * (pooled > 0)
        found = []
        for k, ((at, _), width) in enumerate(zip(best, WIDTHS)):
            g = np.zeros((width, 256, FILTERS), np.float32)
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                np.add.at(g[j], (np.take_along_axis(x, at + j, axis=1), np.arange(FILTERS)[None, :]), part)
            found.append(g)
        return [*found, back.sum(0), hidden.T @ d, d.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork:
    """x: windows; y: each one's place in languages. A language counts the same however many windows it has, a window by
    its letters."""
    net = ByteNetwork.fresh(languages, seed)
    letters = IS_LETTER[x].sum(1).astype(np.float32)
    per = np.bincount(y, weights=letters, minlength=len(languages)).astype(np.float32)
    weight = letters / np.maximum(per, 1)[y]
    x, y, weight = x[letters > 0], y[letters > 0], weight[letters > 0]
    order, r, t = np.arange(len(y)), np.random.default_rng(seed), 0
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for epoch in range(epochs):
        r.shuffle(order)
        for at in range(0, len(order), STEP):
            some, t = order[at : at + STEP], t + 1
            for p, g, m, v in zip(net.parameters(), net.gradients(x[some], y[some], weight[some]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - epoch / epochs) * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + DECAY * p)
    return net


def sample(docs: DataFrame, may_learn: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and lang of the rows that are learned from.

    A row's hash, as a share of all hashes, is held against twice the share of its language's rows that is wanted. So tasks
    send on as many rows of a language as twice the bound, whatever there are, and the smallest hashes of those are taken.
    Rows that are equal in id and text count once."""
    rows = docs.filter(F.coalesce(may_learn, F.lit(False)) if may_learn is not None else F.lit(True))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_at")).filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "lang").limit(LANGUAGES)
    share = F.shiftrightunsigned("_at", 11) / float(1 << 53)
    few = rows.filter("text IS NOT NULL").join(F.broadcast(sizes), "lang").filter(share * F.col("_n") < 2 * PER_LANGUAGE)
    first = few.groupBy("lang", "_at").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("_at", 11), "_at"))
    return first.withColumn("_nth", nth).filter(F.col("_nth") <= PER_LANGUAGE).select("lang", "text", "_at")


def trained(rows: DataFrame) -> ByteNetwork | None:
    """rows: sample(). What comes to the driver is the windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for lang, text, at in zip(batch["lang"], batch["text"], batch["_at"].tolist()):
                x = windows(text)
                for i in np.unique(np.linspace(0, len(x) - 1, PER_TEXT).round().astype(int)) if len(x) else ():
                    if IS_LETTER[x[i]].any():
                        found.append((lang, at, int(i), x[i].tobytes()))
            yield pd.DataFrame(found, columns=["lang", "at", "i", "x"])

    got = rows.mapInPandas(run, "lang string, at long, i int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "at", "i"], kind="stable")
    languages = sorted(set(got["lang"]))
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), WINDOW)
    return fit(x, got["lang"].map({lang: n for n, lang in enumerate(languages)}).to_numpy(), languages)


def judged(net: ByteNetwork, texts: list[str]) -> np.ndarray:
    """A row of probabilities for each text, by all its windows."""
    totals, weights = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))

    def add(group: list[tuple[int, np.ndarray]]) -> None:
        x = np.concatenate([part for _, part in group])
        doc = np.repeat([d for d, _ in group], [len(part) for _, part in group])
        letters = IS_LETTER[x].sum(1)
        some = letters > 0
        if some.any():
            p = net.probabilities(x[some]) * letters[some, None]
            for c in range(p.shape[1]):
                totals[:, c] += np.bincount(doc[some], weights=p[:, c], minlength=len(texts))
            weights[:] += np.bincount(doc[some], weights=letters[some], minlength=len(texts))

    group, size = [], 0
    for d, text in enumerate(texts):
        x = windows(text)
        for at in range(0, len(x), BATCH):
            part = x[at : at + BATCH]
            if group and size + len(part) > BATCH:
                add(group)
                group, size = [], 0
            group.append((d, part))
            size += len(part)
    if group:
        add(group)
    return totals / np.maximum(weights, 1)[:, None]


def identified(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, from the text alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net is not None and t is not None and has_letter(t)]
            if known:
                p = judged(net, [texts[i] for i in known])
                for i, row in zip(known, p):
                    pred[i], score[i] = net.languages[row.argmax()], min(1.0, float(row.max()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": pred, "score": score})

    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, "doc_id string, lang_pred string, score double"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op13_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = trained(sample(docs, ~held_out(F.col("doc_id"))))
    return identified(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
