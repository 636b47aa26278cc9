"""Substring deduplication by level-wise doubling.

A window of `window` words is removed wherever its words also start anywhere else. Windows are found from short to
long, at lengths that double from level to level (levels(): 9, 18 and 35 words for windows of 35): those repeated at one
length, and those alone, are extended to twice that length (at most the window's), until the full length is reached or no
candidates are left.

Level 1 needs not all short windows: the leftmost short window of smallest hash is a full window's anchor, and equal
full windows have equal anchors in the same places. So only anchors are counted, about one word in fourteen. At each
further level the short window that stands for a full one grows to the right where that stays inside the full window, else
to the left, again in the same way in equal windows; there are two extensions of a survivor at most. At the last level
every full window whose stand-in was repeated counts by a 96-bit hash of its words.

Counting is the same at all levels. Each task first counts within what it has read (ROWS rows at a time): what is
repeated there is known and leaves as runs of neighbouring places, and one row for each distinct hash goes into the
shuffle. So a passage that a third of all documents share is a row a task, not a row a document, and no task gets more of
it. After the shuffle, equal hashes lie side by side.

Equal texts are one text (by a 128-bit hash) with a count. All windows of a text that occurs twice are repeated, and one
copy, which counts double, stands for all from level 2 on.

Edge cases. Null, empty and short texts (under `window` words) lose nothing and count for nothing. Copies of one text
of at least `window` words lose every word, also where the rows repeat an id. Windows may overlap themselves. A text of
any length counts whole. Ids may be null or any long. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_back, table, words_of, written

WINDOW = 35
#: No level has shorter windows.
SHORTEST = 8
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: n: 1 or 2 (or more) windows of this hash; below zero, a run of that many known places (h is of no meaning then).
ROW = "h long, chk int, n int, th long, th2 long, at int"
#: An anchor's row also says whether it grows to the right (1) and left (2), and the hashes of both.
ANCHOR = ROW + ", ways int, to_right long, to_left long"
#: Rows that a task counts within itself at a time.
ROWS = 500_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every window of `length` words, from windows of 1, 2, 4 ... words."""
    done, have, part, size = None, 0, h, 1
    while True:
        shift = np.uint64(pow(base, size, 1 << 64))
        if length & size:
            if done is None:
                done, have = part, size
            else:
                n = len(h) - have - size + 1
                done, have = done[:n] * shift + part[have : have + n], have + size
        if 2 * size > length:
            return done[: len(h) - length + 1]
        n = len(part) - size
        part, size = part[:n] * shift + part[size : size + n], 2 * size


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(window: int) -> list[int]:
    """Lengths from short to long, each at most twice the one before."""
    lengths = [window]
    while (lengths[0] + 1) // 2 >= SHORTEST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = least(x[:-size], x[size:]), 2 * size
    rest = width - size
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest of every `width` neighbours."""
    least = sliding(g, width)
    pad = np.zeros(width - 1, np.uint64)
    some = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == g)  # smallest of a window
    at = np.searchsorted(some, np.arange(len(least)))
    off = np.flatnonzero(g[some[at]] != least)
    while len(off):  # a smallest one of earlier windows alone
        at[off] += 1
        off = off[g[some[at[off]]] != least[off]]
    return some[at]


def stand_ins(h: np.ndarray, window: int, level: int) -> Iterator[np.ndarray]:
    """For levels 0 to `level`: the place of the window of that level's length that stands for each full window."""
    lengths = levels(window)
    at = least_places(mixed(grams(h, lengths[0], BASES[0])), window - lengths[0] + 1)
    starts = np.arange(len(at))
    yield at
    for short, long in zip(lengths, lengths[1 : level + 1]):
        at = starts if long == window else np.where(at + long <= starts + window, at, at + short - long)
        yield at


def counted(h: np.ndarray, chk: np.ndarray, weight: np.ndarray, at: np.ndarray, th: np.ndarray, th2: np.ndarray, extra: dict[str, np.ndarray] | None = None) -> pd.DataFrame:
    """ROWs of what a task has read: one a distinct hash with its count (2 stands for more), and runs of known places;
    with `extra` columns, which belong to single places, no run is longer than one."""
    order = np.lexsort((chk, h))
    h, chk, weight, at, th, th2 = (x[order] for x in (h, chk, weight, at, th, th2))
    extra = {k: x[order] for k, x in (extra or {}).items()}
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (chk[1:] != chk[:-1])])
    totals = np.minimum(np.add.reduceat(weight, starts), 2).astype(np.int32)
    one = pd.DataFrame({"h": h[starts].view(np.int64), "chk": chk[starts], "n": totals, "th": th[starts], "th2": th2[starts], "at": at[starts]} | {k: x[starts] for k, x in extra.items()})
    known = np.flatnonzero(np.repeat(totals, np.diff(np.r_[starts, len(h)])) > 1)
    if not len(known):
        return one
    if not extra:
        known = known[np.lexsort((at[known], th2[known], th[known]))]
    at, th, th2 = at[known], th[known], th2[known]
    first = np.ones(len(known), bool)
    if not extra:
        first[1:] = (th[1:] != th[:-1]) | (th2[1:] != th2[:-1]) | (at[1:] > at[:-1] + 1)
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(known)] - 1
    length = (at[ends] - at[starts] + 1).astype(np.int32)
    at, th, th2 = at[starts], th[starts], th2[starts]
    # Runs need no meeting place: they are dealt by where they stand.
    spread = mixed(th.view(np.uint64) ^ at.astype(np.uint64)).view(np.int64)
    runs = pd.DataFrame({"h": spread, "chk": np.zeros(len(at), np.int32), "n": -length, "th": th, "th2": th2, "at": at} | {k: x[known] for k, x in extra.items()})
    return pd.concat([one, runs])


class Counting:
    """What a task has read and not yet counted: parts of counted()'s arrays."""

    def __init__(self):
        self.held: list[tuple] = []
        self.size = 0

    def add(self, h: np.ndarray, chk: np.ndarray, weight: np.ndarray, at: np.ndarray, th: np.ndarray, th2: np.ndarray, **extra: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(h):
            self.held.append((h, chk, weight, at.astype(np.int32), th, th2, extra))
            self.size += len(h)
        if self.size >= ROWS:
            yield from self.told()

    def told(self) -> Iterator[pd.DataFrame]:
        if self.held:
            whole = [np.concatenate([x[i] for x in self.held]) for i in range(6)]
            extra = {k: np.concatenate([x[6][k] for x in self.held]) for k in self.held[0][6]}
            self.held, self.size = [], 0
            yield counted(*whole, extra)


def repeated_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of their hashes: those that are repeated."""
    held: pd.DataFrame | None = None

    def told(part: pd.DataFrame) -> pd.DataFrame:
        h, chk, n = part["h"].to_numpy(), part["chk"].to_numpy(), part["n"].to_numpy()
        group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (chk[1:] != chk[:-1])]) - 1
        total = np.bincount(group, weights=np.maximum(n, 0))[group]
        return part[(n < 0) | ((n == 1) & (total > 1))]

    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch])
        opened = (batch["h"] == batch["h"].iloc[-1]).to_numpy()
        at = int(opened.argmax())
        if at:
            yield told(batch.iloc[:at])
        held = batch.iloc[at:]
    if held is not None and len(held):
        yield told(held)


def by_hash(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h", "chk")


def repeated(rows: DataFrame) -> DataFrame:
    """rows: ROW. Returns th, th2, run (place << 32 | length) of all that are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in repeated_parts(batches):
            yield some[["th", "th2"]].assign(run=some["at"].to_numpy(np.int64) << 32 | np.abs(some["n"].to_numpy(np.int64)))

    return by_hash(rows).mapInPandas(run, "th long, th2 long, run long")


def extended(anchors: DataFrame, back: int) -> DataFrame:
    """anchors: ANCHOR. ROWs of the next level: the repeated anchors, grown to the right or, by `back` words, to the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting()
        for some in repeated_parts(batches):
            for way, column, move in ((1, "to_right", 0), (2, "to_left", back)):
                x = some[(some["ways"].to_numpy() & way) > 0]
                h = x[column].to_numpy().view(np.uint64)
                yield from counting.add(h, np.zeros(len(h), np.int32), np.ones(len(h), np.int32), x["at"].to_numpy() - move, x["th"].to_numpy(), x["th2"].to_numpy())
        yield from counting.told()

    return by_hash(anchors).mapInPandas(run, ROW)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (empty for null), th and th2 (hashes that stand for it)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumns(text_hashes(F.col("text")))


def text_hashes(text: Column) -> dict[str, Column]:
    return {"th": F.xxhash64(text), "th2": F.xxhash64(text, F.lit("2"))}


def anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """ANCHORs: the first level of every text, with what the second needs."""
    short, long = levels(window)[:2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting()
        for batch in batches:
            for text, th, th2 in zip(batch["text"], batch["th"], batch["th2"]):
                words = words_of(text)
                if len(words) < window:
                    continue
                hashes = word_hashes(words)
                at, grown = stand_ins(hashes, window, 1)
                right = grown == at
                # Places never fall from one full window to the next.
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                at, ways = at[first], np.logical_or.reduceat(right, first) + 2 * np.logical_or.reduceat(~right, first).astype(np.int32)
                h, g, n = mixed(grams(hashes, short, BASES[0])[at]), mixed(grams(hashes, long, BASES[0])), len(at)
                # Where a way is not gone the hash is of no meaning.
                to_right, to_left = g[np.minimum(at, len(g) - 1)].view(np.int64), g[np.maximum(at + short - long, 0)].view(np.int64)
                yield from counting.add(h, np.zeros(n, np.int32), np.ones(n, np.int32), at, np.full(n, th, np.int64), np.full(n, th2, np.int64), ways=ways, to_right=to_right, to_left=to_left)
        yield from counting.told()

    return texts.select("text", "th", "th2").mapInPandas(run, ANCHOR)


def window_rows(texts: DataFrame, window: int, level: int) -> DataFrame:
    """ROWs of one level. texts: text, th, th2; from level 1 on also alive (runs of repeated places of the level before)
    and weight."""
    lengths = levels(window)
    last = level == len(lengths) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting()
        for batch in batches:
            alive, weights = (batch["alive"], batch["weight"]) if level else ([None] * len(batch), [1] * len(batch))
            for text, th, th2, runs, weight in zip(batch["text"], batch["th"], batch["th2"], alive, weights):
                words = words_of(text)
                if len(words) < window:
                    continue
                hashes = word_hashes(words)
                *_, before, at = [None, *stand_ins(hashes, window, level)]
                if level:
                    at = at[covered(runs, len(words))[before]]
                at = np.unique(at)
                n = len(at)
                h = mixed(grams(hashes, lengths[level], BASES[0])[at])
                chk = (mixed(grams(mixed(hashes), window, BASES[1])[at]) >> np.uint64(32)).astype(np.uint32).view(np.int32) if last else np.zeros(n, np.int32)
                yield from counting.add(h, chk, np.full(n, weight, np.int32), at, np.full(n, th, np.int64), np.full(n, th2, np.int64))
        yield from counting.told()

    return texts.select("text", "th", "th2", *["alive", "weight"][: 2 * bool(level)]).mapInPandas(run, ROW)


def covered(runs, n: int, more: int = 0) -> np.ndarray:
    """Which of n places the runs cover, each made longer by `more`."""
    runs = np.asarray(runs, np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(runs >> 32, n), 1)
    np.add.at(edge, np.minimum((runs >> 32) + (runs & 0xFFFFFFFF) + more, n), -1)
    return np.cumsum(edge[:-1]) > 0


def by_text(found: DataFrame, name: str) -> DataFrame:
    """th, th2 and the runs of each text (as many as it has words, at most)."""
    return found.groupBy("th", "th2").agg(F.collect_set("run").alias(name))


def decisions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: keyed(). th, th2, starts (runs of windows to be removed), every (the text has a copy); written."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    copies = docs.groupBy("th", "th2").agg(F.count(F.lit(1)).alias("copies"), F.min(own).alias("stands")).filter("copies > 1")
    copies = written(copies.select("th", "th2", "stands"), "copies")
    lengths = levels(window)
    if len(lengths) > 2:
        found, level = repeated(extended(anchor_rows(docs, window), lengths[1] - lengths[0])), 2
    else:
        found, level = repeated(window_rows(docs, window, 0)), 1
    for level in range(level, len(lengths)):
        alive = by_text(found, "alive").join(copies, ["th", "th2"], "left").select("th", "th2", "alive", "stands", F.when(F.col("stands").isNotNull(), 2).otherwise(1).alias("weight"))
        alive = written(alive, f"alive-{level}")
        if alive.isEmpty():
            found = None
            break
        # Of copies the row that stands for them goes on; texts that occur once always do.
        some = docs.join(alive, ["th", "th2"]).filter(F.col("stands").isNull() | (own == F.col("stands")))
        found = repeated(window_rows(some, window, level))
    whole = copies.select("th", "th2", F.array().cast("array<long>").alias("starts"), F.lit(True).alias("every"))
    if found is None:
        return written(whole, "removals")
    starts = by_text(found, "starts").join(copies.select("th", "th2"), ["th", "th2"], "left_anti").withColumn("every", F.lit(False))
    return written(starts.unionByName(whole), "removals")


def cut(text: str | None, starts, every, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = words_of(text)
    n = len(words)
    if n < window or (not every and (starts is None or not len(starts))):
        return n, 0, b" ".join(words)
    if every:
        return n, n, b""
    gone = covered(starts, n, window - 1)
    return n, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = keyed(docs)
    told = decisions(rows, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, starts, every in zip(batch["doc_id"], batch["text"], batch["starts"], batch["every"]):
                n, gone, kept = cut(text, starts, every is True or every == 1, window)
                out.append((doc_id, n, gone, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(told, ["th", "th2"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "starts", "every")
    return ids_back(joined.mapInPandas(run, "doc_id string, n_words long, n_removed long, kept_sha256 string"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns; a text that loses words becomes its kept words joined by one space."""
    told = decisions(keyed(docs), window).withColumnsRenamed({"th": "_t1", "th2": "_t2", "starts": "_starts", "every": "_every"})
    hashes = text_hashes(F.coalesce("text", F.lit("")))
    own = docs.withColumns({"_h1": hashes["th"], "_h2": hashes["th2"]})
    joined = own.join(told, (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2")), "left")

    @F.pandas_udf("string")
    def left(texts: pd.Series, starts: pd.Series, every: pd.Series) -> pd.Series:
        cuts = [cut(t, s, e is True or e == 1, window) for t, s, e in zip(texts, starts, every)]
        return pd.Series([kept.decode() if gone else None for _, gone, kept in cuts], dtype=object)

    judged = joined.withColumn("_left", F.when(F.col("_starts").isNotNull(), left("text", "_starts", "_every")))
    changed = {"text": F.coalesce("_left", "text"), "n_chars": F.when(F.col("_left").isNotNull(), F.length("_left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return judged.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def op6_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))
