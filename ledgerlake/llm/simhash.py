"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 values (seed 42) of the text's word
shingles. Fingerprints that differ in at most `radius` bits are linked, and links are closed to components.

Candidates. The bits are cut into radius + 2 blocks. At most `radius` blocks can differ, so two fingerprints within
the radius agree on some pair of blocks, and are compared wherever they share one: each distinct fingerprint is
shuffled once per pair of blocks under a key of some 26 bits. Keys shared by more than TILE fingerprints are cut into
tiles, and every pair of tiles is a task's work of its own. Nothing is capped; every pair within the radius meets.

Comparison. The fingerprints of a sorted run are stored vertically, one integer per bit position whose i-th binary
digit belongs to the i-th fingerprint. All pairs at one distance k in the run are compared at a time: the plane and
itself shifted by k are XORed and added to carry-save counters (ones, twos, and a flag for more than the radius).
A run is abandoned as soon as every pair of it that counts is beyond the radius. Of the links within a key only a
spanning forest goes on, which keeps the components and not all pairs.

Edge cases. Null, empty and wordless texts have fingerprint zero and link like any other. A text with fewer words than
a shingle has one shingle, the whole sequence. Equal texts share a fingerprint, which takes part once. Null ids are
ignored by the smallest id of a component, which is null if it has no other. Rows that repeat an id give a row each.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_back, table, written
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints compared in one run; keys with more are cut into tiles of half as many.
RUN = 4096
TILE = RUN // 2


def normal_words(text: str | None) -> list[bytes]:
    """bytes.lower() lowers A-Z alone, and bytes.split() parts at the six separators."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    return np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(normal_words(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch[["doc_id", "text_hash"]].assign(fp=fps)

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return ids_back(rows.mapInPandas(run, "doc_id string, text_hash long, fp long"))


def block_masks(radius: int = RADIUS) -> list[int]:
    """For each pair of the radius + 2 blocks, the bits of both."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(k, indexes i): the pairs (i, i + k) of one run, sorted by group, that are of one group and within the radius."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]
    width = (radius + 1).bit_length()
    for k in range(1, n):
        same = group[k:] == group[:-k]
        if not same.any():
            return
        alive = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        counters = [0] * width
        for plane in planes:
            carry = (plane ^ (plane >> k)) & alive
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
                if not carry:
                    break
            # A count of radius + 1 ends a pair; no counter goes beyond it.
            over = alive
            for c in range(width):
                over &= counters[c] if (radius + 1) >> c & 1 else ~counters[c]
            alive &= ~over
            if not alive:
                break
        if alive:
            raw = np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8)
            yield k, np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs within the radius that make a spanning forest of each group's links. Memory follows the run, not its pairs."""
    label, told = np.arange(len(fps)), []
    apart = len(fps) - len(np.unique(group))
    for k, at in close_pairs(fps, group, radius):
        for i in at[label[at] != label[at + k]].tolist():
            if label[i] != label[i + k]:
                label[label == label[i + k]] = label[i]
                told.append((i, i + k))
                apart -= 1
        if not apart:
            break
    return told


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: fp, each once. Returns u, v: links whose components are those of all pairs within the radius."""
    masks = block_masks(radius)
    return links_within(distinct.select(F.col("fp").alias("node"), "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_long(m))) for m in masks])).alias("mask", "key")), radius)


def links_within(keyed: DataFrame, radius: int) -> DataFrame:
    """keyed: node, fp, mask and key (both one: those that are compared).

    Returns u, v: nodes of a spanning forest of the pairs within the radius under each key.
    """
    columns = ["node", "fp", "mask", "key"]
    crowded = written(keyed.groupBy("mask", "key").count().filter(F.col("count") > RUN).select("mask", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "crowded")
    one = F.lit(0).cast("int")
    if crowded.isEmpty():
        tiled = keyed.select(*columns, one.alias("i"), one.alias("j"))
    else:
        met = keyed.join(crowded, ["mask", "key"], "left")
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 2), lambda x: x + F.when(x >= tile, 1).otherwise(0))
        pairs = F.when(F.col("tiles").isNull(), F.array(one)).otherwise(others)
        own = F.when(F.col("tiles").isNull(), one).otherwise(tile)
        spread = met.select(*columns, own.alias("a"), F.explode(pairs).alias("b"))
        tiled = spread.select(*columns, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def compared(rows: pd.DataFrame) -> pd.DataFrame:
            change = np.zeros(len(rows), bool)
            for c in ("mask", "key", "i", "j"):
                x = rows[c].to_numpy()
                change[1:] |= x[1:] != x[:-1]
            group, fps = np.cumsum(change), rows["fp"].to_numpy()
            # Fingerprints alone under their key have nobody to be compared with.
            crowd = np.bincount(group)[group] > 1
            group, fps, nodes = group[crowd], fps[crowd], rows["node"].to_numpy()[crowd]
            found: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
            at = 0
            while at < len(group):
                end = len(group)
                if end - at > RUN:
                    inside = starts[(starts > at) & (starts <= at + RUN)]
                    after = starts[starts > at]
                    end = int(inside[-1]) if len(inside) else int(after[0]) if len(after) else end
                some = forest(fps[at:end], group[at:end], radius)
                found += [(int(nodes[at + a]), int(nodes[at + b])) for a, b in some]
                at = end
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        for batch in batches:
            held.append(batch)
            rows = pd.concat(held) if len(held) > 1 else batch
            last = rows.iloc[-1]
            open_from = int(((rows["mask"] == last["mask"]) & (rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])).to_numpy().argmax())
            if open_from:
                yield compared(rows.iloc[:open_from])
            held = [rows.iloc[open_from:]]
        if held:
            yield compared(pd.concat(held))

    sorted_rows = tiled.repartition("mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j", "fp", "node")
    return sorted_rows.mapInPandas(run, "u long, v long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, root (of the component's fingerprints), component_id for each document."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(links(fps.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    known = first.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # One row a fingerprint, whatever the number of its texts: the documents' side of this join may be split where it is hot.
    known = known.join(smallest, "root").select("fp", "root", "component_id")
    return fps.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: the one of smallest id (null last), of equal ids the smallest text hash."""
    found = written(groups(docs, shingle, radius), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    keep = found.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.id").alias("keep_id"), F.col("k.hash").alias("keep_hash"))
    return only(docs, keep)


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """keep: keep_id, keep_hash. The rows of docs with such an id and hash of the text, one each.

    Join and window share their keys, so texts are shuffled once.
    """
    keys = ["_sid", "_hash"]
    sid = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    rows = docs.withColumns({"_sid": sid("doc_id"), "_hash": F.xxhash64("text")})
    kept = rows.join(keep.select(sid("keep_id").alias("_sid"), F.col("keep_hash").alias("_hash")), keys, "left_semi")
    once = Window.partitionBy(*keys).orderBy("_hash")
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
