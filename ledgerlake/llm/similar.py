"""Near-duplicates by a similarity: SimHash comparison proposes, the exact Jaccard similarity of word shingles decides.

Texts are lower-cased (A-Z) and cut into words and five-word shingles, as in simhash. Equal word sequences are one node,
whatever their number. Two nodes are linked if the Jaccard similarity of their sets of shingles is SIMILARITY or more;
links are closed to groups, of which one document stays.

Candidates. At this similarity fingerprints lie up to RADIUS bits apart, too far for keys made of fingerprint blocks. So
nodes meet under BANDS keys of ROWS minima each (of the shingles' hashes under one multiplier each): at a similarity of
0.8 two nodes share a key with a chance of 0.9996, at 0.5 of 0.47, at 0.2 of under 0.01. Under each key the bit-sliced
comparison of simhash abandons what is beyond the radius, and proposes a spanning forest of the rest. Fingerprints and
keys are both over the set of shingles, which decides. Proposed pairs are checked on the whole sets.

Rest. What the radius, the keys or a forest can miss is found exactly. Two sets of the similarity share one of each one's
first shingles (prefix_size() of them) in any order that is the same for all; here rare ones come first. Nodes that
share such a shingle, are not yet of one group and are near enough in size are compared: those of a shingle of few nodes
as pairs, each once; of more in one task a shingle (crowded ones in pairs of tiles), which only links that hold leave.
Shingles that stand in the same nodes are compared once. Parity sketches of about a bit a shingle go first: the bits in
which two of them differ are at most the shingles in which the sets differ, so none that hold are lost, and whole sets
move only for nodes that sketches can't tell apart.

Edge cases. Null, empty and wordless texts are one node. A text with fewer words than a shingle has one shingle, the
whole sequence. The row of the smallest id stays (null last), of equal ids that of the smallest text hash; of rows that
are the same in both, one. An empty table gives no rows. Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .simhash import fingerprint_of, links_within, normal_words, only, shingle_hashes
from .substring import mixed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Two fingerprints at the similarity differ in 10 bits of 64 on average, with a deviation of 3.
RADIUS = 20
#: Shingles counted as common: of one text in SAMPLED, those most often seen. They set the order alone, not the result.
COMMON, SAMPLED = 100_000, 8
#: Bytes of sets that a tile of a crowded shingle holds, about.
TILE_BYTES = 4 << 20
#: A shingle of as many nodes gives its pairs as rows (each pair once, whatever it shares); those of more are compared in a task.
FEW = 32
#: Odd multipliers, one a minimum, and those that make one key of a band's minima.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
FOLD = mixed(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, at : at + 2048] * FACTORS[:, None]).min(axis=1))
    return mixed((least.reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64)).view(np.int64)


def text_key(words: list[bytes]) -> tuple[int, int]:
    from xxhash import xxh128_intdigest

    high, low = divmod(xxh128_intdigest(b" ".join(words)), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def nodes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row a distinct word sequence: node, high and low (its hash), fp, keys, first (the row that stands for it); written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = normal_words(text)
                h = np.unique(shingle_hashes(words, shingle))
                rows.append((*text_key(words), fingerprint_of(h), band_keys(h)))
            out = pd.DataFrame(rows, columns=["high", "low", "fp", "keys"])
            out["fp"] = np.array([r[2] for r in rows], np.uint64).view(np.int64)
            out.insert(0, "text_hash", batch["text_hash"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = rows.mapInPandas(run, "doc_id string, text_hash long, high long, low long, fp long, keys array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("text_hash").alias("hash"))
    distinct = signed.groupBy("high", "low").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    # Numbers are written with the rows, once: what reads the table agrees on them.
    return written(distinct.select(F.monotonically_increasing_id().alias("node"), "high", "low", "fp", "keys", "first"), "nodes")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """wanted: node, first. Returns node, shingles (sorted hashes, binary), each node once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(normal_words(t), shingle)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    met = wanted.join(texts, F.col("first.id").eqNullSafe(F.col("_id")) & (F.col("first.hash") == F.col("_hash")))
    return met.select("node", "text").dropDuplicates(["node"]).mapInPandas(run, "node long, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets (sorted, without repeats)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs: u, v. Adds holds: the similarity is `least` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            holds = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least for a, b in zip(batch["a"], batch["b"])]
            yield batch[["u", "v"]].assign(holds=holds)

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInPandas(run, "u long, v long, holds boolean")


def joined(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """linked: node, root, smallest of their groups; the same after the links of pairs (u, v), of which roots alone take part."""
    root = lambda end: linked.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    merged = components(ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    moved = linked.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(merged.join(linked, "node", "left_anti").select("node", "root"))


def prefix_size(n: int, least: float) -> int:
    """So many of the first of a set of n: sets of the similarity `least` share `least` * n or more of them."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON shingles most often met in a sample of texts, sorted, and how often: of a fixed size at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                sets = [np.unique(shingle_hashes(normal_words(t), shingle)) for t in batch["text"].iloc[at : at + 200]]
                yield pd.DataFrame({"h": np.concatenate(sets).view(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    met = some.mapInPandas(run, "h long").groupBy("h").count().filter("count > 1").orderBy(F.col("count").desc(), "h").limit(COMMON).toPandas()
    h = met["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], met["count"].to_numpy(np.int64)[order]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parities of how many of a set fall to each bit, a power of two of bits, one a member or more."""
    bits = max(64, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches (last axis) of the same sets at half the size."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def most_apart(sizes: np.ndarray | int, least: float) -> np.ndarray | float:
    """Members in which two sets of `sizes` members together differ at most at the similarity `least`."""
    return sizes * (1 - least) / (1 + least) + 1e-6


def sketches_allow(a: bytes, b: bytes, sizes: int, least: float) -> bool:
    """False only if the similarity of two sets is under `least`. Sizes that are near enough give sketches at most twofold."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(x) < len(y):
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum()) <= most_apart(sizes, least)


def may_hold(roots: np.ndarray, sizes: np.ndarray, sketches: list[bytes], least: float) -> np.ndarray:
    """A mask: nodes that may have the similarity `least` to a node of another root, as far as sketches tell."""
    label = pd.factorize(roots)[0]
    lengths = np.array([len(s) for s in sketches])
    kinds = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
    whole = {n: np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), n) for n, at in kinds.items()}
    halved = {n // 2: (kinds[n], folded(rows)) for n, rows in whole.items() if n > 8}
    found = np.zeros(len(sketches), bool)

    def meet(i: int, own: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        other = label[at] != label[i]
        if other.any():
            at, rows = at[other], rows[other]
            near = np.bitwise_count(rows ^ own).sum(axis=1, dtype=np.int64) <= most_apart(sizes[at] + sizes[i], least)
            found[at[near]] = True
            found[i] |= bool(near.any())

    # Of the pairs of two groups one end at least is outside the largest.
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        own = np.frombuffer(sketches[i], np.uint8)
        meet(i, own, kinds[len(own)], whole[len(own)])
        if len(own) in halved:
            meet(i, own, *halved[len(own)])
        if len(own) // 2 in kinds:
            meet(i, folded(own), kinds[len(own) // 2], whole[len(own) // 2])
    return found


def prefixes(docs: DataFrame, found: DataFrame, linked: DataFrame, least: float, shingle: int) -> DataFrame:
    """node, root (of its group so far), size (of its set), sketch, tokens: the first shingles of every node; written."""
    common, often = common_shingles(docs, shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = normal_words(text)
                h = np.unique(shingle_hashes(words, shingle))
                times = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    times = np.where(common[at] == h, often[at], 0)
                first = h[np.lexsort((h, times))][: prefix_size(len(h), least)]
                rows.append((*text_key(words), len(h), sketch_of(h), first.view(np.int64)))
            yield pd.DataFrame(rows, columns=["high", "low", "size", "sketch", "tokens"])

    signed = docs.select("text").mapInPandas(run, "high long, low long, size long, sketch binary, tokens array<long>").dropDuplicates(["high", "low"])
    rooted = found.select("node", "high", "low").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "high", "low")
    return written(signed.join(rooted, ["high", "low"]).select("node", "root", "size", "sketch", "tokens"), "prefixes")


def by_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each token, i, j together; the rows come sorted by these. One place is held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        place = batch[["token", "i", "j"]].to_numpy()
        edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
            if at == end:
                continue
            if held and tuple(held[-1][["token", "i", "j"]].iloc[-1]) != tuple(place[at]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[at:end])
    if held:
        yield pd.concat(held, ignore_index=True)


def links_that_hold(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join what pairs of the similarity `least` join among the nodes, of which those of one root are joined."""
    label = pd.factorize(roots)[0]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    shingles = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, mark = np.repeat(np.arange(len(sets)), sizes), np.zeros(int(shingles.max(initial=0)) + 1, bool)
    told = []
    # Of the pairs of two groups one end at least is outside the largest.
    for i in np.flatnonzero(label != np.bincount(label).argmax()):
        others = label != label[i]
        if not others.any():
            break
        own = shingles[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.bincount(owner[mark[shingles]], minlength=len(sets))
        mark[own] = False
        for j in np.flatnonzero(others & (both / np.maximum(sizes[i] + sizes - both, 1) >= least)):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                told.append((int(nodes[i]), int(nodes[j])))
    return told


def told_apart(spread: DataFrame, least: float) -> DataFrame:
    """spread: token, i, j, node, root, size, sketch. The rows but for nodes that sketches tell from all others of their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_place(batches):
            if rows["root"].nunique() > 1:
                yield rows.loc[may_hold(rows["root"].to_numpy(), rows["size"].to_numpy(), list(rows["sketch"]), least), ["token", "i", "j", "node", "root"]]

    placed = spread.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return placed.mapInPandas(run, "token long, i int, j int, node long, root long")


def allowed(pairs: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """pairs: u, v. The pairs that sketches do not tell apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [sketches_allow(a, b, n, least) for a, b, n in zip(batch["a"], batch["b"], batch["n"])]
            yield batch.loc[np.array(keep, bool), ["u", "v"]]

    left = info.select(F.col("node").alias("u"), F.col("sketch").alias("a"), F.col("size").alias("n_a"))
    right = info.select(F.col("node").alias("v"), F.col("sketch").alias("b"), F.col("size").alias("n_b"))
    met = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return met.mapInPandas(run, "u long, v long")


def missed(docs: DataFrame, found: DataFrame, linked: DataFrame, least: float, shingle: int) -> DataFrame:
    """u, v: links that hold and join groups of linked (node, root), enough to join all that pairs of `least` join."""
    first = prefixes(docs, found, linked, least, shingle)
    info = first.select("node", "root", "size", "sketch")
    posts = first.select("node", "root", F.explode("tokens").alias("token"))
    # Most shingles stand in one group: those go by the smallest of rows, before anything else of a node moves.
    shared = posts.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("token")
    shared_posts = written(posts.select("token", "node").join(shared, "token"), "shared-postings")
    sized = shared_posts.join(info.drop("sketch"), "node")
    ways = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"x{k}") for k in (1, 2)]
    tokens = sized.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), *ways)
    met = tokens.groupBy("n", "x1", "x2").agg(F.min("token").alias("token"), F.first("sizes").alias("sizes"))
    tiles = F.ceil(F.col("sizes") * 8 / TILE_BYTES).cast("int")
    open_posts = written(sized.join(met.select("token", "n", F.when(tiles > 2, tiles).otherwise(1).alias("tiles")), "token"), "open-postings")
    few, many = open_posts.filter(F.col("n") <= FEW), open_posts.filter(F.col("n") > FEW)
    end = lambda x: few.select("token", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("size").alias(f"size_{x}"))
    near = F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * least - 1e-9
    pairs = end("u").join(end("v"), "token").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & near)
    pairs = written(allowed(pairs.select("u", "v").distinct(), info, least), "few-pairs")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: (x != tile) | (F.col("tiles") == 1))
    spread = many.join(info.select("node", "sketch"), "node").select("token", "node", "root", "size", "sketch", tile.alias("a"), F.explode(others).alias("b"))
    spread = spread.select("token", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "node", "root", "size", "sketch")
    places = written(told_apart(spread, least), "open-places")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).union(places.select("node")).distinct()
    sets = written(shingle_sets(docs, found.join(ends, "node").select("node", "first"), shingle), "open-sets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_place(batches):
            told = links_that_hold(rows["node"].to_numpy(), rows["root"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["shingles"]], least)
            yield pd.DataFrame(told, columns=["u", "v"], dtype="int64")

    rows = places.join(sets, "node").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    held = decided(pairs, sets, least).filter("holds").select("u", "v")
    return held.unionByName(rows.mapInPandas(run, "u long, v long")).distinct()


def links(docs: DataFrame, found: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """found: nodes(). Returns node, root for every node that is linked to another."""
    keyed = found.select("node", "fp", F.posexplode("keys").alias("mask", "key"))
    pairs = written(links_within(keyed, RADIUS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "proposed")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = written(shingle_sets(docs, found.join(ends, "node").select("node", "first"), shingle), "shingle-sets")
    linked = components(decided(pairs, sets, least).filter("holds").select("u", "v"))
    return joined(linked, missed(docs, found, linked, least, shingle))


def representatives(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """keep_id, keep_hash (of the text): one row for each group."""
    found = nodes(docs, shingle)
    linked = links(docs, found, least, shingle)
    rows = found.select("node", "first").join(linked, "node", "left")
    return rows.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("f")).select(F.col("f.id").alias("keep_id"), F.col("f.hash").alias("keep_hash"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group stays, with all its columns."""
    return only(docs, representatives(docs, least, shingle))
