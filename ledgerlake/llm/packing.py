"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents become pieces: one of at most a sequence's length is one piece, a longer one is cut so that every piece but
the first fills a sequence by itself. Full pieces need no packing. The others are dealt by hash into groups of a
few thousand, and each group is packed in one task: best fit, longest first, then local search. A bin that is full but for
SLACK is closed. Each further round deals the bins that aren't into as many groups of that size as their pieces fill, and packs
those again. A group never grows: rounds end with one group, or when the open bins are as few as a bound shows possible (pieces
of more than half a sequence never share one), or when a round has saved less than GAIN of its bins. A round that saves none
is thrown away.

Local search works on the emptiest bin. It looks for the move of a document, the exchange of one for one, of two for
one or of one for two with another underfull bin that raises the sum of squared fills most, makes it, and goes on
until nothing raises the sum or the bin is empty and is gone. Every step raises the sum, so it ends. No exchange of these
kinds is left out: pairs are looked at by their sums, of which a bin has fewer than the length of a sequence.

Edge cases. Null and empty texts are documents of the end id alone. Rows that repeat an id are packed as documents of
their own. A text of any length is cut into as many pieces as it needs. Equal lengths go by id and start. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, ids_back, table, written
from .tokens import loaded

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 1024
#: Pieces packed together.
GROUP = 4096
#: A bin with no more room than this share of a sequence is closed: all closed bins together waste less than that share.
SLACK = 1 / 64
#: Share of its bins that a round must save for another to follow.
GAIN = 1 / 256
#: Exchanges that are weighed at a time.
CELLS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece; with keep_ids the ids too (binary, little-endian unsigned 32-bit)."""
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = loaded(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, i, a, b - a, zlib.crc32(part), part)[: len(names)])
            yield pd.DataFrame(rows, columns=names)

    schema = PIECES.replace("doc_id long", "doc_id string") + ", ids binary" * keep_ids
    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema))


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of indexes into `sizes`: longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        if room - size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def pair_sums(items: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(sum, item, item) for every sum of two of a bin's items, each sum once: of equal sizes the first two speak for all."""
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.r_[True, sizes[order][1:] != sizes[order][:-1]]).tolist() + [len(order)]
    firsts = [(int(sizes[order[i]]), int(items[order[i]]), int(items[order[i + 1]]) if j - i > 1 else -1) for i, j in zip(ends, ends[1:])]
    found: dict[int, tuple[int, int]] = {}
    for x, (size, item, again) in enumerate(firsts):
        if again >= 0:
            found.setdefault(2 * size, (item, again))
        for other_size, other, _ in firsts[x + 1 :]:
            found.setdefault(size + other_size, (item, other))
    return [(total, *pair) for total, pair in found.items()]


def best_exchange(amounts: np.ndarray, sums: np.ndarray, room: np.ndarray, ahead: np.ndarray) -> tuple[int, int, int]:
    """The gain, and which of the amounts given for which of the sums taken: an exchange must fit into the room of the
    sum's bin. ahead: how much fuller that bin is."""
    best = (0, -1, -1)
    step = max(1, CELLS // max(1, len(amounts)))
    for at in range(0, len(sums), step):
        more = amounts[:, None] - sums[None, at : at + step]
        gain = np.where((more > 0) & (more <= room[at : at + step]), 2 * more * ahead[at : at + step] + 2 * more * more, 0)
        k = int(gain.argmax()) if gain.size else 0
        if gain.size and gain.flat[k] > best[0]:
            best = (int(gain.flat[k]), k // gain.shape[1], at + k % gain.shape[1])
    return best


def local_search(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fill) if f == length]
    bins = [list(b) for b, f in zip(bins, fill) if f < length]
    fills = np.array([f for f in fill if f < length], dtype=np.int64)
    where = np.array([b for b, items in enumerate(bins) for _ in items], dtype=np.int64)
    item = np.array([i for items in bins for i in items], dtype=np.int64)
    size = np.array([sizes[i] for i in item], dtype=np.int64)
    gone, stuck = np.zeros(len(bins), dtype=bool), np.zeros(len(bins), dtype=bool)
    pairs: dict[int, list[tuple[int, int, int]]] = {}
    table = None
    while (~gone).sum() > 1 and (~gone & ~stuck).any():
        if table is None:  # something has moved: pairs of the bins that changed are made anew
            for b in np.flatnonzero(~gone).tolist():
                if b not in pairs:
                    own = np.flatnonzero(where == b)
                    pairs[b] = pair_sums(own, size[own])
            table = np.array([(total, x, y, b) for b in np.flatnonzero(~gone).tolist() for total, x, y in pairs[b]], dtype=np.int64).reshape(-1, 4)
        low = int(np.where(gone | stuck, length + 1, fills).argmin())
        room, ahead = length - fills, fills - fills[low]
        room[gone] = -1
        room[low] = -1
        mine = np.flatnonzero(where == low)
        singles, first = np.unique(size[mine], return_index=True)
        gives = [(int(s), (int(mine[i]),)) for s, i in zip(singles, first)] + [(t, (x, y)) for t, x, y in pairs[low]]
        amounts = np.array([a for a, _ in gives], dtype=np.int64)
        best, move = 0, None
        # Moves: a document, or two, to the fullest bin with room.
        order = np.argsort(room, kind="stable")
        at = np.searchsorted(room[order], amounts)
        for (amount, given), k in zip(gives, at.tolist()):
            if k < len(order):
                b = int(order[k])
                gain = 2 * amount * int(ahead[b]) + 2 * amount * amount
                if gain > best:
                    best, move = gain, (given, (), b)
        # One or two of mine for one of theirs, and one of mine for two of theirs.
        gain, g, t = best_exchange(amounts, size, room[where], ahead[where])
        if gain > best:
            best, move = gain, (gives[g][1], (t,), int(where[t]))
        gain, g, t = best_exchange(singles, table[:, 0], room[table[:, 3]], ahead[table[:, 3]])
        if gain > best:
            best, move = gain, (gives[g][1], (int(table[t, 1]), int(table[t, 2])), int(table[t, 3]))
        if move is None:
            stuck[low] = True
            continue
        given, taken, to = move
        change = int(size[list(given)].sum() - (size[list(taken)].sum() if taken else 0))
        where[list(given)] = to
        if taken:
            where[list(taken)] = low
        fills[to] += change
        fills[low] -= change
        gone[low] |= fills[low] == 0
        stuck[to] = False
        table = None
        for b in (low, to):
            pairs.pop(b, None)
    kept: dict[int, list[int]] = {}
    for b, i in zip(where, item):
        kept.setdefault(int(b), []).append(int(i))
    return full + list(kept.values())


def pack_group(rows: pd.DataFrame, length: int, first_id: int) -> pd.DataFrame:
    """Sequence and offset for each piece of one group."""
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = rows["length"].tolist()
    bins = local_search(best_fit(sizes, length), sizes, length)
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            sequence[i], offset[i] = first_id + b, at
            at += sizes[i]
    return rows.assign(sequence_id=sequence, offset=offset)


def least_bins(counts: dict[int, int], length: int) -> int:
    """No packing has fewer bins. counts: how many pieces of each size. For each k the pieces over length - k are alone or
    with pieces under k, those of at most half a sequence share what those between leave, and those under k are left out."""
    best = 0
    for k in range(length // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > length - k)
        large = sum(n for s, n in counts.items() if length - k >= s > length // 2)
        left = large * length - sum(n * s for s, n in counts.items() if length - k >= s > length // 2)
        small = sum(n * s for s, n in counts.items() if k <= s <= length // 2)
        best = max(best, alone + large + max(0, -(-(small - left) // length)))
    return best


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces: PIECES, from a written table. Adds sequence_id and offset; other columns stay out."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    full = pieces.filter(F.col("length") >= length).select(*names, (F.monotonically_increasing_id() + (1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.filter(F.col("length") < length).select(*names).withColumn("doc_id", F.col("doc_id").cast("string"))
    groups = max(1, -(-part.count() // group))
    # Pieces are dealt by where they stand in the written table too, so that rows repeated any number of times spread out.
    rows = part.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def run(round_id: int):
        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            out = pack_group(rows, length, (round_id << 56) + (int(rows["group"].iloc[0]) << 24))
            fills = out.groupby("sequence_id")["length"].transform("sum")
            return out.assign(room=length - fills)[[*names, "sequence_id", "offset", "group", "room"]]

        return packed

    schema = PLACED.replace("doc_id long", "doc_id string") + ", group long, room long"
    most_tasks = max(200, 32 * pieces.sparkSession.sparkContext.defaultParallelism)
    ready = lambda rows: ids_back(rows.drop("group", "room"))
    loose = F.col("room") > int(length * SLACK)
    placed, before, bins_before, round_id = full, None, 0, 0
    while True:
        # The work follows the number of groups, not their bytes.
        done = rows.repartition(min(groups, most_tasks), "group").groupBy("group").applyInPandas(run(round_id), schema)
        if groups == 1 and before is None:
            return placed.unionByName(ready(done))
        done = written(done, "packed")
        first = F.col("offset") == 0
        # One row a size: fewer than a sequence has tokens.
        found = done.groupBy("length").agg(F.count_if(first).alias("bins"), F.count_if(first & loose).alias("open"), F.count_if(loose).alias("n")).collect()
        bins, still, count = (sum(r[c] for r in found) for c in ("bins", "open", "n"))
        if before is not None and bins >= bins_before:
            return placed.unionByName(ready(before))
        saved = before is None or bins_before - bins >= GAIN * bins_before
        if groups == 1 or not saved or still <= least_bins({r["length"]: r["n"] for r in found if r["n"]}, length):
            return placed.unionByName(ready(done))
        placed = placed.unionByName(ready(done.filter(~loose)))
        before, bins_before, round_id = done.filter(loose), still, round_id + 1
        groups = -(-count // group)
        # Whole bins are dealt, other ones together each time.
        rows = before.select(*names, F.pmod(F.xxhash64("sequence_id", F.lit(round_id)), F.lit(groups)).alias("group"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return pack(written(pieces_of(docs, public_tokenizers.path(TOKENIZER), length), "pieces"), length)
