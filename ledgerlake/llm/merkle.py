"""Merkle manifest of a dataset, level by level through equijoins of nodes with their computed siblings.

Every row is a leaf: the hash of its fields, each told by its length. The leaves of a group ascend by id; while a group has
more than one node, each run of `arity` consecutive nodes becomes their hash. What remains is the group's subroot, and the
subroots, in the groups' order, give the root in the same way.

A level is one table of nodes (g, i, n, h): group, place in it, the group's number of nodes, hash. It is joined to itself once
a sibling: the sibling's place is i XOR 1 for two to a run, else the run's start plus the slot some offset further round.
That adds to each node what stands left and right of it in its run; the nodes of slot zero then emit the parents. Keys are
(group, place), so a group of any size spreads evenly, and levels shrink `arity` times. Bottom-up every level is written:
it is read for the join, for the parents and for the proofs. Top-down the proofs are one join a level, each of a node's own
siblings with the proof of its parent, all in one plan; it starts from a written table of the groups' last nodes and what
comes after them, so it holds one join a level and no more: the driver plans all of it anew as each is done.

Leaves find their places without a sort of one group in one task: ranges of (group, id, leaf), sorted within (ordering.py);
a window over one row a (range, group) gives where each group goes on.

Edge cases. Null groups are one group, which comes first, before the empty name; null ids come first within a group. Rows
that repeat an id go by their leaf; equal rows are leaves of their own, and which of them comes first makes no difference.
A null field is `-`; an empty one `0:`. A lone leaf is its group's subroot, a lone subroot is the root, and their proofs are
the hash of nothing. Null ids and null texts are never tampered with. An empty table has no rows and no root. Columns that
aren't hashed are ignored, but for those that `keep` names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .ordering import laid_out, numbered, part_of

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l: binary, r: binary>>"


def digest(*parts: Column) -> Column:
    """The sha256 of inputs as text, in 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def shown(digests: Column) -> Column:
    """Digests, any number of them one after the other, as lowercase hex text."""
    return F.lower(F.hex(digests))


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """A row's leaf; `changed` has other values for some of its fields."""
    return digest(*[field((changed or {}).get(c, docs[c])) for c in fields])


def sibling(i: Column, offset: int, arity: int) -> Column:
    """Place of the node `offset` slots further round in the same run."""
    if arity == 2:
        return i.bitwiseXOR(F.lit(1))
    slot = F.pmod(i, F.lit(arity))
    return i - slot + F.pmod(slot + offset, F.lit(arity))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (g, i, n, h, from a written table) with l and r: the hashes left and right of each in its run."""
    none, slot = F.lit(b""), F.pmod(F.col("i"), F.lit(arity))
    out, left, right = nodes, [], []
    for o in range(1, arity):
        other = nodes.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("h").alias(f"_h{o}"))
        out = out.join(other, (F.col("g") == F.col("_g")) & (sibling(F.col("i"), o, arity) == F.col("_i")), "left").drop("_g", "_i")
        found = F.coalesce(F.col(f"_h{o}"), none)
        right.append(F.when(slot + o < arity, found).otherwise(none))
        left.append(F.when(slot + o >= arity, found).otherwise(none))
    return out.select(*nodes.columns, F.concat(*left).alias("l"), F.concat(*right).alias("r"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The nodes of the next level, made of those of slot zero."""
    first = level.filter(F.pmod(F.col("i"), F.lit(arity)) == 0)
    up = F.floor(F.col("i") / arity).cast("long")
    return first.select("g", up.alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"), digest(shown(F.col("h")), shown(F.col("r"))).alias("h"))


@dataclass
class Tree:
    """levels: written tables of the nodes that have a parent (g, i, n, h, l, r), the leaves first; the last nodes of the
    groups are in tops: g, h and the level they are on."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """g, i and path of the leaves: what stands left and right at each level, from the leaf up. above: g, path, what
        comes after a group's own levels, and any columns that go with it."""
        none = F.array().cast(PATH)
        tops = self.tops.select("g", F.lit(0).cast("long").alias("i"), "level")
        # Written: each level that a group ends on reads it, and would plan all of `above` again.
        tops = written(tops.join(above, "g"), "merkle-starts") if above is not None else tops.withColumn("path", none)
        ends = {r["level"] for r in self.tops.select("level").distinct().collect()}
        more = [c for c in tops.columns if c not in ("g", "i", "level")]
        at = lambda level: tops.filter(F.col("level") == level).select("g", "i", *more)
        here = at(len(self.levels))
        for level in reversed(range(len(self.levels))):
            up = here.select(F.col("g").alias("_g"), F.col("i").alias("_i"), *more)
            own = self.levels[level].select("g", "i", F.array(F.struct("l", "r")).alias("_own"))
            met = own.join(up, (F.col("g") == F.col("_g")) & (F.floor(F.col("i") / self.arity).cast("long") == F.col("_i")))
            path = F.concat("_own", "path").alias("path")
            here = met.select("g", "i", *[path if c == "path" else c for c in more])
            here = here.unionByName(at(level)) if level in ends else here
        return here


def tree(nodes: DataFrame, arity: int = ARITY) -> Tree:
    """nodes: g, i, n, h from a written table."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    tops = nodes.filter("n = 1").select("g", "h", F.lit(0).alias("level"))
    while most > 1:
        level = written(with_siblings(nodes.filter("n > 1").select("g", "i", "n", "h"), arity), "merkle-level")
        levels.append(level)
        nodes = parents(level, arity)
        most = -(-most // arity)
        done = nodes.filter("n = 1").select("g", "h", F.lit(len(levels)).alias("level"))
        tops = tops.unionByName(done)
        if most > 1:
            nodes = written(nodes.filter("n > 1"), "merkle-nodes")
    return Tree(levels, written(tops, "merkle-tops"), arity)


@dataclass
class Manifest:
    """leaves: the kept columns with g, i, n, h, a written table; groups: g, subroot and path to the root; root: lowercase
    hex, or None of an empty table."""

    leaves: DataFrame
    own: Tree
    groups: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with path and subroot."""
        paths = self.own.paths(self.groups)
        return self.leaves.join(paths, ["g", "i"])


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", arity: int = ARITY, keep: tuple[str, ...] = ()) -> Manifest:
    """rows: h (32 bytes), the column that groups, the one that orders leaves within a group, and those to keep."""
    # A name of its own for null, before all others; order by UTF-8 bytes stays.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = list(dict.fromkeys(c for c in keep if c not in ("h", "_name", "_order")))
    narrow = written(rows.select(*kept, "h", name.alias("_name"), F.col(order).alias("_order")), "merkle-leaves")
    laid = laid_out(narrow, ["_name", "_order", "h"], "merkle-order").withColumn("_part", part_of("_at"))
    # One row a range and group: where the group's rows in that range start, and how many come in ranges before.
    spans = laid.groupBy("_part", "_name").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_name")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_part", "_name", (before - F.col("_first")).alias("_shift"), F.min("_first").over(whole).alias("g"), F.sum("_n").over(whole).alias("n"))
    leaves = written(laid.join(spans, ["_part", "_name"]).select(*kept, "g", (F.col("_at") + F.col("_shift")).alias("i"), "n", "h"), "merkle-numbered")
    own = tree(leaves, arity)
    # g rises in the order of the groups' names.
    ranked = numbered(own.tops.select(F.col("g").alias("_group"), "h"), ["_group"], "merkle-groups")
    count = own.tops.count()
    tops = written(ranked.select(F.lit(0).cast("long").alias("g"), F.col("place").alias("i"), F.lit(count).cast("long").alias("n"), "h", "_group"), "merkle-subroots")
    upper = tree(tops, arity)
    top = upper.tops.first()
    groups = tops.join(upper.paths(), ["g", "i"]).select(F.col("_group").alias("g"), F.col("h").alias("subroot"), "path")
    return Manifest(leaves, own, groups, top["h"].hex() if top else None)


def proof(path: Column) -> Column:
    """All siblings of a path, one after the other."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(shown(s["l"]), shown(s["r"]))))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf gives with the siblings of its path, as 32 bytes."""
    step: Callable = lambda h, s: digest(shown(s["l"]), shown(h), shown(s["r"]))
    return F.aggregate(path, start, step)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(docs).alias("h"), F.when(even & F.contains("text", F.lit("\n")), leaf(docs, changed={"text": tampered})).alias("tampered"))
    made = manifest(rows, keep=("doc_id", "tampered"))
    root = F.lit(made.root)
    out = made.proofs().select("doc_id", "h", "subroot", "path", folded(F.col("path"), F.coalesce("tampered", "h")).alias("again"))
    return out.select(
        "doc_id", shown(F.col("h")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"), shown(F.col("again")).alias("folded_root"), (shown(F.col("again")) == root).alias("verified"),
    )
