"""Resampling, the Merkle manifest and language against brute force, SQL and held-out rows; odd, crowded and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DOCUMENTS, prose
from pyspark.sql import functions as F

from ledgerlake.llm import language, merkle, ordering, resampling
from ledgerlake.llm.common import table, written
from ledgerlake.llm.queries import oracle_sql, queries

RUN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    q = con.execute(oracle_sql()[name])
    columns = [c[0] for c in q.description]
    got = queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(q.fetchall(), key=repr)


def stored_folder(docs, benchmark, path):
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


# places


def test_places_of_crowded_and_equal_rows(spark):
    r = random.Random(3)
    rows = [(None if r.random() < 0.1 else r.choice([1, 1, 1, 2, 7, -5]), r.randint(0, 3)) for _ in range(3000)]
    stored = written(spark.createDataFrame(rows, "a int, b int").repartition(7), "test-places")
    # As many ranges as there are partitions: small ones are not put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = ordering.laid_out(stored, ["a", "b"], "test-laid")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [x["n"] for x in laid.groupBy(ordering.part_of("_at").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 1500  # half of all rows have a = 1: they are not in one task
    out = ordering.numbered(stored, ["a", "b"], "test-numbered").collect()
    key = lambda x: (x["a"] is not None, x["a"] or 0, x["b"])
    assert [x["place"] for x in sorted(out, key=lambda x: x["place"])] == list(range(len(rows)))
    ordered = sorted(out, key=lambda x: x["place"])
    assert [key(x) for x in ordered] == sorted(map(key, out))


# 11


def grams(text):
    words = RUN.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resampling(rows, target, percent=5, least=20):
    found = [(d, *grams(t)) for d, t in rows]
    s, t = Counter(zlib.crc32(g) % 10000 for _, _, x in found for g in x), Counter(zlib.crc32(g) % 10000 for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for d, words, x in found:
        weight = sum(gain(zlib.crc32(g) % 10000) for g in x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], x[1]))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def resampling_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resampling_on_odd_rows(spark, odd_docs, percent):
    target = spark.createDataFrame([(1, prose(2, 80), "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    got = resampling.resampled(odd_docs, target, percent)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert resampling_rows(got) == brute_resampling(docs, [r["text"] for r in target.collect()], percent)


def test_resampling_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(no_docs, none).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert resampling_rows(resampling.resampled(odd_docs, none, 30)) == brute_resampling(docs, [], 30)


def test_runs_of_words_of_any_length(monkeypatch):
    """crc32 of runs put together from words, words beyond the tables and texts cut into stretches among them."""
    monkeypatch.setattr(resampling, "STRETCH", 5)
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "Bc", "é" * 30, "x" * 200, "straße", "0", "日本"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 11, 40)]
    got = [Counter() for _ in texts]
    hasher = resampling.Hasher()
    for group in resampling.stretches(texts):
        for doc, bucket in hasher.runs(group):
            for d, b in zip(doc, bucket):
                got[d][int(b)] += 1
    assert got == [Counter(zlib.crc32(g) % 10000 for g in grams(t)[1]) for t in texts]


def test_bracket_is_widened_until_counts_prove_it(spark):
    """A sketch of ten steps and scores of which a third are equal: the exact counts decide."""
    r = random.Random(8)
    values = [r.choice([5, r.randint(-1000, 1000), r.randint(-10, 10)]) for _ in range(4000)]
    rows = [(i, 30, 1, v, v) for i, v in enumerate(values)]
    stored = written(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long"), "test-scores")
    for k in (1, 2, 200, 1333, 2000, 3999, 4000):
        low, high, above = resampling.bracket(stored, k, len(values), accuracy=10)
        assert sum(v > high for v in values) == above < k <= sum(v >= low for v in values)
    for percent in (1, 33, 50, 100):
        got = {x["doc_id"]: x["rank"] for x in resampling.drawn(stored, percent).collect()}
        order = sorted(range(len(values)), key=lambda i: (-values[i], i))
        expected = {d: (n + 1 if n < percent * len(values) // 100 else None) for n, d in enumerate(order)}
        assert got == expected


# 12


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=3):
    """leaf, subroot, root, proof, folded root, verified of each row, in plain loops."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            run = i // arity * arity
            yield level[run:i], level[i + 1 : run + arity]
            i //= arity

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    trees = {s: levels([x[2] for x in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            whole = [*path(trees[s], i), *path(top, k)]
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            again = leaf_of(r, r["text"].replace("\n", "") if even and r["text"] is not None else r["text"])
            for left, right in whole:
                again = digest(*left, again, *right)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], digest(*[h for pair in whole for side in pair for h in side]), again, again == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_on_odd_rows(spark, odd_docs, tmp_path):
    folder = stored_folder(odd_docs, spark.createDataFrame([], "item_id long, text string"), tmp_path / "odd")
    got = sorted(map(tuple, merkle.op12_merkle_manifest(spark, folder).collect()), key=repr)
    # Of equal rows, which one comes first makes no difference to the set of rows.
    assert got == brute_manifest(documents(odd_docs)) and any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n_sources", [1, 2, 11])
def test_manifest_of_groups_of_many_sizes(spark, tmp_path, n_sources):
    """Groups of 1 to 100 rows and one hot one, ids in no order, sources that differ beyond ASCII, and a null one."""
    r = random.Random(n_sources)
    names = [None, "", "b", "B", "é", "日", "a", "aa", "z", "\U00010000", "￿"][:n_sources]
    rows = [(r.randrange(10**6), f"t\n{r.random()}" if r.random() < 0.9 else None, None, s, 3) for k, s in enumerate(names) for _ in range(100 if k == 1 else 1 + 3 * k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    folder = stored_folder(docs, spark.createDataFrame([], "item_id long, text string"), tmp_path / "many")
    assert sorted(map(tuple, merkle.op12_merkle_manifest(spark, folder).collect()), key=repr) == brute_manifest(documents(docs))


def test_manifest_of_an_empty_table(spark, no_docs, tmp_path):
    folder = stored_folder(no_docs, spark.createDataFrame([], "item_id long, text string"), tmp_path / "none")
    assert merkle.op12_merkle_manifest(spark, folder).collect() == []


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_of_other_arities(spark, arity):
    """Two to a run are joined by XOR. Every proof leads to the root, and a changed leaf doesn't."""
    rows = spark.createDataFrame([(i, f"s{i % 3}", f"text {i}") for i in range(61)], "doc_id long, source string, text string")
    made = merkle.manifest(rows.withColumn("h", merkle.leaf(rows, ("doc_id", "text"))), arity=arity, keep=("doc_id",))
    levels = [[bytes(x["h"]).hex() for x in made.leaves.filter(F.col("doc_id") % 3 == s).orderBy("doc_id").collect()] for s in range(3)]

    def top(nodes):
        while len(nodes) > 1:
            nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        return nodes[0]

    assert made.root == top([top(x) for x in levels])
    out = made.proofs().select(merkle.shown(merkle.folded(F.col("path"), F.col("h"))).alias("a"), merkle.shown(merkle.folded(F.col("path"), merkle.digest(F.lit("x")))).alias("b")).collect()
    assert len(out) == 61 and all(r["a"] == made.root != r["b"] for r in out)


def test_plan_of_the_proofs_has_one_join_a_level(spark):
    """Groups that end on different levels: the driver holds no plan of the upper tree once more for each level."""
    rows = spark.createDataFrame([(i, f"s{s}", f"text {i}") for s in range(5) for i in range(1 + 4**s)], "doc_id long, source string, text string")
    made = merkle.manifest(rows.withColumn("h", merkle.leaf(rows, ("doc_id", "text"))), keep=("doc_id",))
    out = made.proofs()
    assert out.filter(merkle.shown(merkle.folded(F.col("path"), F.col("h"))) == made.root).count() == rows.count()
    # One more for the leaves' own columns.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == len(made.own.levels) + 1


# 13


def test_gradients_against_differences():
    """Analytic gradients against differences of the loss, in double precision."""
    r = np.random.default_rng(0)
    net = language.ByteNetwork.fresh(["a", "b", "c"], seed=1)
    net.filters, net.bias, net.out, net.out_bias = [f.astype(float) for f in net.filters], r.normal(0, 0.1, len(net.bias)), net.out.astype(float), net.out_bias.astype(float)
    x, y, weight = r.integers(97, 105, (6, language.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.array([1, 2, 3, 1, 1, 1.0])
    loss = lambda: -(weight * np.log(net.probabilities(x)[np.arange(6), y])).sum() / weight.sum()
    for p, g in zip(net.parameters(), net.gradients(x, y, weight)):
        at = [tuple(r.integers(0, n) for n in p.shape) for _ in range(5)] + [tuple(i[0] for i in np.nonzero(g))]
        for i in at:
            kept = p[i]
            p[i] = kept + 1e-6
            up = loss()
            p[i] = kept - 1e-6
            down = loss()
            p[i] = kept
            assert (up - down) / 2e-6 == pytest.approx(g[i], abs=2e-4)


def test_network_against_plain_loops():
    """Filters as sums of look-ups, pooling, the last layer, and the mean over windows by letters."""
    net = language.ByteNetwork.fresh(["a", "b"], seed=5)
    texts = ["Ab cé!", "x" * 300 + " 123 " * 50, "ß"]

    def one(window):
        hidden = []
        for w, width in zip(net.filters, language.WIDTHS):
            for f in range(language.FILTERS):
                hidden.append(max(sum(w[j, window[p + j], f] for j in range(width)) for p in range(len(window) - width + 1)))
        z = np.maximum(np.array(hidden) + net.bias, 0) @ net.out + net.out_bias
        return np.exp(z) / np.exp(z).sum()

    for text, got in zip(texts, language.judged(net, texts)):
        raw = text.lower().encode()
        parts = [raw[i : i + language.WINDOW] for i in range(0, len(raw), language.WINDOW)]
        letters = [sum(97 <= b <= 122 or b >= 128 for b in p) for p in parts]
        expected = sum(n * one(p.ljust(language.WINDOW, b"\0")) for n, p in zip(letters, parts) if n) / sum(letters)
        assert got == pytest.approx(expected, abs=1e-4)


def test_language_of_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = queries()["op13_byte_cnn"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = pd.Series([zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]])
    assert (out["held_out"] == held).all() and held.sum() > 200 and out["score"].between(0, 1).all()
    assert (out["lang_pred"] == out["lang"])[held].mean() > 0.99


def test_language_learns_nothing_from_held_out_rows(spark):
    """Rows with another alphabet and a label of their own, all held out: nothing is ever that label."""
    rows = [(i, f"{prose(i, 40)}", "en", "s", 1, None, None) for i in range(40)]
    secret = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(i, "кириллица слова " * 5, "ru", "s", 1, None, None) for i in secret]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    net = language.trained(language.sample(docs, ~language.held_out(F.col("doc_id"))))
    assert net.languages == ["en"]
    assert {r["lang_pred"] for r in language.identified(docs, net).collect()} == {"en"}


def test_language_sample_is_bounded_and_spread(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 3)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, f"text {i}", "big", "s", 1, None, None) for i in range(50)] + [(i, "t", "mid", "s", 1, None, None) for i in range(100, 110)] + [(1, "t", "rare", "s", 1, None, None), (2, None, "mid", None, None, None, None), (3, "t", None, None, None, None, None)]
    got = Counter(r["lang"] for r in language.sample(spark.createDataFrame(rows, DOCUMENTS)).collect())
    assert got == {"big": 3, "mid": 3}


def test_language_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    net = language.trained(language.sample(odd_docs))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identified(odd_docs, net).collect()}
    assert len(language.identified(odd_docs, net).collect()) == odd_docs.count()
    assert {p for _, p, _ in got} == {"en", "und"} and (0, "und", 0.0) in got and ((1 << 62) + 1, "en", 1.0) in got
    assert language.trained(language.sample(no_docs)) is None and language.identified(no_docs, net).collect() == []
    assert {r["lang_pred"] for r in language.identified(odd_docs, None).collect()} == {"und"}
    letters = ["", "12 !", "٣٤", "½²", "a", "1é", "Ⅷ", "日", "_"]
    assert [language.has_letter(t) for t in letters] == [any(c.isalpha() for c in t) for t in letters]
