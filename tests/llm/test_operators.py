"""Each operator against a brute-force version, on odd rows, on repeated and crowded ones, and on empty tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, components, labelled, line_crf, ordinal, packing, quality_eb, sharding, simhash, similar, sstable, substring, tokens, topk
from ledgerlake.llm.common import fresh_dir, table, written
from ledgerlake.llm.queries import oracle_sql, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_registry_has_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


# 1


def test_empirical_bayes_shrinks_sparse_sites(spark):
    rows = [(i, "big", "a", 0.9) for i in range(200)] + [(1000 + i, "bad", "a", 0.1) for i in range(200)] + [(5000, "tiny", "a", 0.1), (None, "", "", 0.5)]
    out = {r["doc_id"]: r for r in quality_eb.combined(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()}
    assert len(out) == len(rows)
    assert out[0]["host_quality"] > 0.85 and out[1000]["host_quality"] < 0.15
    # One document hardly moves its site from the corpus mean.
    assert 0.15 < out[5000]["host_quality"] < 0.5 and out[0]["kept"] and not out[1000]["kept"]


def brute_quality(rows):
    """rows: host, path, p. Posterior and final quality of each, by the definition in plain loops."""
    mean = sum(p for *_, p in rows) / len(rows)
    groups = lambda keys: {k: [p for h, q, p in rows if keys(h, q) == k] for k in {keys(h, q) for h, q, _ in rows}}
    hosts, paths = groups(lambda h, q: h), groups(lambda h, q: (h, q))

    def strength(own, parent_of):
        n, k = len(rows), len(own)
        parents = {parent_of(g) for g in own}
        within = max(1e-9, sum(sum((p - sum(x) / len(x)) ** 2 for p in x) for x in own.values()) / (n - k))
        between = size = free = 0.0
        for parent in parents:
            some = [x for g, x in own.items() if parent_of(g) == parent]
            count = sum(map(len, some))
            center = sum(map(sum, some)) / count
            between += sum(len(x) * (sum(x) / len(x) - center) ** 2 for x in some)
            size += count - sum(len(x) ** 2 for x in some) / count
            free += len(some) - 1
        if free < 1:
            return 1e6
        spread = (between - free * within) / max(1e-9, size)
        return min(1e6, max(1.0, within / spread)) if spread > 0 else 1e6

    by_host, by_path = strength(hosts, lambda g: 0), strength(paths, lambda g: g[0])
    odds = lambda p: np.log(p / (1 - p))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + by_host * mean) / (len(hosts[h]) - 1 + by_host)
        path = (sum(paths[h, q]) - p + by_path * host) / (len(paths[h, q]) - 1 + by_path)
        out.append((host, path, 1 / (1 + np.exp(-(odds(p) + 0.5 * (odds(path) - odds(mean)))))))
    return out, by_path


@pytest.mark.parametrize("paths_differ", [False, True])
def test_quality_against_brute_force(spark, paths_differ):
    """Hosts that differ in any case, paths within a host only where asked: then alone they lose the pull to their host."""
    r = np.random.default_rng(6)
    rows = []
    for h in range(12):
        base = r.uniform(0.2, 0.8)
        for q in range(4):
            own = np.clip(base + (r.uniform(-0.18, 0.18) if paths_differ else 0), 0.05, 0.95)
            rows += [(f"h{h}", f"q{q}", float(np.clip(own + r.normal(0, 0.03), 0.01, 0.99))) for _ in range(1 if q == 3 else 6)]
    expected, by_path = brute_quality(rows)
    scores = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = {x["doc_id"]: x for x in quality_eb.combined(scores).collect()}
    for i, (host, path, quality) in enumerate(expected):
        assert got[i]["host_quality"] == pytest.approx(host) and got[i]["path_quality"] == pytest.approx(path) and got[i]["quality"] == pytest.approx(quality)
    assert by_path < 3 if paths_differ else by_path > 20


def test_empirical_bayes_on_odd_and_empty_tables(odd_docs, no_docs, labels, no_labels):
    weights = quality_eb.trained(odd_docs, labels)
    out = quality_eb.combined(quality_eb.evidence(odd_docs, weights, F.col("source"), F.col("lang"))).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["quality"] <= 1 for r in out)
    assert sum(r["doc_id"] == (1 << 62) + 1 for r in out) == 1
    none = quality_eb.evidence(no_docs, quality_eb.trained(no_docs, no_labels), F.col("source"), F.col("lang"))
    assert quality_eb.combined(none).collect() == []


def test_quality_finds_held_out_labels(spark, sf_dir):
    docs, known = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    scores = quality_eb.combined(quality_eb.evidence(docs, quality_eb.trained(docs, known.filter(half)), F.col("source"), F.col("lang")))
    judged = scores.join(known.filter(~half).withColumnRenamed("quality", "label"), "doc_id").toPandas()
    assert (judged["kept"] == (judged["label"] == 1)).mean() > 0.95


def test_site_of(spark):
    host, path = quality_eb.site_of(F.col("u"))
    df = spark.createDataFrame([("https://Ab.example.com:80/x/y?q#f",), ("nope",), (None,), ("http://h",)], "u string").select(host, path)
    assert rows_of(df) == [("ab.example.com", "x"), ("", ""), (None, None), ("h", "")]


# 2


def base(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_line_crf_base_counts(odd_docs, labels):
    field = line_crf.trained(odd_docs, labels)
    out = line_crf.judged(odd_docs, field)
    found = sorted(map(str, rows_of(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))))
    assert found == sorted(str((i, *base(t))) for i, t in texts_of(odd_docs))
    assert not out.filter("base_failed and kept").count()
    assert line_crf.filtered(odd_docs, field).columns == odd_docs.columns


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(0)
    for _ in range(50):
        field = line_crf.LineField(r.normal(size=len(line_crf.FEATURES)), float(r.normal()), r.normal(size=(2, 2)))
        masks = r.integers(0, 1 << len(line_crf.FEATURES), size=6).tolist()

        def total(labels):
            return sum(field.score(m) for m, y in zip(masks, labels) if y) + sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))

        every = [[x >> i & 1 for i in range(6)] for x in range(64)]
        assert total(field.labels(masks)) == pytest.approx(max(map(total, every)))


def test_line_crf_separates_held_out_labels(spark):
    docs, known = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    out = line_crf.judged(docs, line_crf.trained(docs, known.filter(half))).join(known.filter(~half), "doc_id").filter("not base_failed").toPandas()
    assert (out["kept"] == (out["quality"] == 1)).mean() > 0.95


def test_line_crf_without_labels_keeps_content(no_docs, no_labels):
    field = line_crf.trained(no_docs, no_labels)
    assert field.labels([0, 1, 2]) == [0, 0, 0] and line_crf.judged(no_docs, field).collect() == []


# 3 and 5


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_sstable_round_trip(spark, odd_docs, byte_tokenizer):
    manifest = sstable.write_tables(odd_docs, fresh_dir(spark, "sst"), public_tokenizers.path(sstable.TOKENIZER), file_bytes=20_000)
    found = sorted(sstable.read_tables(manifest).collect(), key=lambda r: r["start"])
    order = sorted(texts_of(odd_docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start = 0
    for r, (doc_id, text) in zip(found, order, strict=True):
        ids = [*byte_tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (doc_id, start, len(ids), zlib.crc32(packed), packed)
        start += len(ids)
    asked = spark.createDataFrame([(5,), (13,), (777,), ((1 << 62) + 1,)], "doc_id long")
    assert Counter(r["doc_id"] for r in sstable.lookup(manifest, asked).collect()) == {5: 4, 13: 1, (1 << 62) + 1: 1}


def test_sstable_blocks_and_damage(tmp_path):
    path = tmp_path / "t.sst"
    with path.open("wb") as f:
        w = sstable.TableWriter(f)
        for i in range(-5000, 5000):
            w.add(sstable.key_of(2 * i), struct.pack("<3I", i & 0xFFFF, 70_000, 2))
        w.close()
    with path.open("rb") as f:
        r = sstable.TableReader(f)
        assert len(r.blocks) > 1 and r.docs == 10_000 and r.get(1) == [] and r.get(-9998) == [struct.pack("<3I", -4999 & 0xFFFF, 70_000, 2)]
        assert [k for k, _ in r.scan()] == [2 * i for i in range(-5000, 5000)]
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(ValueError):
        list(sstable.TableReader(f).scan())


def test_sstable_of_nothing(spark, no_docs):
    manifest = sstable.write_tables(no_docs, fresh_dir(spark, "sst"), public_tokenizers.path(sstable.TOKENIZER))
    assert manifest.collect() == [] and sstable.read_tables(manifest).collect() == []


def test_byte_tokenizer_is_the_library(byte_tokenizer):
    own, r = tokens.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(1)
    for letters in ("ab \n", "the in's 12 .,\t\n", "x é<|endoftext|>\x1c\x85 "):
        for _ in range(500):
            text = "".join(r.choice(list(letters), size=r.integers(0, 20)))
            assert own.ids(text) == struct.pack(f"<{len(x := byte_tokenizer.encode(text, add_special_tokens=False).ids)}I", *x)


def test_prefix_bpe_is_the_library(odd_docs, no_docs):
    path = public_tokenizers.path(bpe.TOKENIZER)
    library = Tokenizer.from_file(path)
    own, r = bpe.WordTokenizer(path), np.random.default_rng(2)
    letters = list("ab thein's.!é\x1c Σß١") + ["<|endoftext|>", "́", "Ꟛ", "aa"]
    for _ in range(1500):
        text = "".join(r.choice(letters, size=r.integers(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        packed, decoded = own.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids)
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)
    expected = []
    for doc_id, text in texts_of(odd_docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append(str((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())))
    assert sorted(map(str, rows_of(bpe.encoded(odd_docs, path, keep_ids=False)))) == sorted(expected)
    assert bpe.encoded(no_docs, path).collect() == []


# 4


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(odd_docs, no_docs):
    out = simhash.groups(odd_docs).collect()
    docs = texts_of(odd_docs)
    fps = sorted({brute_fingerprint(t) for _, t in docs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    smallest = {}
    for doc_id, text in docs:
        if doc_id is not None:
            c = find(brute_fingerprint(text))
            smallest[c] = min(doc_id, smallest.get(c, doc_id))
    expected = sorted(str((i, brute_fingerprint(t), smallest.get(find(brute_fingerprint(t))))) for i, t in docs)
    assert sorted(str((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in out) == expected
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({find(brute_fingerprint(t)) for _, t in docs})
    assert simhash.groups(no_docs).collect() == [] and simhash.deduplicated(no_docs).collect() == []


@pytest.mark.parametrize("run", [4096, 8])
def test_links_of_crowded_keys(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash, "TILE", run // 2)
    r = np.random.default_rng(3)
    centres = [int(x) for x in r.integers(0, 1 << 63, size=4)]
    fps = set()
    for _ in range(160):
        x = centres[int(r.integers(0, 4))]
        for b in r.integers(0, 64, size=int(r.integers(0, 4))):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    links = simhash.links(spark.createDataFrame([(simhash._long(f),) for f in fps], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    group = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    for f in fps:
        own = {simhash._long(x) for x in group[f]}
        assert got.get(simhash._long(f), simhash._long(f)) == min(own)


def near_copies(seed, groups=6, copies=9):
    """Texts and copies with more and more words changed: similarities on both sides of the threshold."""
    r = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in r.integers(0, 4000, size=int(r.integers(60, 260)))]
        for c in range(copies):
            words = list(base)
            for at in r.integers(0, len(words), size=c * len(words) // 150):
                words[at] = f"x{r.integers(0, 10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("run", [4096, 8])
def test_similar_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash, "TILE", run // 2)
    texts = near_copies(5)
    docs = spark.createDataFrame([(i, t.upper() if i % 7 == 0 else t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for a in range(len(texts)):
        for b in range(a):
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            near += 0.6 < share < 0.8
            if share >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert near > 20
    assert sorted(r["doc_id"] for r in similar.deduplicated(docs).collect()) == sorted({find(i) for i in range(len(texts))})


def test_forest_spans_what_is_close():
    fps = np.array([0, 1, 3, 7, 15, 1 << 40], np.int64)
    told = simhash.forest(fps, np.zeros(6, np.int64), 3)
    assert len(told) == 5 and all((int(fps[i]) ^ int(fps[j])).bit_count() <= 3 for i, j in told)
    assert simhash.forest(fps, np.arange(6), 3) == []


def test_forest_of_a_full_run_is_bounded():
    """A run of RUN fingerprints, nearly all within the radius: a link each, and little memory."""
    import tracemalloc

    r = random.Random(3)
    fps = np.unique(np.array([sum(1 << b for b in r.sample(range(40), r.randint(0, 4))) for _ in range(20_000)], np.int64))[: simhash.RUN]
    assert len(fps) == simhash.RUN
    tracemalloc.start()
    told = simhash.forest(fps, np.zeros(len(fps), np.int64), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(told) == len(fps) - 1 and peak < 64 << 20


def repeated_and_short_texts():
    """Texts and copies with a line repeated in one of them only, and short texts with a copy of a word more or less."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    texts = []
    for n, line, times in [(1000, 20, 20), (1000, 30, 50), (300, 12, 10)] * 8:
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(line)] * times)]
    for shingles in list(range(5, 16)) * 6:
        base = [word() for _ in range(shingles + 4)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join([*base[:-1], word(), word()])]
    return texts


def test_similar_with_repeated_lines_and_few_shingles(spark):
    from test_pipeline import smallest_of_similar

    rows = [{"doc_id": i, "text": t} for i, t in enumerate(repeated_and_short_texts())]
    docs = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string")
    assert {x["doc_id"] for x in similar.deduplicated(docs).collect()} == smallest_of_similar(rows)


@pytest.mark.parametrize("few, tile_bytes", [(similar.FEW, 2000), (1, 2000), (1, similar.TILE_BYTES), (100, 2000)])
def test_what_the_proposals_miss_is_found(spark, monkeypatch, few, tile_bytes):
    """Without any proposal the exact path alone finds every group: by pairs, in one tile or in many."""
    from test_pipeline import smallest_of_similar

    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "TILE_BYTES", tile_bytes)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randrange(8)):
            words[r.randrange(120)] = f"x{i}"
        rows.append({"doc_id": i, "text": " ".join(words)})
    docs = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string")
    found = similar.nodes(docs)
    nobody = spark.createDataFrame([], "node long, root long")
    linked = similar.joined(nobody, similar.missed(docs, found, nobody, similar.SIMILARITY, similar.SHINGLE))
    groups = found.join(linked, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first.id").alias("id"))
    assert {x["id"] for x in groups.collect()} == smallest_of_similar(rows)


def test_sketches_lose_no_pair_that_holds():
    r = np.random.default_rng(5)
    sets = []
    for n in r.integers(1, 500, 120).tolist():
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        more = r.integers(0, 1 << 63, int(r.integers(0, max(2, n // 3))), dtype=np.uint64)
        sets += [a, np.unique(np.concatenate([a[: len(a) - int(r.integers(0, max(1, len(a) // 4)))], more]))]
    sizes, sketches = np.array([len(x) for x in sets]), [similar.sketch_of(x) for x in sets]
    holds = [(i, j) for i in range(len(sets)) for j in range(i) if similar.similarity(sets[i], sets[j]) >= 0.8]
    assert holds and all(similar.sketches_allow(sketches[i], sketches[j], sizes[i] + sizes[j], 0.8) for i, j in holds)
    mask = similar.may_hold(np.arange(len(sets)), sizes, sketches, 0.8)
    assert mask[np.unique(holds)].all()
    apart = similar.may_hold(np.arange(0, len(sets), 2), sizes[::2], sketches[::2], 0.8)
    assert apart[sizes[::2] > 64].sum() == 0
    assert not similar.may_hold(np.zeros(len(sets), int), sizes, sketches, 0.8).any()


def test_similar_on_odd_and_empty_tables(odd_docs, no_docs):
    kept = similar.deduplicated(odd_docs)
    nodes = {tuple(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t in texts_of(odd_docs)}
    assert kept.columns == odd_docs.columns and kept.count() == len(nodes)
    assert similar.deduplicated(no_docs).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# 6


def brute_removal(docs, window=35):
    counts = Counter()
    for _, t in docs:
        w = WORD.findall(t or "")
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc_id, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def prose_like(r, n):
    return " ".join(f"w{i}" for i in r.integers(0, 10_000, size=n))


@pytest.mark.parametrize("window", [5, 20, 35, 64])
def test_levels_find_windows_of_any_length(spark, window, monkeypatch):
    """Passages a word shorter, as long as and longer than a window, at either end of texts, with counts in small parts."""
    monkeypatch.setattr(substring, "ROWS", 50)
    r = np.random.default_rng(window)
    passages = [prose_like(r, window + d).split() for d in (-1, 0, 1, window)]
    texts = [prose_like(r, int(n)).split() for n in r.integers(0, 3 * window, size=24)]
    for i, t in enumerate(texts):
        at = [0, len(t), int(r.integers(0, len(t) + 1))][i % 3]
        t[at:at] = passages[i % 4]
    docs = spark.createDataFrame([(-(1 << 63) if i == 0 else None if i == 1 else i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected = sorted(str((i, n, gone, hashlib.sha256(kept.encode()).hexdigest())) for i, n, gone, kept in brute_removal(texts_of(docs), window))
    assert sorted(map(str, rows_of(substring.removal_digest(docs, window)))) == expected
    lengths = substring.levels(window)
    assert lengths[-1] == window and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:])) and substring.levels(35) == [9, 18, 35]


def test_substrings_against_brute_force(spark, odd_docs, no_docs):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(list("ab"), size=r.integers(20, 120))) for _ in range(30)] + ["x " * int(n) for n in r.integers(1, 100, size=15)]
    crowd = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (odd_docs, crowd):
        expected = sorted(str((i, n, gone, hashlib.sha256(kept.encode()).hexdigest())) for i, n, gone, kept in brute_removal(texts_of(docs)))
        assert sorted(map(str, rows_of(substring.removal_digest(docs)))) == expected
    assert substring.removal_digest(no_docs).collect() == []
    assert substring.decisions(substring.keyed(spark.createDataFrame([(1, prose_like(r, 200)), (2, prose_like(r, 200))], "doc_id long, text string"))).collect() == []
    left = substring.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    changed = Counter(t if not gone else kept for (_, t), (_, _, gone, kept) in zip(texts_of(odd_docs), brute_removal(texts_of(odd_docs))))
    assert Counter(r["text"] for r in left.collect()) == changed


# 7


def test_packing_is_whole_and_tight(spark, odd_docs, no_docs, byte_tokenizer):
    out = pd.DataFrame([r.asDict() for r in packing.packed_documents(odd_docs).collect()])
    expected = Counter()
    for doc_id, text in texts_of(odd_docs):
        ids = [*byte_tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected.update((doc_id, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = Counter((None if pd.isna(d) else int(d), p, s, n, c) for d, p, s, n, c in zip(*(out[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32"))))
    # Two ids of the pandas frame are floats; compare those that it holds exactly.
    assert sum(got.values()) == sum(expected.values()) and {k[1:]: v for k, v in got.items()} == {k[1:]: v for k, v in expected.items()}
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packing.packed_documents(no_docs).collect() == []


def test_pair_sums_name_every_sum_once():
    sizes = np.array([5, 5, 3, 9, 3, 1], np.int64)
    told = packing.pair_sums(np.arange(6), sizes)
    assert sorted(t for t, _, _ in told) == sorted({int(sizes[i] + sizes[j]) for i in range(6) for j in range(i)})
    assert all(x != y and sizes[x] + sizes[y] == t for t, x, y in told)


def test_local_search_looks_beyond_the_first_documents():
    """The emptiest bin has 20 documents; only two of the last ones together fit where the other bin has room."""
    sizes = [40] * 18 + [7, 8] + [500, 509]
    end = packing.local_search([list(range(20)), [20, 21]], sizes, 1024)
    assert sorted(map(len, end)) == [4, 18] and max(sum(sizes[i] for i in b) for b in end) == 1024


def test_packing_deals_equal_rows_out(spark):
    """20,000 equal rows: no group gets more than its share, and the sequences are as few as can be."""
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"))
    pieces = written(packing.pieces_of(docs, public_tokenizers.path(packing.TOKENIZER)), "pieces")
    out = packing.pack(pieces, 1024, group=1000).toPandas()
    n = int(out["length"].iloc[0])
    assert len(out) == 20_000 and out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert out["sequence_id"].nunique() == -(-20_000 // (1024 // n))


def test_packing_matches_the_optimum_of_small_cases():
    """Every way to pack up to seven pieces is tried: never better than one sequence fewer."""
    from functools import cache as memo

    r = random.Random(8)

    def optimum(sizes: tuple[int, ...]) -> int:
        @memo
        def least(rest: tuple[int, ...], room: int) -> int:
            if not rest:
                return 0
            best = 99
            for i, s in enumerate(rest):
                left = rest[:i] + rest[i + 1 :]
                best = min(best, least(left, room - s) if s <= room else 1 + least(left, 20 - s))
            return best

        return least(sizes, 0)

    off = 0
    for _ in range(60):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 7))]
        bins = packing.local_search(packing.best_fit(sizes, 20), sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in bins) <= 20
        off += len(bins) - optimum(tuple(sorted(sizes)))
    assert off <= 2


def test_tables_split_a_hot_id(spark):
    """Two thirds of the rows share an id, or have none: several files hold them, starts are gapless, look-ups find all."""
    docs = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id") + 1000).alias("doc_id"), F.repeat(F.concat(F.lit(" text "), F.col("id").cast("string")), 500).alias("text")).repartition(6)
    manifest = sstable.write_tables(docs, fresh_dir(spark, "sst-hot"), public_tokenizers.path(sstable.TOKENIZER), file_bytes=65_000)
    rows = sstable.read_tables(manifest).orderBy("start").toPandas()
    assert len(rows) == 300 and manifest.count() > 3 and (rows["start"].to_numpy()[1:] == rows["n_tokens"].cumsum().to_numpy()[:-1]).all()
    ids = rows["doc_id"].dropna()
    assert rows["doc_id"].isna().to_numpy()[:100].all() and ids.is_monotonic_increasing
    found = sstable.lookup(manifest, spark.createDataFrame([(5,), (1001,), (4,), (None,)], "doc_id long")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found} == {5: 100, 1001: 1}


def test_known_forgets_long_keys_and_stays_small():
    known = bpe.Known(len, most=10, longest=4)
    assert [known["x" * n] for n in (1, 2, 5, 500)] == [1, 2, 5, 500] and set(known) == {"x", "xx"}
    for i in range(100):
        known[str(i)]
    assert len(known) <= 10 and len(known.old) <= 10


def test_local_search_keeps_items_and_helps():
    r = np.random.default_rng(5)
    better = 0
    for _ in range(40):
        sizes = r.integers(1, 1024, size=int(r.integers(1, 120))).tolist()
        start = packing.best_fit(sizes, 1024)
        end = packing.local_search([list(b) for b in start], sizes, 1024)
        assert sorted(i for b in end for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 1024 for b in end)
        assert len(end) <= len(start)
        squares = [sum(sum(sizes[i] for i in b) ** 2 for b in bins) for bins in (start, end)]
        assert squares[1] >= squares[0]
        better += squares[1] > squares[0]
    assert better > 10


def test_second_round_packs_loose_bins_again(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 300 + i % 400, i) for i in range(400)] + [(i, 1, 300, 1024, i) for i in range(5)], packing.PIECES)
    out = packing.pack(pieces, group=50).toPandas()
    assert len(out) == 405 and out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert out["sequence_id"].nunique() <= 5 + 1.15 * sum(300 + i % 400 for i in range(400)) / 1024


def groups_of(out):
    """Pieces of each round and group."""
    ids = out["sequence_id"].to_numpy()
    return out.groupby([ids >> 56, (ids >> 24) & 0xFFFFFFFF]).size()


def test_pieces_that_never_meet_stay_in_their_groups(spark):
    """200,000 pieces of more than half a sequence: no bin can be saved, and no group grows."""
    pieces = written(spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32")), "big-pieces")
    out = packing.pack(pieces, group=400).toPandas()
    assert len(out) == 200_000 == out["sequence_id"].nunique() and groups_of(out).max() < 600


def test_rounds_end_near_the_bound(spark):
    """Large pieces in the first half of the table, small ones in the second, and no group of more than a few hundred."""
    r = np.random.default_rng(4)
    sizes = np.concatenate([r.integers(500, 900, 6000), r.integers(1, 400, 6000)])
    pieces = written(spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], packing.PIECES), "mixed-pieces")
    out = packing.pack(pieces, group=300).toPandas()
    fills = out.groupby("sequence_id")["length"].sum()
    assert len(out) == len(sizes) and fills.max() <= 1024 and groups_of(out).max() < 450
    assert sorted(zip(out["doc_id"], out["length"])) == list(enumerate(sizes))
    assert len(fills) <= 1.01 * packing.least_bins(Counter(sizes.tolist()), 1024)
    for _, b in out.sort_values("offset").groupby("sequence_id"):
        assert b["offset"].tolist() == [0, *b["length"].cumsum().tolist()[:-1]]


def test_least_bins_is_a_bound():
    r = random.Random(2)
    assert packing.least_bins({600: 7}, 1024) == 7 and packing.least_bins({512: 7}, 1024) == 4 and packing.least_bins({600: 3, 424: 3}, 1024) == 3 and packing.least_bins({}, 1024) == 0
    for _ in range(200):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 12))]
        bins = packing.local_search(packing.best_fit(sizes, 20), sizes, 20)
        assert -(-sum(sizes) // 20) <= packing.least_bins(Counter(sizes), 20) <= len(bins)


# 8


def test_virtual_slots(odd_docs, no_docs):
    out = sharding.shard(odd_docs).collect()
    docs = texts_of(odd_docs)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in out) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    # Equal records share a slot unless there are very many; other texts of the same id don't have to.
    assert len({r["vslot"] for r in out if r["doc_id"] == 5 and r["text_crc32"] == zlib.crc32(dict(docs)[6].encode())}) == 1
    assert sharding.shard(no_docs).collect() == []


def test_virtual_slots_are_near_equal_and_grow_into_the_new_shard(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    loads = [r["b"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) < 1.01 * min(loads)
    first = sharding.initial_map(spark)
    after = first.join(sharding.grown(first, 16).select("vslot", F.col("shard").alias("to")), "vslot").toPandas()
    moved = after[after["shard"] != after["to"]]
    assert set(moved["to"]) == {16} and len(moved) == pytest.approx(4096 / 17, abs=17)


@pytest.mark.parametrize("copies", [False, True])
def test_a_hot_id_is_spread(spark, copies):
    """Half of all rows have one id, with texts of their own or all the same: shards within a hundredth, no crowded slot."""
    r = random.Random(1)
    rows = [(7 if i % 2 else i, "copy " * 20 if copies and i % 2 else "x" * r.randint(50, 150), "clash") for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(8)
    out = sharding.shard(docs).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(loads) == 16 and loads.max() < 1.01 * loads.min()
    assert out["vslot"].value_counts().max() < 60
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))


# 9


def test_ordinal_orders_grades_and_finds_held_out_labels(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 3))
    grades = np.digitize(x @ [2.0, -1.0, 0.0] + 0.1 * r.normal(size=600), [-1.0, 0.5, 2.0])
    w, thresholds = ordinal.fit(x, grades, 4)
    assert w[0] > 0 > w[1] and list(thresholds) == sorted(thresholds)
    docs, known = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    model = ordinal.trained(docs, known.filter(half))
    out = ordinal.scored(docs, model).join(known.filter(~half).select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    clean, toxic = out[out["label"] == 0], out[out["label"] == 1]
    assert clean["toxic"].mean() < 0.01 and toxic["toxic"].mean() > 0.75
    assert toxic["expected_severity"].mean() > 0.7 > 5 * clean["expected_severity"].mean() and set(out["grades"]) == {2}


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.25), ("sf0.01", 0.6)])
def test_ordinal_finds_held_out_labels_of_few(spark, sf, least):
    docs, known = table(spark, f"/root/testdata/{sf}", "documents"), table(spark, f"/root/testdata/{sf}", "labels")
    part, outs = F.pmod(F.xxhash64("doc_id"), F.lit(4)), []
    for k in range(4):
        model = ordinal.trained(docs, known.filter(part != k))
        held = known.filter(part == k).select("doc_id", F.col("toxic").alias("label"))
        outs.append(ordinal.scored(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").toPandas())
    out = pd.concat(outs)
    assert out[out["label"] == 0]["toxic"].mean() < 0.015 and out[out["label"] == 1]["toxic"].mean() > least


def test_evidence_follows_the_number_of_words():
    many = np.array([1, 1, 1, 1597])
    assert ordinal.beyond_chance(np.array([23.0, 13.0, 9.0]), np.array([1, 1, 1])) == 9.0
    assert ordinal.beyond_chance(np.array([9.0, 23.0, 0.0, 13.0]), many[[0, 1, 3, 2]]) == 23.0
    assert ordinal.beyond_chance(np.array([3.0, 2.0, 0.0]), np.array([1, 1, 1598])) == np.inf


def test_vocabulary_against_plain_loops(spark, sf_dir):
    """Every word that tells is chosen, however many there are."""
    docs, known = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    sample = labelled.labelled_sample(docs, known, "toxic", 20_000)
    rows = [(set(ordinal.WORD((r["text"] or "").lower())), list(zip(w := ordinal.WORD((r["text"] or "").lower()), ["", *w])), r["label"]) for r in sample.collect()]
    n, m = sum(label > 0 for *_, label in rows), sum(label == 0 for *_, label in rows)
    a, b, before = Counter(), Counter(), ({}, {})
    for words, pairs, label in rows:
        (a if label else b).update(words)
        for w, prev in pairs:
            before[label].setdefault(w, set()).add(prev)
    tested = [w for w in {*a, *b} if a[w] + b[w] >= 3 and 2 * len(before[1].get(w, ())) >= a[w] and 2 * len(before[0].get(w, ())) >= b[w]]
    ratio = {w: float(ordinal.likelihood_ratio(np.array([a[w]], float), n, np.array([b[w]], float), m)[0]) for w in tested}
    chance = sorted((math.erfc(math.sqrt(max(r, 0) / 2)), w) for w, r in ratio.items())
    last = max(i for i, (p, _) in enumerate(chance) if p <= 0.05 * (i + 1) / len(chance))
    expected = {w: int(a[w] / n > b[w] / m) for p, w in chance if p <= chance[last][0]}
    assert dict(ordinal.vocabulary(sample)) == expected and 5 < len(expected)


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_fit_is_an_optimum_and_severity_a_sum(levels):
    """The penalised likelihood in plain loops, at the fitted point and around it; expected severity by its definition."""
    r = np.random.default_rng(levels)
    x = r.normal(size=(150, 2))
    grades = np.clip(np.digitize(x @ [1.0, -0.5] + r.logistic(size=150), np.linspace(-1, 1, levels - 1)), 0, levels - 1)
    w, thresholds = ordinal.fit(x, grades, levels)
    over = lambda w, t, row: [1.0, *(1 / (1 + math.exp(-(float(row @ w) - c))) for c in t), 0.0]

    def loss(w, t):
        return -sum(math.log(max(1e-12, over(w, t, row)[g] - over(w, t, row)[g + 1])) for row, g in zip(x, grades)) / len(x) + ordinal.NORM / 2 * float(w @ w)

    best = loss(w, thresholds)
    for _ in range(40):
        assert best <= loss(w + r.normal(0, 0.05, 2), np.sort(thresholds + r.normal(0, 0.05, levels - 1))) + 1e-4
    model = ordinal.Severity({"bad": 0.7, "worse": 1.5}, frozenset(["bad"]), (0.3, 0.2), list(thresholds))
    score, cum = model.score("Bad bad WORSE fine")
    by_hand = 0.7 * math.log(3) + 1.5 * math.log(2) + 0.3 * math.log(3) + 0.2 * math.log(51)
    assert score == pytest.approx(by_hand) and sum(cum) == pytest.approx(sum(1 / (1 + math.exp(t - by_hand)) for t in thresholds))


def test_line_model_of_a_text_of_very_many_lines(spark):
    """A labelled text of a million lines and a hundred short ones: as many stretches come to the driver as the bound says."""
    rows = [(i, "\n".join(f"A sentence of some words, number {j} of text {i}." for j in range(30)) if i % 2 else "\n".join(["home | login | cart"] * 30)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.createDataFrame([(1000,)], "doc_id long").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("Another sentence, longer than a menu is, of number "), i.cast("string"), F.lit("."))), "\n")))
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(1000, 1, 0)], "doc_id long, quality int, toxic int")
    field = line_crf.trained(docs, known, stretches=500)
    kept = line_crf.trained(docs.filter("doc_id < 1000"), known)
    menu, prose_line = (line_crf.line_masks(t)[0] for t in ("home | login | cart", "A sentence of some words, number 3 of text 4."))
    assert kept.labels(menu) == [1] and kept.labels(prose_line) == [0] and field.labels(prose_line) == [0]


def test_ordinal_on_odd_and_empty_tables(odd_docs, no_docs, labels, no_labels):
    model = ordinal.trained(odd_docs, labels)
    assert ordinal.scored(odd_docs, model).count() == odd_docs.count()
    nothing = ordinal.trained(no_docs, no_labels)
    assert ordinal.scored(odd_docs, nothing).filter("toxic").count() == 0 and ordinal.scored(no_docs, nothing).collect() == []
    assert ordinal.filtered(odd_docs, nothing).count() == odd_docs.count()


def test_labelled_sample_is_bounded(odd_docs, labels):
    assert labelled.labelled_sample(odd_docs, labels, "quality", 1).select("_id").distinct().count() <= 1


# 10


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(700, 16)).round(1) * 0.2
    v[100:350] = v[0]
    rows = [(i, [float(x) for x in row], "c") for i, row in enumerate(v)] + [(None, [1.0] * 16, "c"), (900, None, "c"), (950, [None] * 16, "c"), (1000, [float("nan")] * 16, "c"), (1050, [1.0], "c"), (3, [9.0] * 16, "c")]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"))
    got = [tuple(x) for x in topk.top_k(ints, ints.filter(topk.divisible(F.col("id"), 50)), candidate_block=64, query_block=4).orderBy("query_id", "rank").collect()]
    q = np.floor(256 * np.vstack([v, np.full((1, 16), 9.0)])).astype(int)
    ids = np.array([*range(700), 3])
    expected = []
    for i in range(0, 700, 50):
        best = [j for j in np.lexsort((ids, -(q @ q[i]))) if ids[j] != i][:5]
        expected += [(i, n + 1, int(ids[j]), int(q[j] @ q[i])) for n, j in enumerate(best)]
    assert got == expected
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.integers(nothing), topk.integers(nothing)).collect() == []


def test_top_k_of_few_and_of_large_values(spark):
    ints = topk.integers(spark.createDataFrame([(1, [1e6, 2.0]), (2, [3e6, 1.0]), (50, [1e6, -1.0])], "vec_id long, embedding array<double>"))
    got = [tuple(x) for x in topk.top_k(ints, ints.filter("id = 50")).orderBy("rank").collect()]
    assert got == [(50, 1, 2, 256 * 3 * 10**6 * 256 * 10**6 - 256 * 256), (50, 2, 1, 256 * 10**6 * 256 * 10**6 - 512 * 256)]


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_impact_index_stops_early_and_is_exact():
    """Candidates of which few are near a query: it stops before the last segment, with the right rows."""
    r = np.random.default_rng(2)
    values = r.integers(-20, 20, size=(500, 16))
    values[7] = 250
    values[8] = -250
    index = topk.ImpactIndex(np.arange(500), values)
    queries = np.array([[9] * 16, [-9] * 16, list(r.integers(-30, 30, size=16))])
    got = list(index.best(np.array([-1, -2, -3]), queries, 5))
    for q, asked in zip((-1, -2, -3), queries):
        scores = values @ asked
        assert [(i, s) for a, i, s in got if a == q] == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(500), -scores))[:5]]
    index.taken.clear()
    assert [(a, i) for a, i, _ in index.best(np.array([-1, -2]), queries[:2], 1)] == [(-1, 7), (-2, 8)] and max(index.taken) < 5


def test_field_is_fitted_on_all_lines():
    """Boilerplate stands only behind the sixty-fourth line of long texts: a fit on first lines could not know it."""
    plain, odd = 1 << 11, 1 << 2
    sequences = [[plain] * 200 for _ in range(20)] + [[odd] * 3 for _ in range(0)] + [[plain] * 100 + [odd] * 100 for _ in range(20)]
    field = line_crf.fit(sequences, [1] * 20 + [0] * 20)
    assert field.labels([odd] * 5) == [1] * 5


def test_sample_takes_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(r["_id"] for r in labelled.labelled_sample(docs, known, "quality").collect()) == [1, 2]
