"""The pipeline's stages against what the operators say of each stage's own input."""

from collections import Counter

import corpus_pipeline as pipeline
from ledgerlake.llm import line_crf, ordinal, packing, substring
from ledgerlake.llm.common import table, written


def smallest_of_similar(rows, least=0.8):
    """Ids that stay by brute force: the smallest of each group under links of the exact similarity."""
    sets = {}
    for r in rows:
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, known = docs.columns, table(spark, sf_dir, "labels")
    seen = {}
    for name, stage in pipeline.STAGES:
        seen[name] = before = docs
        docs = written(stage(spark, before, sf_dir), name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            if name != "substring_dedup":
                assert not Counter(docs.collect()) - Counter(before.collect())
    judged = line_crf.judged(seen["quality_rules"], line_crf.trained(seen["quality_rules"], known))
    assert {r["doc_id"] for r in judged.filter("kept").collect()} == {r["doc_id"] for r in seen["toxicity"].collect()}
    scored = ordinal.scored(seen["toxicity"], ordinal.trained(seen["toxicity"], known))
    assert {r["doc_id"] for r in scored.filter("not toxic").collect()} == {r["doc_id"] for r in seen["simhash_near_dedup"].collect()}
    assert smallest_of_similar(seen["simhash_near_dedup"].collect()) == {r["doc_id"] for r in seen["substring_dedup"].collect()}
    gone = {r["doc_id"]: r["n_removed"] for r in substring.removal_digest(seen["substring_dedup"]).collect()}
    left = {r["doc_id"]: r for r in seen["best_fit_packing"].collect()}
    for r in seen["substring_dedup"].collect():
        after = left[r["doc_id"]]
        assert len(after["text"].split()) == len(r["text"].split()) - gone[r["doc_id"]] and after["n_chars"] == len(after["text"])
        assert gone[r["doc_id"]] or after["text"] == r["text"]
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter(r["doc_id"] for r in packing.packed_documents(seen["best_fit_packing"]).collect())


def test_odd_rows_go_through(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    assert docs.count() > 0
