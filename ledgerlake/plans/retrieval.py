"""Retrieval queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import tokens
from ledgerlake.operators.core import top_per_group
from ledgerlake.operators.hybrid import Spec, Weights, hybrid_search
from ledgerlake.operators.retrieval import bm25 as bm25_scores, chunked, fused, nearest, overfetch, unit

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def asked(t: Tables, *more: str):
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *more)


def vectors(t: Tables, *more: str):
    return t.embeddings.select("vec_id", F.col("embedding").alias("v"), *more)


@query()
def paragraph_packing(t: Tables):
    """Chunks of packed paragraphs with overlap."""
    return chunked(t.documents).groupBy("doc_id").agg(row_count().alias("chunks"), F.max(F.length("chunk")).alias("longest"))


@query("""SELECT doc_id, i AS chunk, substr(text, i * 800 + 1, 900) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 100) / 800.0) AS BIGINT), 1) - 1)) AS i FROM documents WHERE length(text) > 20)""")
def fixed_chunks(t: Tables):
    """Fixed stride of 800 with an overlap of 100."""
    count = F.greatest(F.ceil((F.length("text") - 100) / 800.0), F.lit(1))
    rows = t.documents.filter(F.length("text") > 20).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk"))
    return rows.select("doc_id", "chunk", F.substring(F.col("text"), (F.col("chunk") * 800 + 1).cast("int"), F.lit(900)).alias("text"))


@query("""SELECT 'document' AS kind, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, length(text) FROM conversations""")
def chunk_union(t: Tables):
    """Chunks of several builders."""
    size = F.length("text").cast("long").alias("size")
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("id"), size)
    return part(t.documents, "document", F.col("doc_id")).unionByName(part(t.benchmark, "benchmark", F.col("item_id"))).unionByName(part(t.conversations, "turn", F.col("conv_id") * 1000 + F.col("turn")))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings""")
def l2_normalize(t: Tables):
    """Vectors at length one."""
    return t.embeddings.select("vec_id", F.round(F.get(unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query(f"""SELECT query_id, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rn <= 10""")
def knn_topk(t: Tables):
    """Nearest vectors of a stated query set, every twentieth vector."""
    return nearest(asked(t), vectors(t), 10)


@query(f"""SELECT query_id, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label)) WHERE rn <= 5""")
def filtered_knn(t: Tables):
    """The filter comes before the distance."""
    return nearest(asked(t, "label"), vectors(t, "label"), 5, "label")


@query(f"""SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS fetched FROM (SELECT q.vec_id AS query_id, v.vec_id, q.label AS own, v.label, round({DOT}, 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE fetched <= 24 AND own <> label QUALIFY rn <= 6""")
def overfetched_knn(t: Tables):
    """Four times as many candidates as wanted, 50 at most, as those of the query's own label are left out."""
    own, other = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), t.embeddings.select("vec_id", "label")
    found = nearest(asked(t), vectors(t), overfetch(6)).drop("rn").join(own, "query_id").join(other, "vec_id").filter("own <> label")
    return top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], 6).select("query_id", "vec_id", "score", "rn")


BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), p AS (SELECT doc_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES ('the'), ('and'), ('der')) q(term)), f AS (SELECT * FROM p WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
b AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN d USING (term), s GROUP BY 1)"""


@query(f"{BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 50")
def bm25(t: Tables):
    """R06."""
    return bm25_scores(t.documents, ["the", "and", "der"], "doc_id", "text").orderBy(F.col("score").desc(), "doc_id").limit(50)


@query(f"""{BM25}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 40)), e AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS dense_rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40)) SELECT doc_id, round(coalesce(0.55 / (40 + dense_rank), 0) + coalesce(0.45 / (40 + lexical_rank), 0), 8)::DOUBLE AS score FROM e FULL JOIN l USING (doc_id)""")
def rrf_fusion(t: Tables):
    """Fusion of two short lists; each is limited before it is ranked."""
    rank = lambda *order: F.row_number().over(Window.orderBy(*order))
    order = [F.col("score").desc(), F.col("doc_id")]
    lexical = bm25_scores(t.documents, ["the", "and", "der"], "doc_id", "text").orderBy(*order).limit(40).select("doc_id", rank(*order).alias("lexical_rank"))
    size = [F.col("n_chars").desc(), F.col("doc_id")]
    dense = t.documents.select("doc_id", "n_chars").orderBy(*size).limit(40).select("doc_id", rank(*size).alias("dense_rank"))
    return fused(dense, lexical, "doc_id").select("doc_id", "score")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part QUALIFY rk <= 30 UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part QUALIFY row_number() OVER (ORDER BY p_size DESC, p_partkey) <= 30) SELECT p_partkey, round(sum(1.0 / (60 + rk)), 8)::DOUBLE AS score FROM r GROUP BY 1""")
def rrf_multi(t: Tables):
    """Fusion of any number of lists."""
    lists = None
    for column in ("p_retailprice", "p_size"):
        order = [F.col(column).desc(), F.col("p_partkey")]
        one = t.part.orderBy(*order).limit(30).select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("rk"))
        lists = one if lists is None else lists.unionByName(one)
    return lists.groupBy("p_partkey").agg(F.round(F.sum(1.0 / (60 + F.col("rk"))), 8).alias("score"))


@query("""SELECT o_orderkey, round(o_totalprice * greatest(0.35, pow(0.5, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') / 365.0)), 4) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 50""")
def decay_rank(t: Tables):
    """Score times recency, sorted again."""
    weight = F.greatest(F.lit(0.35), F.pow(F.lit(0.5), F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate") / F.lit(365.0)))
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * weight, 4).alias("score")).orderBy(F.col("score").desc(), "o_orderkey").limit(50)


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) SELECT item_id, round(1.2 * least(len(list_intersect(w, ['the', 'and', 'of', 'der', 'que', 'la'])), 12) + CASE WHEN item_id % 2 = 0 THEN 4 ELSE 0 END, 4)::DOUBLE AS score FROM b""")
def overlap_score(t: Tables):
    """Lexical evidence by shared terms and profile."""
    terms = F.array(*[F.lit(w) for w in ("the", "and", "of", "der", "que", "la")])
    shared = F.size(F.array_intersect(tokens(F.col("text")), terms))
    return t.benchmark.select("item_id", F.round(F.least(shared, F.lit(12)) * 1.2 + F.when(F.col("item_id") % 2 == 0, 4).otherwise(0), 4).alias("score"))


@query("""SELECT lang, doc_id, lane FROM (SELECT lang, doc_id, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS lane, row_number() OVER (PARTITION BY lang, n_chars > 2000 ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 2""")
def lane_quota(t: Tables):
    """Two of each lane."""
    lane = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    rows = t.documents.select("lang", "doc_id", "n_chars", lane.alias("lane"))
    return top_per_group(rows, ["lang", "lane"], [F.col("n_chars").desc(), F.col("doc_id")], 2).select("lang", "doc_id", "lane")


@query("""SELECT p_partkey, round(CASE WHEN p_type LIKE '%STEEL%' THEN 1.0 ELSE 0 END + 0.22 * p_size / 50.0 - CASE WHEN p_size < 5 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score FROM part""")
def composite_score(t: Tables):
    """Exact hit, boost and penalty."""
    exact = F.when(F.col("p_type").contains("STEEL"), 1.0).otherwise(0.0)
    return t.part.select("p_partkey", F.round(exact + F.lit(0.22) * F.col("p_size") / 50.0 - F.when(F.col("p_size") < 5, 0.3).otherwise(0.0), 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, 0.6 AS score FROM documents WHERE text ILIKE '%whst%' UNION ALL SELECT doc_id, 0.55 FROM documents WHERE text ILIKE '%nicht%' UNION ALL SELECT doc_id, n_chars / 100000.0 FROM documents WHERE n_chars > 9000) SELECT doc_id, max(score)::DOUBLE AS score FROM c GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def memory_search(t: Tables):
    """Candidates of several ways, the best score of each, the first twenty; one scan for all ways."""
    x = F.col("text")
    ways = F.array_compact(F.array(F.when(x.ilike("%whst%"), F.lit(0.6)), F.when(x.ilike("%nicht%"), F.lit(0.55)), F.when(F.col("n_chars") > 9000, F.col("n_chars") / 100000.0)))
    return t.documents.select("doc_id", F.array_max(ways).alias("score")).filter("score IS NOT NULL").orderBy(F.col("score").desc(), "doc_id").limit(20)


@query(f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (1, 2, 3)), s AS (SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 4) AS score FROM q JOIN embeddings v ON q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) SELECT vec_id, round(sum(1.0 / (60 + rn)), 8)::DOUBLE AS score FROM r WHERE rn <= 8 GROUP BY 1""")
def multi_query_knn(t: Tables):
    """Sub-queries of one question, each with its share of the budget, fused."""
    q = t.embeddings.filter(F.col("vec_id").isin(1, 2, 3)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(q, vectors(t), 8).groupBy("vec_id").agg(F.round(F.sum(1.0 / (60 + F.col("rn"))), 8).alias("score"))


@query("""SELECT a.conv_id, a.turn, b.turn AS neighbor, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn WHERE a.role = 'user'""")
def neighbor_join(t: Tables):
    """The turns beside a hit, by an equi-join on the place."""
    hits = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    rows = hits.join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.select("conv_id", F.col("at").alias("turn"), F.col("turn").alias("neighbor"), "role")


#: The question of legal_hybrid: three vectors, and words that stand for articles, topics and sources.
ASKED = [tuple(round(math.sin((i + 1) * (j + 1)), 6) for i in range(64)) for j in range(3)]
WORDS = ("nicht", "pour", "that")
PREFERRED, KNOWN, PENALTY = ("src1", "src4"), ("src7",), 0.12
LEGAL = Weights(vector=0.55, keyword=0.45, rrf=0.35)


def legal_specs() -> list[Spec]:
    specs = [Spec("vector", 8, vector=v) for v in ASKED]
    specs += [Spec("exact", 6, f"article:{s}{w}", source_has=(s,), text_has=(w,), score=1.0) for s, w in (("src4", "nicht"), ("src12", "that"))]
    specs += [Spec("source", 3, f"source_vector:{s}", vector=ASKED[0], source_has=(s,), boost=0.24) for s in PREFERRED]
    specs += [Spec("source", 3, f"source_focus:{s}:{w}", source_has=(s,), text_has=(w,), score=0.92, boost=0.22) for s in PREFERRED for w in WORDS[:2]]
    specs += [Spec("keyword", 5, f"keyword:{w}", text_has=(w,), score=0.7) for w in WORDS]
    return [*specs, Spec("keyword", 5, "keyword:src9", source_has=("src9",), score=0.5)]


def lexical_share(query: str, texts: list[str]) -> list[float]:
    """Stands in for a re-ranking model: the share of the question's words that a text holds."""
    words = query.split()
    return [sum(w in (t or "") for w in words) / len(words) for t in texts]


def _legal_sql() -> str:
    hits = []
    for n, s in enumerate(legal_specs()):
        where = " AND ".join([f"source LIKE '%{x}%'" for x in s.source_has] + [f"text LIKE '%{x}%'" for x in s.text_has] + (["v IS NOT NULL"] if s.vector else [])) or "true"
        near = f"round(list_dot_product(v, {list(s.vector)}::DOUBLE[]), 6)" if s.vector else "NULL::DOUBLE"
        reason = f"'{s.reason}'" if s.reason else "NULL"
        hits.append(f"(SELECT path, chunk_index, source, {n} AS spec, '{s.group}' AS grp, {near} AS vector_score, {'NULL' if s.vector else s.score}::DOUBLE AS keyword_score, {s.boost}::DOUBLE AS boost, {reason} AS reason, row_number() OVER (ORDER BY {near} DESC NULLS LAST, path, chunk_index) AS place FROM chunks WHERE {where} QUALIFY place <= {s.limit})")
    named = lambda terms: " OR ".join(f"source LIKE '%{t}%'" for t in terms)
    return f"""WITH chunks AS (SELECT 'p' || (doc_id // 8) AS path, doc_id % 8 + 1 AS chunk_index, source, text, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
found AS ({" UNION ALL ".join(hits)}),
keys AS (SELECT DISTINCT path, chunk_index + d AS chunk_index, chunk_index AS at_index, first_value(source) OVER (PARTITION BY path, chunk_index) AS of_source, max(greatest(keyword_score - 0.08, 0.55)) OVER (PARTITION BY path, chunk_index) AS ks FROM found, (VALUES (-1), (1)) o(d) WHERE grp = 'exact' AND chunk_index + d > 0),
near AS (SELECT c.path, c.chunk_index, c.source, 1048576 AS spec, 'neighbor' AS grp, NULL::DOUBLE AS vector_score, ks AS keyword_score, 0.0::DOUBLE AS boost, 'neighbor:' || of_source || '#' || at_index AS reason, row_number() OVER (ORDER BY c.path, at_index, c.chunk_index) AS place FROM chunks c JOIN keys k ON c.path = k.path AND c.chunk_index = k.chunk_index),
listed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY spec, place) AS at_place FROM (SELECT * FROM found UNION ALL SELECT * FROM near) QUALIFY grp <> 'keyword' OR at_place <= 12),
whence AS (SELECT path, chunk_index, string_agg(grp || ':' || p, ',' ORDER BY grp) AS groups FROM (SELECT path, chunk_index, grp, min(at_place) AS p FROM listed GROUP BY 1, 2, 3) GROUP BY 1, 2),
merged AS (SELECT path, chunk_index, source, max(vector_score) AS vector_score, max(keyword_score) AS keyword_score, max(boost) AS boost, round(sum(1.0::DOUBLE / (40 + at_place)), 9) AS rrf, arg_min(reason, spec * 1000 + place) FILTER (WHERE reason IS NOT NULL) AS reason FROM listed GROUP BY 1, 2, 3),
boosted AS (SELECT *, greatest(boost, CASE WHEN {named(PREFERRED)} THEN 0.25 ELSE 0 END, CASE WHEN {named(KNOWN)} THEN 0.1 ELSE 0 END, CASE WHEN reason LIKE 'article:%' THEN 0.25 ELSE 0 END)::DOUBLE AS b, CASE WHEN reason LIKE 'article:%' THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN {named(PREFERRED)} THEN 0 ELSE {PENALTY} END::DOUBLE AS penalty FROM merged),
scored AS (SELECT *, round(exact + 1.4::DOUBLE * b + {LEGAL.vector}::DOUBLE * coalesce(vector_score, 0) + {LEGAL.keyword}::DOUBLE * coalesce(keyword_score, 0) + {LEGAL.rrf}::DOUBLE * least(rrf * 10, 1) - penalty, 8) AS score FROM boosted),
diverse AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, path, chunk_index) <= 2),
pool AS (SELECT * FROM diverse ORDER BY score DESC, path, chunk_index LIMIT 20),
judged AS (SELECT p.*, groups, ({" + ".join(f"(c.text LIKE '%{w}%')::INT" for w in WORDS)}) / {len(WORDS)}::DOUBLE AS rerank FROM pool p JOIN whence USING (path, chunk_index) JOIN chunks c USING (path, chunk_index))
SELECT row_number() OVER (ORDER BY round(rerank + exact + 0.9::DOUBLE * b - penalty, 8) DESC, score DESC, path, chunk_index) AS rank, path, chunk_index, source, round(rerank + exact + 0.9::DOUBLE * b - penalty, 6) AS final, round(score, 6) AS score, reason, groups FROM judged QUALIFY rank <= 10"""


@query(_legal_sql())
def legal_hybrid(t: Tables):
    """Five groups of candidates in one scan, neighbours of exact hits, fusion, boosts and penalties, two chunks a
    source, a re-rank and the final order; each result names the groups it came from."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    path, index = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 8).cast("string")), F.col("doc_id") % 8 + 1
    chunks = t.documents.select("doc_id", "source", "text").join(vectors, "doc_id", "left").select(path.alias("path"), index.alias("chunk_index"), "source", "text", "v")
    found = hybrid_search(chunks, legal_specs(), LEGAL, group_limits={"keyword": 12}, preferred=PREFERRED, known=KNOWN, penalty=PENALTY, pool=20, top=10, query=" ".join(WORDS), client=lexical_share)
    return found.select("rank", "path", "chunk_index", "source", F.round("final", 6).alias("final"), F.round("score", 6).alias("score"), "reason", "groups")
