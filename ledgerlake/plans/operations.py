"""Audits, indexes and format-specific operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount
from ledgerlake.operators.core import latest, top_per_group

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


@query("""SELECT p_brand, r_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def two_lookup_join(t: Tables):
    """Facts with their contexts and units. Facts are counted per pair of references before they
    meet the look-up tables, so those need not be broadcast whatever their size."""
    facts = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(row_count().alias("c"))
    places = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    rows = facts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("p_brand", "r_name").agg(F.sum("c").alias("n"))


@query("""SELECT split_part(p_brand, '#', 1) AS prefix, count(*) AS n, count(DISTINCT p_brand) AS names FROM part GROUP BY 1""")
def prefix_counts(t: Tables):
    """Counts by taxonomy prefix."""
    return t.part.groupBy(F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("prefix")).agg(row_count().alias("n"), F.countDistinct("p_brand").alias("names"))


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM a LEFT JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def mirror_check(t: Tables):
    """Each mapped pair by its hash; hashes, not texts, go through the join."""
    k = F.col("doc_id")
    a = t.documents.filter(k % 7 != 0).select(k, F.md5("text").alias("h"))
    b = t.documents.filter(k % 11 != 0).select(k, F.md5(F.when(k % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("g"))
    status = F.when(F.col("g").isNull(), "missing").when(F.col("h") == F.col("g"), "ok").otherwise("mismatch")
    return a.join(b, "doc_id", "left").groupBy(status.alias("status")).agg(row_count().alias("n"))


@query("""SELECT p_brand, count(*) AS candidates, count(l.k) AS recognised FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) l ON p_partkey = l.k GROUP BY 1""")
def recognition_audit(t: Tables):
    """Candidates against recognised facts."""
    seen = t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("k")).distinct()
    return t.part.join(seen, F.col("p_partkey") == F.col("k"), "left").groupBy("p_brand").agg(row_count().alias("candidates"), F.count("k").alias("recognised"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_new' WHEN b.k IS NULL THEN 'only_old' WHEN a.n = b.n THEN 'same' WHEN a.n > 1 AND b.n > 1 THEN 'duplicates' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def identity_reconcile(t: Tables):
    """Two key sets by a ladder of states."""
    side = lambda s, n: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(row_count().alias(n))
    a, b = F.col("a"), F.col("b")
    status = F.when(a.isNull(), "only_new").when(b.isNull(), "only_old").when(a == b, "same").when((a > 1) & (b > 1), "duplicates").otherwise("differs")
    return side("F", "a").join(side("O", "b"), "k", "full").select("k", status.alias("status"))


@query("""SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def scope_leak(t: Tables):
    """Rows that point out of their scope."""
    allowed = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    out = t.lineitem.select("l_orderkey", "l_suppkey").join(allowed, "l_suppkey", "left_anti").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(out, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'blocked' WHEN x.k IS NOT NULL THEN 'safe' ELSE 'review' END AS plan FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) x ON o_orderkey = x.k""")
def retire_plan(t: Tables):
    """M15."""
    have = t.lineitem.select(F.col("l_orderkey").alias("k")).distinct()
    return t.orders.join(have, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "blocked").when(F.col("k").isNotNull(), "safe").otherwise("review").alias("plan"))


SCORE = "greatest(CASE WHEN p_type LIKE '%STEEL%' THEN 5 ELSE 0 END + CASE WHEN p_type LIKE 'PROMO%' THEN 3 ELSE 0 END, CASE WHEN p_size > 45 THEN 1 ELSE 0 END)"


@query(f"""SELECT p_brand, p_partkey, score, rn = 1 AS is_primary FROM (SELECT p_brand, p_partkey, {SCORE} AS score, row_number() OVER (PARTITION BY p_brand ORDER BY {SCORE} DESC, p_partkey) AS rn FROM part WHERE {SCORE} > 0) WHERE rn <= 5""")
def candidate_scoring(t: Tables):
    """The five best candidates of each name."""
    kind = F.col("p_type")
    score = F.greatest(F.when(kind.contains("STEEL"), 5).otherwise(0) + F.when(kind.startswith("PROMO"), 3).otherwise(0), F.when(F.col("p_size") > 45, 1).otherwise(0))
    rows = t.part.select("p_brand", "p_partkey", score.alias("score")).filter("score > 0")
    return top_per_group(rows, ["p_brand"], [F.col("score").desc(), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "score", (F.col("rn") == 1).alias("is_primary"))


@query("""WITH u AS (SELECT p_partkey, min(CASE WHEN p_type LIKE '%STEEL%' AND p_size > 40 THEN 1 WHEN p_type LIKE '%BRASS%' AND p_size > 40 THEN 2 WHEN p_size = 50 THEN 3 END) AS tier FROM part GROUP BY 1) SELECT p_partkey, tier FROM u WHERE tier IS NOT NULL ORDER BY tier, p_partkey LIMIT 30""")
def tiered_union_limit(t: Tables):
    """A review list by tier, each once, thirty long."""
    kind, size = F.col("p_type"), F.col("p_size")
    tier = F.when(kind.contains("STEEL") & (size > 40), 1).when(kind.contains("BRASS") & (size > 40), 2).when(size == 50, 3)
    return t.part.select("p_partkey", tier.alias("tier")).filter("tier IS NOT NULL").orderBy("tier", "p_partkey").limit(30)


@query("""SELECT h, first_doc FROM (SELECT h, first_doc, row_number() OVER (ORDER BY first_doc) AS rn FROM (SELECT md5(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY 1)) WHERE rn <= 100""")
def first_seen_dedupe(t: Tables):
    """The first hundred distinct entries in order."""
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_doc")).orderBy("first_doc").limit(100)


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 ORDER BY o_orderdate DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_orderkey LIMIT 50""")
def rank_filter(t: Tables):
    """Candidates of one year by date and type."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    year = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    return t.orders.filter(year).orderBy(F.col("o_orderdate").desc(), p.desc(), "o_orderkey").limit(50).select("o_orderkey")


@query("""SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS low, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS high FROM supplier GROUP BY 1""")
def argmin_argmax(t: Tables):
    """Both sides of a debate."""
    order = F.struct("s_acctbal", "s_suppkey")
    return t.supplier.groupBy("s_nationkey").agg(F.min_by("s_suppkey", order).alias("low"), F.max_by("s_suppkey", order).alias("high"))


@query("""SELECT lang, CAST(round(CAST(count(*) FILTER (WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS coverage FROM documents GROUP BY 1""")
def keyword_coverage(t: Tables):
    """Share of documents with a keyword."""
    low = F.lower("text")
    hit = low.contains("license") | low.contains("copyright")
    share = F.round(F.try_divide(F.count_if(hit).cast("decimal(38,12)"), row_count().cast("decimal(38,12)")), 4)
    return t.documents.groupBy("lang").agg(share.cast("double").alias("coverage"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (7, 77, 777)")
def point_lookup(t: Tables):
    """Rows by id; the filter reaches the scan."""
    return t.orders.filter(F.col("o_orderkey").isin(7, 77, 777)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS distinct_links FROM pages""")
def extract_refs(t: Tables):
    """References in a text, and each once."""
    refs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return t.pages.select("page_id", F.size(refs).cast("long").alias("links"), F.size(F.array_distinct(refs)).cast("long").alias("distinct_links"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_scan(t: Tables):
    """The end of a log."""
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("event_id", "event_type")


@query("""SELECT c_custkey, count(o_orderkey) AS packages FROM customer JOIN orders ON c_custkey = o_custkey WHERE contains(lower(c_name), '11') OR contains(lower(c_mktsegment), 'auto') GROUP BY 1""")
def search_list(t: Tables):
    """Companies that match and have a package."""
    hits = t.customer.filter(F.lower("c_name").contains("11") | F.lower("c_mktsegment").contains("auto")).select("c_custkey")
    return hits.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("packages"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, max(value) AS longest FROM events GROUP BY 1""")
def latency_metrics(t: Tables):
    """M29, K16."""
    return t.events.groupBy("event_type").agg(row_count().alias("n"), F.sum(amount(F.col("value"))).cast("double").alias("total"), F.max("value").alias("longest"))


@query("""WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT coalesce(a.p, b.p) AS priority, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT * FROM y WHERE y = 1995) a FULL JOIN (SELECT * FROM y WHERE y = 1996) b ON a.p = b.p""")
def baseline_delta(t: Tables):
    """Before against after, from one pass."""
    y = F.year("o_orderdate")
    g = t.orders.filter(y.isin(1995, 1996)).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(y == 1995).alias("before"), F.count_if(y == 1996).alias("after"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE abs(o_totalprice - s) <= 1) AS verified FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) x ON o_orderkey = x.l_orderkey GROUP BY 1""")
def verify_by_group(t: Tables):
    """A verifier's results by market."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum(amount(F.col("l_extendedprice"))).alias("s"))
    rows = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderstatus").agg(row_count().alias("n"), F.count_if(F.abs(F.col("o_totalprice") - F.col("s")) <= 1).alias("verified"))


@query("""SELECT source, count(*) FILTER (WHERE regexp_matches(lower(text), 'test|example|fixture')) AS hits, count(*) AS n FROM documents GROUP BY 1""")
def pattern_audit(t: Tables):
    """Rows that look like fixtures."""
    return t.documents.groupBy("source").agg(F.count_if(F.lower("text").rlike("test|example|fixture")).alias("hits"), row_count().alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT (l_returnflag = 'N' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'A'))""")
def conditional_drop(t: Tables):
    """Rows that a better one of the group makes needless."""
    primary = F.bool_or(F.col("l_returnflag") == "A").over(Window.partitionBy("l_orderkey"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", primary.alias("has"))
    return rows.filter(~((F.col("l_returnflag") == "N") & F.col("has"))).drop("l_returnflag", "has")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'click')) WHERE rn = 1""")
def artefact_inventory(t: Tables):
    """The newest file of each folder and kind."""
    rows = t.events.filter(F.col("event_type").isin("view", "click"))
    return latest(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")
