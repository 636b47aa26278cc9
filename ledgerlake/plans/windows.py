"""Windows, sorting, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount, cagr, yoy
from ledgerlake.operators.core import latest, top_per_group, upsert

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def latest_per_key(t: Tables):
    """Latest successful version."""
    good = t.orders.filter("o_orderstatus != 'P'")
    return latest(good, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_two_keys(t: Tables):
    """Latest of each company and type, three levels of ties."""
    order = [F.col("o_orderdate").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey").desc()]
    return latest(t.orders, ["o_custkey", "o_orderpriority"], order).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def count_over_limit(t: Tables):
    """A page beside the count of all, a scalar sub-query that combines on the map side, not a window over everything."""
    rows = t.orders.filter("o_orderstatus = 'P'")
    total = rows.agg(row_count().alias("total"))
    return rows.orderBy("o_orderkey").limit(20).select("o_orderkey", total.scalar().alias("total"))


def yearly(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.sum(amount(F.col("o_totalprice"))).alias("revenue"))


YEARLY = "WITH y AS (SELECT c_nationkey, year(o_orderdate) AS year, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def by_year():
    return Window.partitionBy("c_nationkey").orderBy("year")


@query(f"""{YEARLY}, l AS (SELECT *, lag(revenue) OVER (PARTITION BY c_nationkey ORDER BY year) AS prev FROM y) SELECT c_nationkey, year, CAST(revenue AS DOUBLE) AS revenue, CASE WHEN prev = 0 THEN NULL ELSE CAST(revenue - prev AS DOUBLE) / CAST(abs(prev) AS DOUBLE) END AS growth FROM l""")
def yoy_growth(t: Tables):
    """Change over the year before by its size."""
    y = yearly(t).withColumn("prev", F.lag("revenue").over(by_year()))
    return y.select("c_nationkey", "year", F.col("revenue").cast("double").alias("revenue"), yoy(F.col("revenue"), F.col("prev"), negative_base=True).alias("growth"))


@query(f"""{YEARLY}, e AS (SELECT c_nationkey, arg_min(revenue, year) AS a, arg_max(revenue, year) AS b, max(year) - min(year) AS n FROM y GROUP BY 1) SELECT c_nationkey, CASE WHEN a > 0 AND b > 0 AND n > 0 THEN round(pow(CAST(b AS DOUBLE) / CAST(a AS DOUBLE), 1.0 / n) - 1, 6) END AS cagr FROM e""")
def cagr_window(t: Tables):
    """W05, F17."""
    e = yearly(t).groupBy("c_nationkey").agg(F.min_by("revenue", "year").alias("a"), F.max_by("revenue", "year").alias("b"), (F.max("year") - F.min("year")).alias("n"))
    return e.select("c_nationkey", F.round(cagr(F.col("a"), F.col("b"), F.col("n")), 6).alias("cagr"))


@query("""SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_tax, l_quantity, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def argmin_struct(t: Tables):
    """Best fact by a score of several parts, without a sort."""
    score = F.struct(-F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"))
    best = t.lineitem.groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "l_orderkey"), score).alias("b"))
    return best.select("l_partkey", "b.l_suppkey", "b.l_orderkey")


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def argmax_tiebreak(t: Tables):
    """Highest confidence, the first on a tie."""
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


@query("""SELECT p_partkey, p_brand, rn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) ORDER BY rn, p_brand LIMIT 60""")
def round_robin(t: Tables):
    """Collections take turns."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return t.part.select("p_partkey", "p_brand", F.row_number().over(w).alias("rn")).orderBy("rn", "p_brand").limit(60)


@query("""SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def topk_per_group(t: Tables):
    """At most three of a source."""
    return top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("source", "doc_id", "rn")


@query(f"""{YEARLY}, l AS (SELECT *, revenue < lag(revenue) OVER (PARTITION BY c_nationkey ORDER BY year) AS down FROM y), m AS (SELECT *, lag(down) OVER (PARTITION BY c_nationkey ORDER BY year) AS before FROM l) SELECT c_nationkey, year FROM m WHERE down AND before""")
def consecutive_decline(t: Tables):
    """Two bad periods in a row."""
    down = yearly(t).withColumn("down", F.col("revenue") < F.lag("revenue").over(by_year()))
    return down.withColumn("before", F.lag("down").over(by_year())).filter("down AND before").select("c_nationkey", "year")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) AS dr FROM orders) WHERE dr = 1""")
def dense_rank_latest(t: Tables):
    """Every record of the latest period."""
    w = Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate").desc())
    return t.orders.withColumn("dr", F.dense_rank().over(w)).filter("dr = 1").select("o_custkey", "o_orderkey")


BANDS = [(0, 10, "low"), (10, 25, "mid"), (20, 40, "high")]


@query("""WITH b(lo, hi, name) AS (VALUES (0, 10, 'low'), (10, 25, 'mid'), (20, 40, 'high')), m AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY lo) AS rn FROM part JOIN b ON p_size >= lo AND p_size < hi) SELECT p.p_partkey, coalesce(m.name, 'high') AS band FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND rn = 1""")
def range_lookup(t: Tables):
    """Position to section: the first range that holds it, the last one beyond all."""
    band = None
    for lo, hi, name in sorted(BANDS):
        test = (F.col("p_size") >= lo) & (F.col("p_size") < hi)
        band = F.when(test, name) if band is None else band.when(test, name)
    return t.part.select("p_partkey", band.otherwise(max(BANDS)[2]).alias("band"))


@query("""WITH d AS (SELECT CAST(range AS INTEGER) AS day FROM range(0, 60)), k AS (SELECT CAST(o_orderkey % 60 AS INTEGER) AS day, max(o_custkey) AS v FROM orders WHERE o_orderkey % 60 % 7 IN (2, 5) GROUP BY 1), j AS (SELECT d.day, v FROM d LEFT JOIN k ON d.day = k.day),
f AS (SELECT day, v, last_value(v IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER w AS pd, first_value(v IGNORE NULLS) OVER x AS nv, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER x AS nd FROM j WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING), x AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT day, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * CAST(day - pd AS DOUBLE) / (nd - pd) END, 6)::DOUBLE AS v FROM f""")
def interpolate_gaps(t: Tables):
    """Straight lines between known anchors, held flat at the ends; one bounded series."""
    k = t.orders.filter((F.col("o_orderkey") % 60 % 7).isin(2, 5)).groupBy((F.col("o_orderkey") % 60).cast("int").alias("day")).agg(F.max("o_custkey").alias("v"))
    j = t.spark.range(60).select(F.col("id").cast("int").alias("day"), F.lit(1).alias("series")).join(k, "day", "left")
    w = Window.partitionBy("series").orderBy("day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.col("day"))
    f = j.select("day", "v", F.last("v", True).over(back).alias("pv"), F.last(known, True).over(back).alias("pd"), F.first("v", True).over(ahead).alias("nv"), F.first(known, True).over(ahead).alias("nd"))
    line = F.expr("pv + (nv - pv) * cast(day - pd AS double) / (nd - pd)")
    return f.select("day", F.round(F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("pv").isNull(), F.col("nv")).when(F.col("nv").isNull(), F.col("pv")).otherwise(line).cast("double"), 6).alias("v"))


@query(f"""{YEARLY}, l AS (SELECT *, lag(revenue) OVER (PARTITION BY c_nationkey ORDER BY year) AS prev, row_number() OVER (PARTITION BY c_nationkey ORDER BY year DESC) AS rn FROM y) SELECT c_nationkey, CASE WHEN prev IS NULL OR prev = 0 THEN 'unknown' WHEN CAST(revenue - prev AS DOUBLE) / CAST(abs(prev) AS DOUBLE) > 0.05 THEN 'up' WHEN CAST(revenue - prev AS DOUBLE) / CAST(abs(prev) AS DOUBLE) < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM l WHERE rn = 1""")
def trend_label(t: Tables):
    """Direction of the latest change."""
    y = yearly(t).withColumn("prev", F.lag("revenue").over(by_year())).withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("year").desc())))
    g = F.try_divide((F.col("revenue") - F.col("prev")).cast("double"), F.abs("prev").cast("double"))
    return y.filter("rn = 1").select("c_nationkey", F.when(g.isNull(), "unknown").when(g > 0.05, "up").when(g < -0.05, "down").otherwise("flat").alias("trend"))


@query("""SELECT s_suppkey, s_nationkey FROM supplier ORDER BY NULLIF(s_nationkey, 3) DESC NULLS LAST, s_acctbal, s_suppkey LIMIT 40""")
def sort_nulls_last(t: Tables):
    """T01."""
    return t.supplier.orderBy(F.nullif("s_nationkey", F.lit(3)).desc_nulls_last(), "s_acctbal", "s_suppkey").limit(40).select("s_suppkey", "s_nationkey")


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1 ORDER BY n DESC, last_event DESC, user_id LIMIT 30""")
def stable_multi_sort(t: Tables):
    """The order of several stable sorts in one."""
    g = t.events.groupBy("user_id").agg(row_count().alias("n"), F.max("event_id").alias("last_event"))
    return g.orderBy(F.col("n").desc(), F.col("last_event").desc(), "user_id").limit(30)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def next_eligible(t: Tables):
    """The next job in line."""
    due = t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp")))
    return due.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1 ORDER BY n DESC, text_hash LIMIT 10""")
def top_groups(t: Tables):
    """The largest groups of duplicates."""
    return t.documents.groupBy(F.md5("text").alias("text_hash")).agg(row_count().alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "text_hash").limit(10)


@query("""SELECT 'balance' AS kind, s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT 'account', c_custkey, c_acctbal FROM customer UNION ALL SELECT 'price', p_partkey, p_retailprice FROM part""")
def union_all_tagged(t: Tables):
    """Tables of one shape under a tag."""
    part = lambda df, tag, k, v: df.select(F.lit(tag).alias("kind"), F.col(k).alias("k"), F.col(v).alias("v"))
    return part(t.supplier, "balance", "s_suppkey", "s_acctbal").unionByName(part(t.customer, "account", "c_custkey", "c_acctbal")).unionByName(part(t.part, "price", "p_partkey", "p_retailprice"))


@query("""SELECT s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer""")
def union_padded(t: Tables):
    """Missing columns become typed nulls."""
    a = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey) FILTER (WHERE l_returnflag = 'A'), list(l_suppkey) FILTER (WHERE l_returnflag <> 'A')))), ',') AS ids FROM lineitem GROUP BY 1""")
def array_union_order(t: Tables):
    """Union of two lists, each member once."""
    a = F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))
    b = F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_suppkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.array_union(a, b)), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 5")
def except_keys(t: Tables):
    """U04."""
    return t.lineitem.select(F.col("l_partkey").alias("k")).subtract(t.part.filter("p_size > 5").select("p_partkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_keys(t: Tables):
    """U05."""
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").intersect(side("O"))


@query("""SELECT k, max(score) AS score, arg_max(origin, (score, origin)) AS origin FROM (SELECT l_partkey AS k, l_discount AS score, 'a' AS origin FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_tax, 'b' FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def union_dedupe_max(t: Tables):
    """Candidates of two sources, the best score of each key."""
    side = lambda flag, score, tag: t.lineitem.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"), F.col(score).alias("score"), F.lit(tag).alias("origin"))
    both = side("A", "l_discount", "a").unionByName(side("R", "l_tax", "b"))
    return both.groupBy("k").agg(F.max("score").alias("score"), F.max_by("origin", F.struct("score", "origin")).alias("origin"))


@query("""SELECT k, v, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, change DESC) AS rn FROM (SELECT o_orderkey AS k, o_custkey AS v, o_totalprice AS price, 0 AS change FROM orders UNION ALL SELECT o_orderkey, o_custkey + (o_orderkey % 3) - 1, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 4 = 0)) WHERE rn = 1""")
def upsert_merge(t: Tables):
    """Upsert by key, the newest version wins."""
    k = F.col("o_orderkey")
    base = t.orders.select(k.alias("k"), F.col("o_custkey").alias("v"), F.col("o_totalprice").alias("price"))
    changes = t.orders.filter(k % 4 == 0).select(k.alias("k"), (F.col("o_custkey") + k % 3 - 1).alias("v"), (F.col("o_totalprice") + 1).alias("price"))
    return upsert(base, changes, ["k"], "v")
