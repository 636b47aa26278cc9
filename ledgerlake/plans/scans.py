"""Scans, sinks and row changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.text import html_text
from ledgerlake.operators.core import latest
from ledgerlake.sources.html import page_tables

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def scan_json_props(t: Tables):
    """Typed fields of JSON rows."""
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT page_id, coalesce(NULLIF(regexp_extract(url, '^https?://[^/]+/(en|de|fr|es)/', 1), ''), 'unknown') AS market, CASE WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN regexp_matches(url, '^https?://blog\\.') THEN 'blog' ELSE 'main' END AS part FROM pages""")
def infer_partition(t: Tables):
    """Partition of a document from its path."""
    market = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+/(en|de|fr|es)/", 1), F.lit("")), F.lit("unknown"))
    part = F.when(F.col("url").rlike(r"^https?://m\."), "mobile").when(F.col("url").rlike(r"^https?://blog\."), "blog").otherwise("main")
    return t.pages.select("page_id", market.alias("market"), part.alias("part"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t: Tables):
    """S03, F36."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""WITH l AS (SELECT CASE WHEN event_id % 9 = 0 THEN '{broken' ELSE props END AS line FROM events) SELECT count(*) FILTER (WHERE json_valid(line)) AS good, count(*) FILTER (WHERE NOT json_valid(line)) AS bad FROM l""")
def corrupt_rows(t: Tables):
    """Malformed lines are counted and skipped."""
    line = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props"))
    parsed = F.from_json(line, "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return t.events.select(parsed["_bad"].isNull().alias("ok")).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k AS measure, v AS value FROM lineitem, LATERAL (VALUES ('quantity', l_quantity), ('discount', l_discount), ('tax', l_tax)) x(k, v)""")
def unpivot_lineitem(t: Tables):
    """A wide row as rows of key and value."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    measures = F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"))
    return t.lineitem.select(*keys, F.explode(measures).alias("measure", "value"))


@query()
def html_tables(t: Tables):
    """Number of tables and cells of each page."""
    cells = page_tables(t.pages).groupBy("page_id").agg(F.countDistinct("table_index").alias("tables"), row_count().alias("cells"))
    return t.pages.select("page_id").join(cells, "page_id", "left").na.fill(0, ["tables", "cells"])


@query()
def html_to_text(t: Tables):
    """Text of pages."""
    return t.pages.select("page_id", html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, i AS block, line, CASE WHEN starts_with(line, '# ') THEN 1 WHEN starts_with(line, '## ') THEN 2 ELSE 0 END AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> ''""")
def text_blocks(t: Tables):
    """Lines in reading order with heading levels."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line")).filter(F.trim("line") != "")
    return lines.withColumn("level", F.when(F.col("line").startswith("# "), 1).when(F.col("line").startswith("## "), 2).otherwise(0))


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(b.k, a.k) AS k, coalesce(b.name, a.name) AS name, coalesce(b.bal, a.bal) AS bal FROM a FULL JOIN b ON a.k = b.k""")
def coalesce_upsert(t: Tables):
    """New values where given, else the old ones."""
    k = F.col("c_custkey")
    a = t.customer.filter(k % 7 != 0).select(k.alias("k"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal")).alias("a")
    b = t.customer.filter(k % 11 != 0).select(k.alias("k"), F.when(k % 2 != 0, F.col("c_mktsegment")).alias("name"), F.when(k % 5 != 0, F.col("c_acctbal") + 1).alias("bal")).alias("b")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("k", "name", "bal")])


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def first_seen(t: Tables):
    """The first success stays."""
    return t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_seen"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stale_rows(t: Tables):
    """K06."""
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT coalesce(m.new, c_nationkey) AS nation, count(*) AS n FROM customer LEFT JOIN (VALUES (1, 101), (2, 101), (7, 107)) m(old, new) ON c_nationkey = m.old GROUP BY 1""")
def rebind_keys(t: Tables):
    """Identities mapped to others by a small table."""
    mapped = t.spark.createDataFrame([(1, 101), (2, 101), (7, 107)], "old int, new int")
    rows = t.customer.join(F.broadcast(mapped), F.col("c_nationkey") == F.col("old"), "left")
    return rows.groupBy(F.coalesce("new", "c_nationkey").alias("nation")).agg(row_count().alias("n"))


def retention(rows, cutoff, time: str, ids: list | None = None, id_col: str = "event_id"):
    """Rows a retention run takes: by ids or by age; without a selector none."""
    test = F.lit(False)
    if ids:
        test = test | F.col(id_col).isin(ids)
    if cutoff is not None:
        test = test | (F.col(time) < F.lit(cutoff).cast("timestamp"))
    return rows.filter(test)


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts < (SELECT CAST(min(ts) AS DATE) FROM events) + INTERVAL 10 DAY OR event_id IN (9999, 9998) GROUP BY 1""")
def retention_candidates(t: Tables):
    """K08, ST12."""
    first = t.events.agg((F.date_trunc("day", F.min("ts")) + F.expr("INTERVAL 10 DAYS")).cast("timestamp").alias("at")).scalar()
    return retention(t.events, first, "ts", [9999, 9998]).groupBy("event_type").agg(row_count().alias("n"))


@query("""SELECT s_suppkey, s_acctbal >= 0 AS allowed FROM supplier""")
def quarantine_split(t: Tables):
    """Rows under a gate, to be written apart."""
    return t.supplier.select("s_suppkey", (F.col("s_acctbal") >= 0).alias("allowed"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_prefer_good(t: Tables):
    """The latest, failed ones only if nothing else is there."""
    bad = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return latest(t.orders, ["o_custkey"], [bad, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")
