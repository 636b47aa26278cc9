"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount
from ledgerlake.functions.text import blank_to_null

from .registry import Tables, query


@query("""SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' OR p_type LIKE '%TIN%' THEN 'metal' WHEN p_type ILIKE '%brass%' OR p_type ILIKE '%copper%' THEN 'alloy' ELSE 'other' END AS family FROM part""")
def case_family(t: Tables):
    """Derived label by a keyword ladder, first match wins."""
    p = F.col("p_type")
    return t.part.select("p_partkey", F.when(p.ilike("%steel%") | p.contains("TIN"), "metal").when(p.ilike("%brass%") | p.ilike("%copper%"), "alloy").otherwise("other").alias("family"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'plain' END AS label, CASE WHEN p_size < 10 THEN 'R1' WHEN p_retailprice > 1500 THEN 'R2' ELSE 'R0' END AS rule_id FROM part""")
def case_rule_id(t: Tables):
    """Each derived value with the rule that gave it."""
    ladder = [(F.col("p_size") < 10, "small", "R1"), (F.col("p_retailprice") > 1500, "dear", "R2")]
    label = rule = None
    for test, value, rule_id in ladder:
        label = F.when(test, value) if label is None else label.when(test, value)
        rule = F.when(test, rule_id) if rule is None else rule.when(test, rule_id)
    return t.part.select("p_partkey", label.otherwise("plain").alias("label"), rule.otherwise("R0").alias("rule_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'bulk' END, CASE WHEN l_discount > 0.08 THEN 'deep_discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS flags FROM lineitem""")
def quality_flags(t: Tables):
    """Array of the violated rules, without the nulls."""
    flags = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "bulk"), F.when(F.col("l_discount") > 0.08, "deep_discount"), F.when(F.col("l_tax") == 0, "untaxed")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(flags, ",").alias("flags"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'high' WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN 'medium' ELSE 'low' END AS tier FROM orders""")
def confidence_tier(t: Tables):
    """Tier from several conditions."""
    done = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(done & (F.col("o_totalprice") > 100000), "high").when(done | F.col("o_orderpriority").startswith("1"), "medium").otherwise("low").alias("tier"))


@query("""SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS item_uid, l_orderkey FROM lineitem""")
def surrogate_key(t: Tables):
    """Natural key hashed to a surrogate."""
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return t.lineitem.select(F.md5(F.concat_ws("|", *keys)).alias("item_uid"), "l_orderkey")


@query("""SELECT c_custkey, NULLIF(trim(coalesce(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END, '')), '') AS segment FROM customer""")
def blank_to_null_label(t: Tables):
    """Blank text is missing."""
    return t.customer.select("c_custkey", blank_to_null(F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))).alias("segment"))


@query("""SELECT o_orderkey FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m'), '^199[5-6]-0[1-6]$')""")
def regex_filter(t: Tables):
    """Pattern on a period key."""
    return t.orders.filter(F.date_format("o_orderdate", "yyyy-MM").rlike("^199[5-6]-0[1-6]$")).select("o_orderkey")


def optional(rows, column: str, value):
    """A predicate that is left out when its parameter is not given."""
    return rows if value is None else rows.filter(F.col(column) == value)


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE (CAST(NULL AS VARCHAR) IS NULL OR c_name = NULL) AND c_mktsegment = 'BUILDING'""")
def optional_filter(t: Tables):
    """Bind predicates of which one is absent."""
    return optional(optional(t.customer, "c_name", None), "c_mktsegment", "BUILDING").select("c_custkey", "c_mktsegment")


@query("""SELECT event_id FROM events WHERE user_id % 4 = 1 AND (event_type = 'view' OR (event_type = 'error' AND user_id = 5) OR (event_type = 'purchase' AND value > 50))""")
def acl_filter(t: Tables):
    """Tenant, and visible to the system, the user or the project."""
    tenant = F.col("user_id") % 4 == 1
    seen = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("user_id") == 5)) | ((F.col("event_type") == "purchase") & (F.col("value") > 50))
    return t.events.filter(tenant & seen).select("event_id")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def json_identity(t: Tables):
    """P10: identity inside JSON."""
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k == "7").select("event_id", k.alias("k"))


@query("""SELECT o_orderkey FROM orders WHERE (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1996-06-30') AND (o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-30')""")
def valid_as_of(t: Tables):
    """Valid at a given time, never now()."""
    at = F.lit("1996-06-30").cast("timestamp")
    start = F.col("o_orderdate")
    return t.orders.filter((start.isNull() | (start <= at)) & (start + F.expr("INTERVAL 90 DAY") > at)).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_name ILIKE '%1%' THEN 0.6 WHEN p_type ILIKE '%steel%' THEN 0.55 ELSE 0.25 END::DOUBLE AS score FROM part WHERE p_name ILIKE '%1%' OR p_type ILIKE '%steel%' OR p_brand ILIKE '%3%'""")
def ilike_tier(t: Tables):
    """Tiered score of a keyword match, and only rows that match somewhere."""
    name, kind, brand = F.col("p_name").ilike("%1%"), F.col("p_type").ilike("%steel%"), F.col("p_brand").ilike("%3%")
    return t.part.filter(name | kind | brand).select("p_partkey", F.when(name, 0.6).when(kind, 0.55).otherwise(0.25).alias("score"))


@query("""SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 100""")
def keyset_page(t: Tables):
    """P13, ST07: a page after a cursor."""
    return t.events.filter("event_id > 5000").orderBy("event_id").limit(100).select("event_id", "event_type")


@query("""SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 200""")
def offset_page(t: Tables):
    """A page by offset."""
    return t.events.select("event_id").orderBy("event_id").offset(200).limit(50)


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10""")
def dynamic_filter(t: Tables):
    """Filter on the first of several candidate columns that the table has."""
    rows = t.orders
    column = next(c for c in ("status", "state", "o_orderstatus") if c in rows.columns)
    return rows.filter(F.col(column) == "O").orderBy("o_orderkey").limit(10).select("o_orderkey", "o_orderstatus")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS DISTINCT FROM l_linestatus""")
def null_safe_neq(t: Tables):
    """IS DISTINCT FROM."""
    return t.lineitem.filter(~F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.col("l_linestatus"))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_acctbal > 9000 THEN 'extreme' END) AS issues, NOT (s_acctbal < 0 OR s_acctbal > 9000) AS accepted FROM supplier""")
def sanity_quarantine(t: Tables):
    """Accepted or quarantined with the reasons."""
    issues = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "negative"), F.when(F.col("s_acctbal") > 9000, "extreme")))
    return t.supplier.select("s_suppkey", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("accepted"))


def page_ranges(text: str) -> list[int]:
    """'1-3,7' to the pages, each once and in the order given."""
    pages: dict[int, None] = {}
    for part in text.split(","):
        lo, _, hi = part.strip().partition("-")
        pages.update(dict.fromkeys(range(int(lo), int(hi or lo) + 1)))
    return list(pages)


@query("""SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 1 AND 3 OR p_size = 7""")
def range_select(t: Tables):
    """Rows on the pages of a range text."""
    return t.part.filter(F.col("p_size").isin(page_ranges("1-3,7"))).select("p_partkey", "p_size")


@query("""SELECT event_id FROM events WHERE (map {'k': CAST(json_extract_string(props, '$.k') AS VARCHAR), 'type': event_type})['type'] = 'signup'""")
def map_member_filter(t: Tables):
    """Exact member of a map column."""
    dims = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    return t.events.filter(F.element_at(dims, "type") == "signup").select("event_id")


@query("""SELECT s_nationkey, count(*) AS n_total, count(*) FILTER (WHERE s_acctbal >= 0) AS n_ok FROM supplier WHERE s_nationkey IN (1, 2, 3) GROUP BY s_nationkey""")
def identity_where(t: Tables):
    """A WHERE built from a dict of identities; None leaves a column free."""
    rows = t.supplier
    for column, values in {"s_nationkey": [1, 2, 3], "s_name": None}.items():
        rows = rows if values is None else rows.filter(F.col(column).isin(values))
    return rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(amount(F.col("s_acctbal")) >= 0).alias("n_ok"))
