"""Validation, gates and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount, ratio
from ledgerlake.functions.text import tokens
from ledgerlake.operators import markets
from ledgerlake.operators.core import bridge, latest
from ledgerlake.operators.rules import BRIDGES, alerts, checked, first_formula

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


def line_price():
    return amount(F.col("l_extendedprice"))


def bridge_rows(t: Tables):
    """The latest order of each customer and the sum of its lines, beside its stated total."""
    last = latest(t.orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")
    dims = last.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(line_price()).alias("lines"))
    rows = dims.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("n_name", "o_orderkey", bridge(amount(F.col("o_totalprice")), F.col("lines")).alias("status"))


BRIDGE = """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1), s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS lines FROM lineitem GROUP BY 1), b AS (SELECT n_name, o_orderkey, CAST(o_totalprice AS DECIMAL(18,4)) AS total, lines FROM l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON o_orderkey = l_orderkey),
c AS (SELECT n_name, o_orderkey, CASE WHEN lines IS NULL THEN 'warning' WHEN abs(total - lines) <= greatest(greatest(abs(total), abs(lines)) * 0.005, 2) THEN 'pass' ELSE 'fail' END AS status FROM b)"""


@query(f"{BRIDGE} SELECT n_name, status, count(*) AS n FROM c GROUP BY 1, 2")
def bridge_status_by_nation(t: Tables):
    """The flagship: latest version, its dimensions, the accounting bridge, counts by country."""
    return bridge_rows(t).groupBy("n_name", "status").agg(row_count().alias("n"))


@query(f"{BRIDGE} SELECT o_orderkey, status FROM c")
def order_bridge(t: Tables):
    """Status of each."""
    return bridge_rows(t).select("o_orderkey", "status")


def statements(t: Tables):
    """A stand-in for filings: each order's lines as the items of a balance."""
    item = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, line_price()))
    g = t.lineitem.groupBy("l_orderkey").agg(item("A").alias("total_liabilities"), item("R").alias("total_equity"), item("N").alias("temporary_equity"), F.sum(line_price()).alias("sum"))
    k = F.col("l_orderkey")
    return g.select("l_orderkey", "total_liabilities", "total_equity", "temporary_equity", F.when(k % 3 == 0, F.col("sum") * 2).otherwise(F.col("sum")).alias("total_assets"), F.when(k % 5 == 0, F.col("sum")).otherwise(F.col("sum") * 2).alias("liabilities_and_equity"))


@query("""WITH g AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS r, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1),
w AS (SELECT k, a, r, n, CASE WHEN k % 3 = 0 THEN s * 2 ELSE s END AS t, CASE WHEN k % 5 = 0 THEN s ELSE s * 2 END AS le FROM g), v AS (SELECT k, CASE WHEN a IS NULL OR r IS NULL THEN 'warning' WHEN abs(t - (a + coalesce(n, 0) + r)) <= greatest(greatest(abs(t), abs(a + coalesce(n, 0) + r)) * 0.005, 2) THEN 'pass' ELSE 'fail' END AS v1, CASE WHEN abs(t - le) <= greatest(greatest(abs(t), abs(le)) * 0.005, 2) THEN 'pass' ELSE 'fail' END AS v2 FROM w)
SELECT k AS l_orderkey, 'balance' AS rule_id, CASE WHEN v1 = 'fail' AND v2 = 'pass' THEN 'warning' ELSE v1 END AS status FROM v UNION ALL SELECT k, 'balance_total', v2 FROM v""")
def bridge_check(t: Tables):
    """Both balances, and the downgrade."""
    return checked(statements(t), ["l_orderkey"]).filter(F.col("rule_id").isin("balance", "balance_total"))


@query("""WITH g AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS revenue, sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4))) AS cost, sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS gross FROM lineitem GROUP BY 1) SELECT k AS l_orderkey, CASE WHEN abs(gross - (revenue - cost)) <= greatest(greatest(abs(gross), abs(revenue - cost)) * 0.005, 2) THEN 'pass' ELSE 'fail' END AS status FROM g""")
def bridge_signed(t: Tables):
    """Signed parts; here gross profit. Rules whose items are missing are skipped."""
    d = amount(F.col("l_discount"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.sum(line_price()).alias("revenue"), F.sum(line_price() * d).alias("cost_of_sales"), F.sum(line_price() * (1 - d)).alias("gross_profit"))
    return checked(g, ["l_orderkey"]).filter("rule_id = 'gross_profit'").select("l_orderkey", "status")


@query("""WITH g AS (SELECT l_orderkey, l_returnflag AS source, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, source, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(s - CAST(o_totalprice AS DECIMAL(18,4))), source) AS rn FROM g JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, source FROM b WHERE rn = 1""")
def best_source_group(t: Tables):
    """The source whose own figures fit best."""
    g = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("source")).agg(F.sum(line_price()).alias("s"))
    rows = g.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.abs(F.col("s") - amount(F.col("o_totalprice")))
    return rows.groupBy("l_orderkey").agg(F.min_by("source", F.struct(gap, "source")).alias("source"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END, CASE WHEN l_discount > 0 THEN l_extendedprice / 1000 END, l_tax) AS derived, CASE WHEN l_linenumber % 3 <> 0 THEN 0.9 ELSE greatest(0.6, 0.64 - 0.04) END::DOUBLE AS confidence FROM lineitem""")
def derive_missing(t: Tables):
    """The first formula that has its inputs, at a lower confidence."""
    stated = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    derived = first_formula(stated, F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / 1000), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", derived.alias("derived"), F.when(stated.isNotNull(), 0.9).otherwise(F.greatest(F.lit(0.6), F.lit(0.6))).alias("confidence"))


@query("""WITH r(event_type) AS (VALUES ('click'), ('view'), ('purchase'), ('refund')), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, r.event_type AS missing FROM u CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = r.event_type)""")
def required_missing(t: Tables):
    """Required items that a company lacks; the profile is a literal array."""
    required = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "refund")])
    have = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", F.explode(F.array_except(required, "have")).alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 0 THEN 'negative' WHEN l_discount > 0.1 THEN 'ratio' WHEN l_tax > l_discount THEN 'order' ELSE 'ok' END AS sanity FROM lineitem""")
def metric_sanity(t: Tables):
    """V19."""
    sanity = F.when(F.col("l_quantity") < 0, "negative").when(F.col("l_discount") > 0.1, "ratio").when(F.col("l_tax") > F.col("l_discount"), "order").otherwise("ok")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sanity.alias("sanity"))


@query("""WITH d AS (SELECT o_custkey, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS s FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey, coalesce(max(s) FILTER (WHERE o_orderstatus = 'O'), 0) AS gross, coalesce(max(s) FILTER (WHERE o_orderstatus = 'F'), 0) AS impaired FROM d GROUP BY 1) SELECT o_custkey, CAST(gross - abs(impaired) AS DOUBLE) AS net, gross >= abs(impaired) AS ok FROM p""")
def reconciliation(t: Tables):
    """Gross less impairment."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, amount(F.col("o_totalprice")))), F.lit(0))
    p = t.orders.groupBy("o_custkey").agg(part("O").alias("gross"), part("F").alias("impaired"))
    return p.select("o_custkey", (F.col("gross") - F.abs("impaired")).cast("double").alias("net"), (F.col("gross") >= F.abs("impaired")).alias("ok"))


@query("""WITH r AS (SELECT event_id, 'R1' AS rule_id FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'R2' FROM events WHERE value > 60 UNION ALL SELECT event_id, 'R3' FROM events WHERE event_type = 'purchase' AND value < 5) SELECT event_id, rule_id FROM r""")
def alert_rules(t: Tables):
    """Every rule on one pass."""
    e, v = F.col("event_type"), F.col("value")
    return alerts(t.events, ["event_id"], {"R1": e == "error", "R2": v > 60, "R3": (e == "purchase") & (v < 5)})


@query("""SELECT lang, count(*) AS n, CAST(round(CAST(count(*) FILTER (WHERE n_chars > 500) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS long_share, CAST(round(CAST(count(*) FILTER (WHERE contains(text, '!!')) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS loud_share FROM documents GROUP BY 1""")
def doc_quality(t: Tables):
    """V29."""
    share = lambda test: ratio(F.count_if(test), row_count()).cast("double")
    return t.documents.groupBy("lang").agg(row_count().alias("n"), share(F.col("n_chars") > 500).alias("long_share"), share(F.col("text").contains("!!")).alias("loud_share"))


@query("""WITH a AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) SELECT item_id, count(*) AS n, count(d.w) AS found, CAST(round(CAST(count(d.w) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS recall FROM a LEFT JOIN d ON a.w = d.w GROUP BY 1""")
def text_recall(t: Tables):
    """Share of the golden words that the parsed texts have."""
    gold = t.benchmark.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    seen = t.documents.select(F.explode(tokens(F.col("text"))).alias("w")).distinct().withColumn("found", F.lit(1))
    return gold.join(seen, "w", "left").groupBy("item_id").agg(row_count().alias("n"), F.count("found").alias("found"), ratio(F.count("found"), row_count()).cast("double").alias("recall"))


@query("""SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS whole, count(*) AS fragments FROM conversations GROUP BY 1""")
def logical_tables(t: Tables):
    """Fragments assembled in order."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text")).alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "|").alias("whole"), row_count().alias("fragments"))


@query("""SELECT user_id, event_type, count(*) AS n, CASE WHEN count(*) > 1 + (SELECT count(*) FROM events) / 750.0 THEN 'high' ELSE 'usual' END AS level FROM events GROUP BY 1, 2""")
def scope_separated(t: Tables):
    """Groups by scope against the mean of all."""
    total = t.events.agg(row_count().alias("all"))
    g = t.events.groupBy("user_id", "event_type").agg(row_count().alias("n")).withColumn("all", total.scalar())
    return g.select("user_id", "event_type", "n", F.when(F.col("n") > 1 + F.col("all") / 750.0, "high").otherwise("usual").alias("level"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'pdf_table' WHEN o_orderkey % 6 IN (1, 2) THEN 'html_xbrl' WHEN o_orderkey % 6 = 3 THEN 'xbrl_fact' WHEN o_orderkey % 6 = 4 THEN 'artifact' ELSE 'missing_locator' END AS kind FROM orders""")
def resolvability(t: Tables):
    """The first way that leads to the evidence."""
    k = F.col("o_orderkey") % 6
    kind = F.when(k == 0, "pdf_table").when(k.isin(1, 2), "html_xbrl").when(k == 3, "xbrl_fact").when(k == 4, "artifact").otherwise("missing_locator")
    return t.orders.select("o_orderkey", kind.alias("kind"))


@query("""SELECT o_orderkey, flag FROM (SELECT o_orderkey, o_orderstatus <> lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS flag FROM orders) WHERE flag""")
def state_changes(t: Tables):
    """Versions whose state differs from the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    flag = F.col("o_orderstatus") != F.lag("o_orderstatus").over(w)
    return t.orders.select("o_orderkey", flag.alias("flag")).filter("flag")


@query("""WITH g AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS r, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1),
w AS (SELECT k, a, r, n, CASE k % 4 WHEN 0 THEN s WHEN 1 THEN s * 1.004 WHEN 2 THEN s * 1.008 ELSE s * 1.2 END AS t FROM g),
p AS (SELECT k, 'liabilities_split' AS rule_id, t, a + r AS x, 0.005 AS share, 2 AS least FROM w UNION ALL SELECT k, 'assets_split', t, a + n, 0.005, 2 FROM w UNION ALL SELECT k, 'equity_split', t, r + n, 0.005, 2 FROM w UNION ALL SELECT k, 'net_profit', t, a - r, 0.005, 2 FROM w UNION ALL SELECT k, 'profit_split', t, a + n, 0.005, 2 FROM w UNION ALL SELECT k, 'cash_change', t, a + r + n, 0.005, 2 FROM w UNION ALL SELECT k, 'cash_end', t, a + r + coalesce(n, 0), 0.005, 2 FROM w UNION ALL SELECT k, 'cash_match', t, a, 0.01, 5 FROM w)
SELECT k AS l_orderkey, rule_id, CASE WHEN x IS NULL THEN 'skipped' WHEN abs(t - x) <= greatest(greatest(abs(t), abs(x)) * share, least) THEN 'pass' ELSE 'fail' END AS status FROM p""")
def accounting_rules(t: Tables):
    """The optional identities, on each order's lines by flag as stand-ins for a filing's items."""
    item = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, line_price()))
    k = F.col("l_orderkey")
    g = t.lineitem.groupBy("l_orderkey").agg(item("A").alias("a"), item("R").alias("r"), item("N").alias("n"), F.sum(line_price()).alias("s"))
    total = F.when(k % 4 == 0, F.col("s")).when(k % 4 == 1, F.col("s") * F.lit(1.004).cast("decimal(4,3)")).when(k % 4 == 2, F.col("s") * F.lit(1.008).cast("decimal(4,3)")).otherwise(F.col("s") * F.lit(1.2).cast("decimal(2,1)"))
    g = g.withColumn("t", total)
    places = {
        "assets_split": {"total_assets": "t", "current_assets": "a", "noncurrent_assets": "n"},
        "liabilities_split": {"total_liabilities": "t", "current_liabilities": "a", "noncurrent_liabilities": "r"},
        "equity_split": {"total_equity": "t", "parent_equity": "r", "minority_equity": "n"},
        "net_profit": {"net_profit": "t", "profit_before_tax": "a", "income_tax": "r"},
        "profit_split": {"net_profit": "t", "parent_profit": "a", "minority_profit": "n"},
        "cash_change": {"cash_change": "t", "cfo": "a", "cfi": "r", "cff": "n"},
        "cash_end": {"cash_end": "t", "cash_begin": "a", "cash_change": "r", "fx": "n"},
        "cash_match": {"cash_balance": "t", "cash_end": "a"},
    }
    rules = {r.rule_id: r for r in BRIDGES}
    judged = [F.struct(F.lit(name).alias("rule_id"), rules[name].status_of({item: F.col(c) for item, c in items.items()}).alias("status")) for name, items in places.items()]
    return g.select("l_orderkey", F.explode(F.array(*judged)).alias("c")).select("l_orderkey", "c.rule_id", "c.status")


@query("""WITH c AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'HK' WHEN 1 THEN 'JP' WHEN 2 THEN 'KR' WHEN 3 THEN 'EU' ELSE 'US' END AS market FROM customer),
f AS (SELECT o_orderkey, c_custkey, market, CASE market WHEN 'HK' THEN 'HK:' || CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END WHEN 'US' THEN 'US:CIK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') WHEN 'EU' THEN 'EU:EU:' || c_custkey || ':' || c_custkey ELSE market || ':' || c_custkey END AS company_id,
 coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' END, CASE market WHEN 'JP' THEN 'JPY' WHEN 'KR' THEN 'KRW' WHEN 'US' THEN 'USD' END) AS fact_currency FROM orders JOIN c ON o_custkey = c_custkey)
SELECT o_orderkey, company_id, fact_currency, market = 'EU' AND coalesce(min(fact_currency) OVER (PARTITION BY c_custkey) <> max(fact_currency) OVER (PARTITION BY c_custkey), false) AS multi_currency FROM f""")
def market_annotations(t: Tables):
    """Identity and currency by market, filings of several currencies."""
    place = F.col("c_nationkey") % 5
    market = F.when(place == 0, "HK").when(place == 1, "JP").when(place == 2, "KR").when(place == 3, "EU").otherwise("US")
    c = t.customer.select("c_custkey", market.alias("market"))
    unit = F.when(F.col("o_orderkey") % 3 == 0, "GBP million").when(F.col("o_orderkey") % 3 == 1, "in €").otherwise("units")
    rows = t.orders.select("o_orderkey", "o_custkey", unit.alias("unit")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    none, m = F.lit(None).cast("string"), F.col("market")
    rows = rows.withColumn("company_id", markets.company_id(m, none, F.col("c_custkey").cast("string")))
    rows = rows.withColumn("fact_currency", markets.fact_currency(none, F.col("unit"), markets.reporting_currency(m, none)))
    return markets.multi_currency(rows, ["c_custkey"]).select("o_orderkey", "company_id", "fact_currency", "multi_currency")
