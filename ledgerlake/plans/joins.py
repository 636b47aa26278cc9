"""Joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount
from ledgerlake.operators.core import interval_overlap, latest, top_per_group
from ledgerlake.sources.shared import partitions_for

from .registry import Tables, query


def line_price():
    return amount(F.col("l_extendedprice"))


@query("""SELECT n_name, o_orderstatus, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus""")
def fact_dim_chain(t: Tables):
    """Facts to their filing, company and country."""
    dims = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.lineitem.join(dims, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(line_price()).cast("double").alias("revenue"))


@query("""SELECT c_custkey, coalesce(o_orderpriority, 'none') AS priority, coalesce(o_totalprice, 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'""")
def left_enrich(t: Tables):
    """Enrichment that may be missing."""
    some = t.orders.filter("o_orderstatus = 'P'")
    rows = t.customer.join(some, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"), F.coalesce("o_totalprice", F.lit(0.0)).alias("total"))


@query("""SELECT a.l_orderkey, a.l_linenumber, count(*) AS n_rows, count(b.n) AS n_found FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2""")
def multi_key_left(t: Tables):
    """Left join on several keys."""
    keys = ["l_orderkey", "l_linenumber"]
    # Both sides are dealt alike, to as many tasks as the rows need; the join and both counts need no other shuffle.
    lines = t.lineitem.repartition(partitions_for(t.lineitem), *keys)
    found = lines.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return lines.select(*keys).join(found, keys, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_found"))


@query("""SELECT o_orderkey, l_partkey AS cheapest_part, l_extendedprice AS price FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) x ON o_orderkey = l_orderkey AND rn = 1""")
def lateral_top1(t: Tables):
    """The first of a row's matches."""
    first = latest(t.lineitem, ["l_orderkey"], [F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    rows = t.orders.select("o_orderkey").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.col("l_partkey").alias("cheapest_part"), F.col("l_extendedprice").alias("price"))


@query("""SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey)) AS last_order FROM customer""")
def correlated_latest(t: Tables):
    """The latest version by a correlated scalar."""
    last = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("m.o_orderkey").alias("last_order"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def anti_join(t: Tables):
    """Rows without a match."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE '%1%'))""")
def semi_join(t: Tables):
    """Rows with a match."""
    parts = t.part.filter(F.col("p_type").contains("BRASS") | F.col("p_name").contains("1"))
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT a.conv_id, a.turn, a.role, length(a.text) AS len_a, b.n AS n_same FROM conversations a JOIN (SELECT conv_id, turn, role, count(*) AS n FROM conversations GROUP BY 1, 2, 3) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.role = b.role""")
def three_key_join(t: Tables):
    """Join on three keys."""
    keys = ["conv_id", "turn", "role"]
    n = t.conversations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    return t.conversations.join(n, keys).select(*keys, F.length("text").alias("len_a"), "n_same")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE concat_ws(',', CASE WHEN a.s <> b.s THEN 'status' END, CASE WHEN a.p <> b.p THEN 'price' END) END AS diff FROM a FULL JOIN b ON a.k = b.k""")
def parity_diff(t: Tables):
    """Two snapshots compared field by field."""
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    a = t.orders.filter(k % 11 != 0).select(k.alias("k"), s.alias("s"), p.alias("p")).alias("a")
    b = t.orders.filter(k % 13 != 0).select(k.alias("k"), F.when(k % 7 == 0, "X").otherwise(s).alias("s"), F.when(k % 5 == 0, p + 1).otherwise(p).alias("p")).alias("b")
    fields = F.array_compact(F.array(F.when(F.col("a.s") != F.col("b.s"), "status"), F.when(F.col("a.p") != F.col("b.p"), "price")))
    diff = F.when(F.col("b.k").isNull(), "missing").when(F.col("a.k").isNull(), "extra").otherwise(F.array_join(fields, ","))
    return a.join(b, F.col("a.k") == F.col("b.k"), "full").select(F.coalesce("a.k", "b.k").alias("k"), diff.alias("diff"))


@query("""SELECT l_returnflag || '/' || r_name AS label, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def broadcast_lookup(t: Tables):
    """Dictionary look-up; nation and region have fixed sizes, so they are broadcast."""
    places = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    named = t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    rows = t.lineitem.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.concat_ws("/", "l_returnflag", "r_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS hi, event_type FROM events),
p AS (SELECT a.event_id, b.event_id AS other, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.hi, b.hi) - greatest(a.lo, b.lo) DESC, b.event_id) AS rn FROM i a JOIN i b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi WHERE a.event_type = 'purchase' AND b.event_type = 'view')
SELECT event_id, other, overlap FROM p WHERE rn = 1""")
def interval_overlap_best(t: Tables):
    """The interval of largest overlap, by an equi-join on hour bins."""
    lo = F.unix_timestamp("ts")
    spans = t.events.select("event_id", "user_id", "event_type", lo.alias("lo"), (lo + 3600).alias("hi"))
    met = interval_overlap(spans.filter("event_type = 'purchase'"), spans.filter("event_type = 'view'"), "user_id", 3600)
    overlap = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    pairs = met.select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("other"), overlap.alias("overlap"))
    return latest(pairs, ["event_id"], [F.col("overlap").desc(), F.col("other")])


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm, 1 AS d FROM events UNION ALL SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) + 7200, -1 FROM events), s AS (SELECT user_id, tm, sum(d) AS d FROM e GROUP BY 1, 2)
SELECT user_id, CAST(max(n) AS BIGINT) AS most FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY tm) AS n FROM s) GROUP BY 1""")
def timeline_sweep(t: Tables):
    """Most intervals at once, by a sweep over their ends."""
    at = F.unix_timestamp("ts")
    ends = t.events.select("user_id", at.alias("at"), F.lit(1).alias("d")).unionByName(t.events.select("user_id", (at + 7200).alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy("user_id", "at").agg(F.sum("d").alias("d"))
    open_now = steps.withColumn("n", F.sum("d").over(Window.partitionBy("user_id").orderBy("at")))
    return open_now.groupBy("user_id").agg(F.max("n").alias("most"))


KEYWORDS = [(1, "steel", 1), (2, "tin", 2), (3, "brush", 1), (4, "brass", 3), (5, "polished tin", 2)]
VALUES = ", ".join(map(str, KEYWORDS))


@query(f"""WITH r(rule_id, alias, priority) AS (VALUES {VALUES}), m AS (SELECT p_partkey, rule_id, row_number() OVER (PARTITION BY p_partkey ORDER BY priority, length(alias) DESC, rule_id) AS rn FROM part JOIN r ON contains(lower(p_type), alias)) SELECT p_partkey, rule_id FROM m WHERE rn = 1""")
def substring_rule_join(t: Tables):
    """Label match against a rule table of fixed size: by priority, then the longest alias."""
    rules = F.broadcast(t.spark.createDataFrame(KEYWORDS, "rule_id int, alias string, priority int"))
    met = t.part.join(rules, F.lower("p_type").contains(F.col("alias")))
    return latest(met, ["p_partkey"], [F.col("priority"), F.length("alias").desc(), F.col("rule_id")]).select("p_partkey", "rule_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events), m AS (SELECT a.event_id, b.event_id AS nearest, abs(a.at - b.at) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.at - b.at), b.event_id) AS rn FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.at - b.at) <= 21600 WHERE a.event_type = 'view' AND b.event_type = 'purchase')
SELECT event_id, nearest, gap FROM m WHERE rn = 1""")
def asof_nearest(t: Tables):
    """The nearest row within a bound, by bins as wide as the bound and their neighbours."""
    bound, at = 21600, F.unix_timestamp("ts")
    e = t.events.select("event_id", "user_id", "event_type", at.alias("at"))
    bin_of = F.floor(F.col("at") / bound)
    a = e.filter("event_type = 'view'").withColumn("bin", bin_of).alias("a")
    b = e.filter("event_type = 'purchase'").withColumn("bin", F.explode(F.array(bin_of - 1, bin_of, bin_of + 1))).alias("b")
    gap = F.abs(F.col("a.at") - F.col("b.at"))
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.bin") == F.col("b.bin"))).filter(gap <= bound)
    return latest(met.select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("nearest"), gap.alias("gap")), ["event_id"], [F.col("gap"), F.col("nearest")])


@query("""WITH m AS (SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS next_line, b.l_partkey AS next_part, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey ORDER BY CASE WHEN a.l_returnflag = b.l_returnflag THEN 0 ELSE 1 END, b.l_partkey, b.l_suppkey) AS rn, a.l_partkey AS part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT l_orderkey, line, part, next_line, next_part FROM m WHERE rn = 1""")
def adjacent_self_join(t: Tables):
    """Fragments joined to the best scored candidate on the next page."""
    a, b = t.lineitem.alias("a"), t.lineitem.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1))
    rows = met.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("line"), F.col("a.l_partkey").alias("part"), F.col("a.l_suppkey").alias("supp"), F.col("b.l_linenumber").alias("next_line"), F.col("b.l_partkey").alias("next_part"), F.col("b.l_suppkey").alias("next_supp"), F.when(F.col("a.l_returnflag") == F.col("b.l_returnflag"), 0).otherwise(1).alias("cost"))
    return latest(rows, ["l_orderkey", "line", "part", "supp"], [F.col("cost"), F.col("next_part"), F.col("next_supp")]).select("l_orderkey", "line", "part", "next_line", "next_part")


ASKED_SQL = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'the ' || c_name || ' group' WHEN 2 THEN 'ext-' || c_custkey WHEN 3 THEN 'code ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE 'no such ' || c_mktsegment END AS asked FROM customer"


@query(f"""WITH q AS ({ASKED_SQL}), x AS (SELECT 'ext-' || c_custkey AS ext, c_custkey AS target FROM customer WHERE c_custkey % 10 = 2), w AS (SELECT k, unnest(string_split(asked, ' ')) AS word FROM q), s AS (SELECT w.k, min(c.c_custkey) AS target FROM w JOIN q USING (k) JOIN customer c ON c.c_name = w.word AND contains(q.asked, c.c_name) GROUP BY 1),
m AS (SELECT q.k, e.c_custkey AS exact, s.target AS part, x.target AS map, TRY_CAST(NULLIF(regexp_extract(asked, '\\d{{6}}', 0), '') AS BIGINT) AS code FROM q LEFT JOIN customer e ON asked = e.c_name LEFT JOIN s ON s.k = q.k LEFT JOIN x ON asked = x.ext)
SELECT k AS c_custkey, coalesce(exact, part, map, code) AS found, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'substring' WHEN map IS NOT NULL THEN 'external' WHEN code IS NOT NULL THEN 'code' ELSE 'none' END AS source FROM m""")
def tiered_resolution(t: Tables):
    """Exact name, else a name within the text, else a map of outside names, else the code in the text; the tier is
    the source. Candidates of the substring tier share a word with the name, so no two tables are crossed."""
    k = F.col("c_custkey")
    kinds = [F.col("c_name"), F.concat(F.lit("the "), "c_name", F.lit(" group")), F.concat(F.lit("ext-"), k.cast("string")), F.concat(F.lit("code "), F.lpad(k.cast("string"), 6, "0"))]
    asked = F.concat(F.lit("no such "), "c_mktsegment")
    for i, kind in enumerate(kinds):
        asked = F.when(k % 5 == i, kind).otherwise(asked)
    q = t.customer.select(k, asked.alias("asked"))
    names = t.customer.select(F.col("c_custkey").alias("target"), F.col("c_name").alias("name"))
    words = q.select("c_custkey", "asked", F.explode(F.split("asked", " ")).alias("name"))
    part = words.join(names, "name").filter(F.col("asked").contains(F.col("name"))).groupBy("c_custkey").agg(F.min("target").alias("part"))
    outside = t.customer.filter(k % 10 == 2).select(F.concat(F.lit("ext-"), k.cast("string")).alias("ext"), k.alias("map"))
    rows = q.join(names.select(F.col("target").alias("exact"), "name"), F.col("asked") == F.col("name"), "left").join(part, "c_custkey", "left").join(outside, F.col("asked") == F.col("ext"), "left")
    rows = rows.withColumn("code", F.nullif(F.regexp_extract("asked", r"\d{6}", 0), F.lit("")).cast("long"))
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("part").isNotNull(), "substring").when(F.col("map").isNotNull(), "external").when(F.col("code").isNotNull(), "code").otherwise("none")
    return rows.select("c_custkey", F.coalesce("exact", "part", "map", "code").alias("found"), source.alias("source"))


@query("""SELECT n_name, count(s_suppkey) AS n_suppliers, CAST(coalesce(sum(CAST(s_acctbal AS DECIMAL(18,4))), 0) AS DOUBLE) AS balance FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name""")
def left_group(t: Tables):
    """Outer join, then groups."""
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"), F.coalesce(F.sum(amount(F.col("s_acctbal"))), F.lit(0)).cast("double").alias("balance"))


@query("""SELECT a.o_custkey, count(*) AS pairs, count(*) FILTER (WHERE a.o_totalprice > b.o_totalprice) AS rises FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' GROUP BY 1""")
def paired_self_join(t: Tables):
    """On and off variants of a case side by side; rises are counted by rank, without forming the pairs."""
    rows = t.orders.filter("o_orderstatus IN ('O', 'F')").select("o_custkey", "o_totalprice", (F.col("o_orderstatus") == "O").cast("long").alias("on"))
    # Of equal prices the on side stands first: what stands before it on the off side is lower.
    below = Window.partitionBy("o_custkey").orderBy("o_totalprice", F.col("on").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lower", F.sum(1 - F.col("on")).over(below))
    counts = rows.groupBy("o_custkey").agg(F.sum("on").alias("n_on"), F.sum(1 - F.col("on")).alias("n_off"), F.sum(F.col("on") * F.col("lower")).alias("rises"))
    return counts.filter("n_on > 0 AND n_off > 0").select("o_custkey", (F.col("n_on") * F.col("n_off")).alias("pairs"), "rises")


@query("""WITH a AS (SELECT l_suppkey AS k, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT a.k AS l_suppkey, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM a JOIN b ON a.k = b.k AND a.p = b.p GROUP BY 1""")
def multiset_overlap(t: Tables):
    """Size of a multiset intersection."""
    side = lambda flag, n: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias(n))
    return side("A", "a").join(side("R", "b"), ["l_suppkey", "l_partkey"]).groupBy("l_suppkey").agg(F.sum(F.least("a", "b")).alias("common"))


@query("""SELECT o_orderkey, l_orderkey IS NULL AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey""")
def missing_reference(t: Tables):
    """Rows that lack their evidence."""
    cited = t.lineitem.select("l_orderkey").distinct()
    return t.orders.join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNull().alias("missing"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem), m AS (SELECT a.k, a.n AS note, a.p AS note_part, b.n AS tbl, b.p AS part, round(0.4 + CASE WHEN a.f = b.f THEN 0.3 ELSE 0 END + CASE WHEN a.s % 5 = b.s % 5 THEN 0.2 ELSE 0 END + CASE WHEN abs(a.n - b.n) = 1 THEN 0.1 ELSE 0 END, 2)::DOUBLE AS score, a.s AS note_supp, b.s AS supp FROM a JOIN a b ON a.k = b.k WHERE a.n % 2 = 1 AND b.n % 2 = 0)
SELECT k AS l_orderkey, note, note_part, tbl, part, score FROM m WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY k, note, note_part, note_supp ORDER BY score DESC, tbl, part, supp) <= 2""")
def scored_links(t: Tables):
    """Notes linked to tables of their own filing by base, intent, relation and closeness; the best two of each note
    that are sure enough. Lines of an order stand for both."""
    side = lambda odd, of: t.lineitem.filter(F.col("l_linenumber") % 2 == odd).select("l_orderkey", F.col("l_linenumber").alias(of), F.col("l_partkey").alias(f"{of}_part"), F.col("l_suppkey").alias(f"{of}_supp"), F.col("l_returnflag").alias(f"{of}_flag"))
    met = side(1, "note").join(side(0, "tbl"), "l_orderkey")
    same = lambda cond, worth: F.when(cond, worth).otherwise(0.0)
    score = F.lit(0.4) + same(F.col("note_flag") == F.col("tbl_flag"), 0.3) + same(F.col("note_supp") % 5 == F.col("tbl_supp") % 5, 0.2) + same(F.abs(F.col("note") - F.col("tbl")) == 1, 0.1)
    sure = met.withColumn("score", F.round(score, 2)).filter("score >= 0.5")
    best = top_per_group(sure, ["l_orderkey", "note", "note_part", "note_supp"], [F.col("score").desc(), F.col("tbl"), F.col("tbl_part"), F.col("tbl_supp")], 2)
    return best.select("l_orderkey", "note", "note_part", "tbl", F.col("tbl_part").alias("part"), "score")
