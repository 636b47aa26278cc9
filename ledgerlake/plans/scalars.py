"""Scalar functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.money import currency_of, duration_bucket as bucket_of, quarter_end, scale_of
from ledgerlake.functions.numeric import amount, calculator_number, close, importer_number, lookup_number, parse_accounting as parsed, parse_printed, ratio, verifier_number, yoy
from ledgerlake.functions.text import compact, host, ngrams as runs_of, normal_label, path, redacted, stable_id, statements, tokens, without_comments, without_literals

from .registry import Tables, query


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' WHEN c_acctbal < 0 THEN '(' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) || ')' ELSE '1,' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS raw, c_acctbal FROM customer)
SELECT c_custkey, CAST(TRY_CAST(regexp_replace(regexp_replace(raw, '[,\\s]', '', 'g'), '^\\((.*)\\)$', '-\\1') AS DECIMAL(18,6)) AS DOUBLE) AS value FROM f""")
def parse_accounting(t: Tables):
    """printed amounts with brackets and commas."""
    b = F.col("c_acctbal")
    raw = F.when(F.col("c_custkey") % 4 == 0, "n/a").when(b < 0, F.concat(F.lit("("), F.abs(b).cast("decimal(18,2)").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("1,"), b.cast("decimal(18,2)").cast("string")))
    return t.customer.select("c_custkey", parsed(raw).cast("double").alias("value"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS compact FROM part""")
def normalize_label(t: Tables):
    """F04."""
    return t.part.select("p_partkey", normal_label(F.col("p_name")).alias("label"), compact(F.col("p_type")).alias("compact"))


UNITS = ["HK$ million", "RMB thousand", "KRW 100 million", "US$ billion", "plain"]
UNIT_SQL = "['HK$ million', 'RMB thousand', 'KRW 100 million', 'US$ billion', 'plain'][CAST(p_partkey % 5 AS INT) + 1]"


def unit_text():
    return F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % 5 + 1).cast("int"))


@query(f"""WITH u AS (SELECT p_partkey, lower({UNIT_SQL}) AS u FROM part) SELECT p_partkey, CASE WHEN contains(u, '100 million') THEN 1e8 WHEN contains(u, 'billion') THEN 1e9 WHEN contains(u, 'million') THEN 1e6 WHEN contains(u, 'thousand') THEN 1e3 ELSE 1 END::DOUBLE AS scale FROM u""")
def infer_scale(t: Tables):
    """scale of a unit text, longest wording first."""
    return t.part.select("p_partkey", scale_of(unit_text()).alias("scale"))


@query(f"""WITH u AS (SELECT p_partkey, lower({UNIT_SQL}) AS u FROM part) SELECT p_partkey, CASE WHEN contains(u, 'hk$') THEN 'HKD' WHEN contains(u, 'us$') THEN 'USD' WHEN contains(u, 'rmb') THEN 'CNY' WHEN contains(u, 'krw') THEN 'KRW' END AS currency FROM u""")
def infer_currency(t: Tables):
    """F06."""
    return t.part.select("p_partkey", currency_of(unit_text()).alias("currency"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1000 ELSE NULL END AS standardized, CASE p_partkey % 3 WHEN 2 THEN 'per_share' ELSE 'amount' END AS kind FROM part""")
def standardize_value(t: Tables):
    """times one, times a thousand, or per share."""
    k = F.col("p_partkey") % 3
    return t.part.select("p_partkey", F.when(k == 0, F.col("p_retailprice")).when(k == 1, F.col("p_retailprice") * 1000).alias("standardized"), F.when(k == 2, "per_share").otherwise("amount").alias("kind"))


@query("""SELECT o_orderkey, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y%m%d')), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'soon' END AS d FROM orders)""")
def parse_dates(t: Tables):
    """the first format that reads."""
    k, o = F.col("o_orderkey") % 4, F.col("o_orderdate")
    d = F.when(k == 0, F.date_format(o, "yyyy-MM-dd")).when(k == 1, F.date_format(o, "yyyy/MM/dd")).when(k == 2, F.date_format(o, "yyyyMMdd")).otherwise("soon")
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(d, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")])
    return t.orders.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, coalesce(strftime(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, '%Y-%m-%d'), CASE WHEN o_orderkey % 10 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END, 'unknown') AS period_key FROM orders""")
def period_key(t: Tables):
    """day, else year, else unknown."""
    k, o = F.col("o_orderkey"), F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.coalesce(F.date_format(F.when(k % 5 != 0, o), "yyyy-MM-dd"), F.when(k % 10 != 0, F.year(o).cast("string")), F.lit("unknown")).alias("period_key"))


@query("""SELECT DISTINCT year(o_orderdate) AS year, strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d') AS first_day, strftime(make_date(year(o_orderdate), 12, 31), '%Y-%m-%d') AS last_day FROM orders""")
def fiscal_range(t: Tables):
    """F10."""
    y = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    day = lambda m, d: F.date_format(F.make_date("year", F.lit(m), F.lit(d)), "yyyy-MM-dd")
    return y.select("year", day(1, 1).alias("first_day"), day(12, 31).alias("last_day"))


@query("""WITH d AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) + 1 AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT CASE WHEN days BETWEEN 80 AND 100 THEN 'QTD' WHEN days BETWEEN 170 AND 190 THEN 'H1' WHEN days BETWEEN 260 AND 285 THEN '9M' WHEN days BETWEEN 350 AND 380 THEN 'FY' ELSE 'OTHER' END AS bucket, count(*) AS n FROM d GROUP BY 1""")
def duration_bucket(t: Tables):
    """class of an inclusive duration."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(bucket_of(F.datediff("l_shipdate", "o_orderdate") + 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, strftime(CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderdate AS DATE) + 30 WHEN '2-HIGH' THEN CAST(o_orderdate AS DATE) + 90 ELSE last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) END, '%Y-%m-%d') AS due FROM orders""")
def due_date(t: Tables):
    """due by category, or at the quarter's end."""
    o, p = F.to_date("o_orderdate"), F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.date_format(F.when(p == "1-URGENT", F.date_add(o, 30)).when(p == "2-HIGH", F.date_add(o, 90)).otherwise(quarter_end(o)), "yyyy-MM-dd").alias("due"))


@query("""SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,4)) * 1000 AS DOUBLE) AS base, CAST(CAST(s_acctbal AS DECIMAL(18,4)) * 1000 AS DOUBLE) / 1e8 AS hundred_million, CASE WHEN s_nationkey % 2 = 0 THEN CAST(CAST(s_acctbal AS DECIMAL(18,4)) * 1000 * 7 AS DOUBLE) END AS cny FROM supplier""")
def normalize_amount(t: Tables):
    """base units, hundred millions, another currency where a rate is known."""
    base = amount(F.col("s_acctbal")) * 1000
    return t.supplier.select("s_suppkey", base.cast("double").alias("base"), (base.cast("double") / 1e8).alias("hundred_million"), F.when(F.col("s_nationkey") % 2 == 0, (base * 7).cast("double")).alias("cny"))


@query("""SELECT n_name, CASE WHEN count(c_custkey) > 0 THEN CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(c_custkey) END AS per_head FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def per_capita(t: Tables):
    """per head, nothing without heads."""
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.try_divide(F.sum(amount(F.col("c_acctbal"))).cast("double"), F.count("c_custkey").cast("double")).alias("per_head"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'fx_required' WHEN l_tax = 0 THEN 'division_by_zero' ELSE 'ok' END AS status, CASE WHEN l_returnflag <> 'A' AND l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem""")
def ratio_status(t: Tables):
    """a ratio and why it is missing."""
    status = F.when(F.col("l_returnflag") == "A", "fx_required").when(F.col("l_tax") == 0, "division_by_zero").otherwise("ok")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"), F.when(status == "ok", F.try_divide("l_discount", "l_tax")).alias("ratio"))


@query("""SELECT s_suppkey, CASE WHEN b = 0 THEN 'undefined' WHEN b < 0 THEN 'not_applicable' ELSE 'ok' END AS status, CASE WHEN b > 0 THEN CAST(a - b AS DOUBLE) / CAST(abs(b) AS DOUBLE) END AS growth FROM (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(18,4)) AS b, CAST(s_acctbal AS DECIMAL(18,4)) + s_suppkey AS a FROM supplier)""")
def yoy_policy(t: Tables):
    """F16: negative bases are not applicable."""
    b = amount(F.col("s_acctbal"))
    return t.supplier.select("s_suppkey", F.when(b == 0, "undefined").when(b < 0, "not_applicable").otherwise("ok").alias("status"), yoy(b + F.col("s_suppkey"), b).alias("growth"))


@query("""SELECT p_partkey, abs(CAST(p_retailprice AS DECIMAL(18,4)) - CAST(p_retailprice AS DECIMAL(18,0))) <= greatest(0.01, abs(CAST(p_retailprice AS DECIMAL(18,0))) * 0.0005) AS agrees FROM part""")
def reported_check(t: Tables):
    """reported against calculated."""
    a, b = amount(F.col("p_retailprice")), amount(F.col("p_retailprice"), 0)
    return t.part.select("p_partkey", (F.abs(a - b) <= F.greatest(F.lit(0.01).cast("decimal(18,6)"), F.abs(b) * F.lit("0.0005").cast("decimal(10,4)"))).alias("agrees"))


@query("""SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS rounded FROM part""")
def round_half_up(t: Tables):
    """half away from zero, on decimals."""
    return t.part.select("p_partkey", F.round(amount(F.col("p_retailprice")), 1).cast("double").alias("rounded"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - l_tax) <= greatest(abs(l_discount), abs(l_tax)) * 1e-6 AS same FROM lineitem""")
def decimal_close(t: Tables):
    """F20, F21."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", close(F.col("l_discount"), F.col("l_tax")).alias("same"))


@query("""SELECT p_partkey, list_contains(regexp_extract_all(p_name || ' ' || p_size || ' of 1,000', '\\d[\\d,]*'), CAST(p_size AS VARCHAR)) AS found FROM part""")
def value_in_text(t: Tables):
    """Is the value among the numbers of its evidence?"""
    text = F.concat_ws(" ", "p_name", "p_size", F.lit("of 1,000"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*"), 0), lambda n: F.regexp_replace(n, ",", "").try_cast("long"))
    return t.part.select("p_partkey", F.exists(numbers, lambda n: n == F.col("p_size")).alias("found"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS pe, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS pb FROM lineitem""")
def safe_ratios(t: Tables):
    """F23."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.try_divide("l_extendedprice", "l_tax").alias("pe"), F.try_divide("l_quantity", "l_discount").alias("pb"))


@query("""WITH m AS (SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean FROM part GROUP BY 1) SELECT p_partkey, (p_retailprice - mean) / mean AS deviation FROM part JOIN m USING (p_brand)""")
def deviation(t: Tables):
    """distance from the benchmark of its group."""
    m = t.part.groupBy("p_brand").agg((F.sum(amount(F.col("p_retailprice"))).cast("double") / F.count(F.lit(1))).alias("mean"))
    return t.part.join(m, "p_brand").select("p_partkey", ((F.col("p_retailprice") - F.col("mean")) / F.col("mean")).alias("deviation"))


@query("""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[.!?]+$', '') AS text FROM conversations""")
def normalize_text(t: Tables):
    """F25 for ASCII."""
    return t.conversations.select("conv_id", "turn", F.regexp_replace(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), "[.!?]+$", "").alias("text"))


INTENTS = {"compare": ["than", "versus"], "define": ["what", "which"], "other": []}


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'than') OR contains(lower(text), 'versus') THEN 'compare' WHEN contains(lower(text), 'what') OR contains(lower(text), 'which') THEN 'define' ELSE 'other' END AS intent FROM conversations""")
def intent_classify(t: Tables):
    """the first intent with a marker."""
    low, out = F.lower("text"), None
    for intent, markers in INTENTS.items():
        hit = F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m)) if markers else F.lit(True)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return t.conversations.select("conv_id", "turn", out.alias("intent"))


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+')[1], '') AS first FROM documents""")
def tokenize(t: Tables):
    """F27 for ASCII."""
    w = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), g AS (SELECT item_id, unnest(generate_series(1, len(w) - 1)) AS i, w FROM w) SELECT w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM g GROUP BY 1""")
def ngrams(t: Tables):
    """word pairs."""
    return t.benchmark.select(F.explode(runs_of(tokens(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits FROM part")
def edit_distance(t: Tables):
    """F29."""
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits"))


@query("""SELECT doc_id, CAST(contains(text, 'and') AS INT) + CAST(contains(text, 'der') AS INT) - CAST(contains(text, '!!') AS INT) AS score FROM documents""")
def lexicon_sentiment(t: Tables):
    """F32: good words less bad ones."""
    has = lambda w: F.col("text").contains(w).cast("int")
    return t.documents.select("doc_id", (has("and") + has("der") - has("!!")).alias("score"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '([a-z0-9-]+\\.[a-z]+)$', 1) AS domain FROM pages""")
def url_domain(t: Tables):
    """F33."""
    h = host(F.col("url"))
    return t.pages.select("page_id", h.alias("host"), F.regexp_extract(h, r"([a-z0-9-]+\.[a-z]+)$", 1).alias("domain"))


@query("""WITH s AS (SELECT p_partkey, CAST(contains(p_type, 'STEEL') AS INT) + CAST(contains(p_type, 'ANODIZED') AS INT) AS a, CAST(contains(p_type, 'BRASS') AS INT) + CAST(contains(p_type, 'POLISHED') AS INT) AS b FROM part) SELECT p_partkey, CASE WHEN a = b THEN NULL WHEN a > b THEN 'steel' ELSE 'brass' END AS kind FROM s""")
def detect_type(t: Tables):
    """The kind with most alias hits, none on a tie."""
    hits = lambda *ws: sum((F.col("p_type").contains(w).cast("int") for w in ws), F.lit(0))
    a, b = hits("STEEL", "ANODIZED"), hits("BRASS", "POLISHED")
    return t.part.select("p_partkey", F.when(a > b, "steel").when(b > a, "brass").alias("kind"))


@query("SELECT c_custkey, substr(sha256(concat_ws('|', c_name, c_mktsegment)), 1, 16) AS slug FROM customer")
def stable_slug(t: Tables):
    """F35."""
    return t.customer.select("c_custkey", stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("slug"))


@query("""SELECT p_partkey, TRY_CAST(regexp_extract('size: ' || p_size || '; brand: ' || p_brand, 'size:\\s*(\\d+)', 1) AS INT) AS size, regexp_extract('size: ' || p_size || '; brand: ' || p_brand, 'brand:\\s*([^;]+)', 1) AS brand FROM part""")
def labeled_value(t: Tables):
    """values behind their labels in running text."""
    text = F.concat(F.lit("size: "), F.col("p_size").cast("string"), F.lit("; brand: "), F.col("p_brand"))
    return t.part.select("p_partkey", F.regexp_extract(text, r"size:\s*(\d+)", 1).try_cast("int").alias("size"), F.regexp_extract(text, r"brand:\s*([^;]+)", 1).alias("brand"))


@query("""SELECT page_id, regexp_replace(regexp_replace(replace(url, '://', '://u:p@') || '&token=abc', '://[^/@\\s:]+:[^/@\\s]+@', '://***@', 'g'), '(token|secret|password|api_key)=[^&\\s]+', '\\1=***', 'gi') AS url FROM pages""")
def redact_text(t: Tables):
    """credentials and secrets masked."""
    return t.pages.select("page_id", redacted(F.concat(F.replace("url", F.lit("://"), F.lit("://u:p@")), F.lit("&token=abc"))).alias("url"))


@query("""SELECT CASE WHEN regexp_matches(p, '^/(en|de|fr|es)/[0-9]+/?$') THEN '/{lang}/{id}' WHEN regexp_matches(p, '^/(en|de|fr|es)/[0-9]+\\.html$') THEN '/{lang}/{id}.html' ELSE '/__unmatched__' END AS route, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages) GROUP BY 1""")
def path_template(t: Tables):
    """few labels for many paths."""
    p = path(F.col("url"))
    route = F.when(p.rlike("^/(en|de|fr|es)/[0-9]+/?$"), "/{lang}/{id}").when(p.rlike(r"^/(en|de|fr|es)/[0-9]+\.html$"), "/{lang}/{id}.html").otherwise("/__unmatched__")
    return t.pages.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, round(greatest(0.35, pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01'), 0) / 30.0)), 6)::DOUBLE AS weight FROM orders""")
def recency_decay(t: Tables):
    """half life of thirty days, a floor, a given day."""
    age = F.greatest(F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate"), F.lit(0)) / F.lit(30.0)
    return t.orders.select("o_orderkey", F.round(F.greatest(F.lit(0.35), F.pow(F.lit(0.5), age)), 6).alias("weight"))


@query("""SELECT page_id, CASE WHEN h LIKE '%.org' THEN 'tier1' WHEN h LIKE '%.net' THEN 'tier2' ELSE 'tier3' END AS tier FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h FROM pages)""")
def host_tier(t: Tables):
    """F43."""
    h = host(F.col("url"))
    return t.pages.select("page_id", F.when(h.endswith(".org"), "tier1").when(h.endswith(".net"), "tier2").otherwise("tier3").alias("tier"))


@query("""SELECT n_nationkey, CAST(round(CAST(count(s_suppkey) AS DECIMAL(38,12)) / 100, 4) AS DOUBLE) AS share FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def display_share(t: Tables):
    """shares to four places."""
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy("n_nationkey").agg(ratio(F.count("s_suppkey"), F.lit(100)).cast("double").alias("share"))


#: Ways in which an amount is printed; {} is the amount.
FORMS = ("{}", "({})", "HK$ {} million", "(RMB {})", "−{}", "note 3: ({}) of it", "{}%", "n/a", "about {}", "+{}", "- {}", "{} thousand")
PRINTED_SQL = "replace([" + ", ".join(f"'{f}'" for f in FORMS) + f"][CAST(c_custkey % {len(FORMS)} AS INT) + 1], '{{}}', format('{{:,.2f}}', CAST(abs(c_acctbal) AS DOUBLE)))"
STRICT_SQL = r"CASE WHEN regexp_matches({0}, '^[-+]?(\d+(\.\d*)?|\.\d+)$') THEN TRY_CAST({0} AS DOUBLE) END"


@query(rf"""WITH p AS (SELECT c_custkey, {PRINTED_SQL} AS t FROM customer), c AS (SELECT *, replace(t, '−', '-') AS plain FROM p),
x AS (SELECT *, regexp_extract(plain, '[（(]\s*([-+]?\d[\d,，]*(?:\.\d+)?)\s*[）)]', 1) AS inside, regexp_replace(regexp_replace(t, '^[()]+|[()]+$', '', 'g'), '[,%\s]', '', 'g') AS bare, regexp_matches(t, '^\(.+\)$') AS wrapped FROM c),
v AS (SELECT *, regexp_replace(regexp_replace(replace(CASE WHEN wrapped THEN t[2:-2] ELSE t END, '−', '-'), '(?i)(hk\$|us\$|rmb|cny|hkd|usd|eur|gbp|jpy|krw|\$)', '', 'g'), '(?i)(million|billion|thousand|mn|bn|m|k)', '', 'g') AS words FROM x),
n AS (SELECT *, TRY_CAST(NULLIF(regexp_extract(replace(replace(CASE WHEN inside <> '' THEN inside ELSE plain END, ',', ''), ' ', ''), '[-+]?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS calc, {STRICT_SQL.format("bare")} AS imp, regexp_replace(words, '[^0-9.\-+]', '', 'g') AS ver FROM v)
SELECT c_custkey, t AS printed, CASE WHEN inside <> '' THEN -abs(calc) ELSE calc END AS calculator, CASE WHEN t = 'n/a' THEN NULL WHEN wrapped THEN -imp ELSE imp END AS importer,
CASE WHEN t = 'n/a' OR regexp_matches(words, '[A-Za-z]') THEN NULL WHEN wrapped AND {STRICT_SQL.format("ver")} > 0 THEN -{STRICT_SQL.format("ver")} ELSE {STRICT_SQL.format("ver")} END AS verifier,
CASE WHEN wrapped THEN -1 ELSE 1 END * {STRICT_SQL.format("regexp_replace(replace(t, ',', ''), '^[()]+|[()]+$', '', 'g')")} AS lookup FROM n""")
def number_variants(t: Tables):
    """the same printed amount by the four readers, which differ on words, percent signs and brackets."""
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("c_custkey") % len(FORMS)).cast("int") + 1)
    rows = t.customer.select("c_custkey", F.replace(form, F.lit("{}"), F.format_number(F.abs("c_acctbal"), 2)).alias("printed"))
    p = F.col("printed")
    return rows.select("c_custkey", "printed", calculator_number(p).cast("double").alias("calculator"), importer_number(p).cast("double").alias("importer"), verifier_number(p).cast("double").alias("verifier"), lookup_number(p).alias("lookup"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM orders""")
def printed_amounts(t: Tables):
    """amounts with currency and scale words, loss marks, note markers and brackets."""
    price = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("*5 "), price, F.lit(" million"))).when(k == 1, F.concat(F.lit("△"), price, F.lit("百万円"))).when(k == 2, F.concat(F.lit("("), price, F.lit(") US$"))).otherwise("-")
    return t.orders.select("o_orderkey", parse_printed(text).cast("double").alias("value"))


#: SQL as people send it; {} is a number of the row.
SENT = ("select a from t{}; -- the ; end", "/* x ; {} */ select 1;; select ';--{}' as b", "select 'it''s {}' /* a */, \"q\" -- c\n from t ; delete from t", "-- only {}", "{}")
SENT_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENT) + "]"
LITERAL_SQL, COMMENT_SQL = "''(?:[^'']|'''')*''", r"--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


@query(rf"""WITH q AS (SELECT o_orderkey, replace({SENT_SQL}[CAST(o_orderkey % {len(SENT)} AS INT) + 1], '{{}}', CAST(o_orderkey AS VARCHAR)) AS s FROM orders),
c AS (SELECT o_orderkey, replace(replace(regexp_replace(s, '({LITERAL_SQL})|({COMMENT_SQL})', '\1' || chr(1), 'g'), '''' || chr(1), ''''), chr(1), ' ') AS bare FROM q)
SELECT o_orderkey, bare, regexp_replace(bare, '{LITERAL_SQL}', '''''', 'g') AS blanked, list_filter(list_transform(regexp_extract_all(bare, '(?:[^;'']|{LITERAL_SQL})+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS parts FROM c""")
def sql_texts(t: Tables):
    """comments and literals of SQL texts stripped, and their statements parted."""
    form = F.element_at(F.array(*map(F.lit, SENT)), (F.col("o_orderkey") % len(SENT)).cast("int") + 1)
    rows = t.orders.select("o_orderkey", F.replace(form, F.lit("{}"), F.col("o_orderkey").cast("string")).alias("s"))
    return rows.select("o_orderkey", without_comments(F.col("s")).alias("bare"), without_literals(F.col("s")).alias("blanked"), statements(F.col("s")).alias("parts"))
