"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.numeric import amount, ratio
from ledgerlake.functions.text import question_key, tokens
from ledgerlake.operators.core import rolled_up, salted_sum, top_per_group
from ledgerlake.operators.ranks import Standing, median, middle_ranks, nearest_rank, rounded_rank

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


def value_amount():
    return amount(F.col("value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_count(t: Tables):
    """G01, M19."""
    return t.events.groupBy("event_type").agg(row_count().alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2000-01-01') AS BIGINT) AS age_days FROM orders GROUP BY 1""")
def queue_depth_age(t: Tables):
    """Depth and age of the oldest, at a given time."""
    oldest = F.min("o_orderdate")
    return t.orders.groupBy("o_orderstatus").agg(row_count().alias("n"), F.date_format(oldest, "yyyy-MM-dd").alias("oldest"), F.datediff(F.lit("2000-01-01").cast("date"), oldest).cast("long").alias("age_days"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_distinct(t: Tables):
    """G03."""
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(coalesce(sum(CASE WHEN value > 20 THEN CAST(value AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS total FROM events GROUP BY 1, 2, 3""")
def sum_coalesce(t: Tables):
    """Sum with a filter, zero where nothing is left."""
    total = F.coalesce(F.sum(F.when(F.col("value") > 20, value_amount())), F.lit(0)).cast("double")
    return t.events.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(total.alias("total"))


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R FROM lineitem GROUP BY 1""")
def pivot_wide(t: Tables):
    """Long to wide, with the values named so that no extra pass finds them."""
    return t.lineitem.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))


@query("""SELECT l_suppkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS done, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS open, CAST(sum(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS DOUBLE) AS discounted, count(*) AS n FROM lineitem GROUP BY 1""")
def wide_metrics(t: Tables):
    """Several conditional sums of one pass."""
    total = lambda test, c: F.sum(F.when(test, amount(F.col(c)))).cast("double")
    return t.lineitem.groupBy("l_suppkey").agg(total(F.col("l_linestatus") == "F", "l_quantity").alias("done"), total(F.col("l_linestatus") == "O", "l_quantity").alias("open"), total(F.col("l_discount") > 0.05, "l_extendedprice").alias("discounted"), row_count().alias("n"))


def question_groups(rows, key, id_col: str, most: int = 20):
    """Questions by normal form: count, and at most `most` of the newest ids, kept bounded while aggregating."""
    keyed = rows.withColumn("question", key).filter("question != ''")
    counts = keyed.groupBy("question").agg(row_count().alias("n"), F.max(id_col).alias("last_id"))
    newest = top_per_group(keyed.select("question", id_col), ["question"], [F.col(id_col).desc()], most)
    ids = newest.groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(id_col), False), lambda x: x.cast("string")), ",").alias("ids"))
    return counts.join(ids, "question").withColumn("complete", F.col("n") <= most)


@query("""WITH q AS (SELECT conv_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^[\\s.,;:!?]+|[\\s.,;:!?]+$', '', 'g') AS question FROM conversations WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY conv_id DESC) AS rn FROM q WHERE question <> '')
SELECT question, count(*) AS n, max(conv_id) AS last_id, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id DESC) FILTER (WHERE rn <= 20) AS ids, count(*) <= 20 AS complete FROM r GROUP BY 1""")
def question_frequency(t: Tables):
    """G07 on the first kind of punctuation; the Unicode form is tested on its own."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), r"^[\s.,;:!?]+|[\s.,;:!?]+$", "")
    return question_groups(t.conversations.filter("role = 'user'"), key, "conv_id")


@query("""WITH p AS (SELECT s_nationkey, count(*) AS n, round(avg(CAST(s_acctbal AS DECIMAL(18,4))), 2) AS mean, median(s_acctbal) AS med, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier GROUP BY 1), r AS (SELECT s_suppkey, s_nationkey, s_acctbal, CAST(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS DOUBLE) AS pr FROM supplier)
SELECT s_suppkey, n, CAST(mean AS DOUBLE) AS mean, med, low, high, round(pr, 6) AS percentile FROM r JOIN p USING (s_nationkey)""")
def peer_stats(t: Tables):
    """A company among its peers; the percentile counts values up to its own. No task holds all peers: the counts of
    values are dealt by ranges."""
    s = t.supplier
    means = s.groupBy("s_nationkey").agg(row_count().alias("n"), F.round(F.avg(amount(F.col("s_acctbal"))), 2).cast("double").alias("mean"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    standing = Standing(s, ["s_nationkey"], "s_acctbal")
    middles = standing.at(middle_ranks()).select("s_nationkey", median().alias("med"))
    # One row a nation: 25.
    peers = F.broadcast(means.join(middles, "s_nationkey"))
    upto = standing.upto().select("s_nationkey", "s_acctbal", F.round(F.col("upto") / F.col("n"), 6).alias("percentile"))
    return s.select("s_suppkey", "s_nationkey", "s_acctbal").join(upto, ["s_nationkey", "s_acctbal"]).join(peers, "s_nationkey").select("s_suppkey", "n", "mean", "med", "low", "high", "percentile")


@query("""WITH m AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS s FROM events), a AS (SELECT user_id, count(*) FILTER (WHERE s = 1) AS pos, count(*) FILTER (WHERE s = -1) AS neg, count(*) FILTER (WHERE s = 0) AS neutral, round(CAST(sum(s) AS DECIMAL(38,12)) / count(*), 4) AS score FROM m GROUP BY 1)
SELECT user_id, pos, neg, neutral, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.3 THEN 'positive' WHEN score <= -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM a""")
def sentiment_rollup(t: Tables):
    """Share of good minus bad, labelled at 0.3."""
    s = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    a = t.events.select("user_id", s.alias("s")).groupBy("user_id").agg(F.count_if(F.col("s") == 1).alias("pos"), F.count_if(F.col("s") == -1).alias("neg"), F.count_if(F.col("s") == 0).alias("neutral"), ratio(F.sum("s"), row_count()).alias("score"))
    label = F.when(F.col("score") >= 0.3, "positive").when(F.col("score") <= -0.3, "negative").otherwise("neutral")
    return a.select("user_id", "pos", "neg", "neutral", F.col("score").cast("double").alias("score"), label.alias("label"))


@query("""WITH s AS (SELECT l_orderkey, CASE WHEN l_discount > 0.09 THEN 'fail' WHEN l_tax > 0.07 THEN 'warning' WHEN l_returnflag = 'N' THEN 'skipped' ELSE 'pass' END AS status FROM lineitem) SELECT l_orderkey, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'skipped' END AS status FROM s GROUP BY 1""")
def status_rollup(t: Tables):
    """Lattice of statuses."""
    status = F.when(F.col("l_discount") > 0.09, "fail").when(F.col("l_tax") > 0.07, "warning").when(F.col("l_returnflag") == "N", "skipped").otherwise("pass")
    return t.lineitem.select("l_orderkey", status.alias("s")).groupBy("l_orderkey").agg(rolled_up("s").alias("status"))


RANKS = {"allow": 0, "review": 1, "block": 2}


@query("""WITH d AS (SELECT user_id, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS rank, event_type FROM events) SELECT user_id, ['allow', 'review', 'block'][CAST(max(rank) AS INT) + 1] AS decision, array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE rank > 0))), ',') AS reasons FROM d GROUP BY 1""")
def decision_lattice(t: Tables):
    """The gravest decision of each target with its reasons, each once."""
    decision = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "review").otherwise("allow")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), decision)
    d = t.events.select("user_id", F.struct(rank.alias("rank"), decision.alias("label")).alias("d"), F.when(rank > 0, F.col("event_type")).alias("reason"))
    reasons = F.array_join(F.sort_array(F.collect_set("reason")), ",")
    return d.groupBy("user_id").agg(F.max("d").alias("d"), reasons.alias("reasons")).select("user_id", F.col("d.label").alias("decision"), "reasons")


@query("""SELECT l_partkey, CAST(sum(CASE WHEN l_discount > 0.02 THEN CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) / NULLIF(CAST(sum(CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE), 0) AS mean FROM lineitem GROUP BY 1""")
def weighted_mean(t: Tables):
    """Weighted mean over the inputs that are there."""
    there = F.col("l_discount") > 0.02
    w, x = amount(F.col("l_quantity")), amount(F.col("l_extendedprice"))
    mean = F.try_divide(F.sum(F.when(there, x * w)).cast("double"), F.sum(F.when(there, w)).cast("double"))
    return t.lineitem.groupBy("l_partkey").agg(mean.alias("mean"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def p95_nearest_rank(t: Tables):
    """Nearest rank, ceil form."""
    return Standing(t.events, ["event_type"], "value").at({"p95": nearest_rank(0.95)})


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)) AS p90 FROM r GROUP BY 1""")
def p50_p90_profile(t: Tables):
    """Nearest rank of round((n - 1) p), half to even."""
    return Standing(t.events, ["event_type"], "value").at({"p50": rounded_rank(0.5), "p90": rounded_rank(0.9)})


@query("""SELECT user_id, round(regr_slope(value, floor(epoch(ts))) * 3600, 6) AS slope FROM events GROUP BY 1""")
def regr_slope(t: Tables):
    """Least-squares slope an hour."""
    return t.events.groupBy("user_id").agg(F.round(F.regr_slope("value", F.unix_timestamp("ts").cast("double")) * 3600, 6).alias("slope"))


@query("""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 25""")
def top_terms(t: Tables):
    """The 25 most frequent terms."""
    return t.documents.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(row_count().alias("n")).orderBy(F.col("n").desc(), "token").limit(25)


@query("""SELECT user_id, event_type AS most FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def mode_value(t: Tables):
    """Most frequent value, the lower on a tie."""
    return t.events.groupBy("user_id").agg(F.mode("event_type", True).alias("most"))


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def grouping_sets(t: Tables):
    """Grand total and totals by each dimension in one pass."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    g = t.orders.groupingSets([[], [s], [p]], s, p).agg(row_count().alias("n"), F.sum(amount(F.col("o_totalprice"))).cast("double").alias("total"))
    return g.select(F.coalesce(s, F.lit("all")).alias("status"), F.coalesce(p, F.lit("all")).alias("priority"), "n", "total")


@query("""SELECT lang, count(*) AS n, count(l.doc_id) AS resolved, CAST(round(CAST(count(l.doc_id) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def coverage_ratio(t: Tables):
    """How much has its evidence."""
    found = t.labels.select(F.col("doc_id").alias("found"))
    rows = t.documents.join(found, F.col("doc_id") == F.col("found"), "left")
    return rows.groupBy("lang").agg(row_count().alias("n"), F.count("found").alias("resolved"), ratio(F.count("found"), row_count()).cast("double").alias("coverage"))


@query("""SELECT p_brand, CAST(sum(levenshtein(p_name, p_type)) AS BIGINT) AS edits, CAST(sum(length(p_name)) AS BIGINT) AS chars, CAST(round(CAST(sum(levenshtein(p_name, p_type)) AS DECIMAL(38,12)) / sum(length(p_name)), 4) AS DOUBLE) AS rate FROM part GROUP BY 1""")
def corpus_ratio(t: Tables):
    """Edits over characters of the whole corpus."""
    e, c = F.sum(F.levenshtein("p_name", "p_type")), F.sum(F.length("p_name"))
    return t.part.groupBy("p_brand").agg(e.alias("edits"), c.alias("chars"), ratio(e, c).cast("double").alias("rate"))


@query("""WITH e(category, term) AS (VALUES ('metal', 'STEEL'), ('metal', 'TIN'), ('finish', 'BRUSHED'), ('finish', 'POLISHED')) SELECT category, count(*) AS n, CAST(round(CAST(count(*) FILTER (WHERE contains(p_type, term)) AS DECIMAL(38,12)) / count(*), 4) AS DOUBLE) AS recall FROM part JOIN e ON true GROUP BY 1""")
def recall_by_category(t: Tables):
    """Recall of named terms by category; the terms ride in an array, not a join."""
    terms = {"metal": ["STEEL", "TIN"], "finish": ["BRUSHED", "POLISHED"]}
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(v).alias("term")) for k, vs in terms.items() for v in vs])
    rows = t.part.select("p_type", F.explode(pairs).alias("e"))
    hits = F.count_if(F.contains(F.col("p_type"), F.col("e.term")))
    return rows.groupBy(F.col("e.category").alias("category")).agg(row_count().alias("n"), ratio(hits, row_count()).cast("double").alias("recall"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS false_accepts, CAST(round(CAST(count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS DECIMAL(38,12)) / NULLIF(count(*) FILTER (WHERE toxic = 1), 0), 4) AS DOUBLE) AS far, CAST(round(CAST(count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS DECIMAL(38,12)) / NULLIF(count(*) FILTER (WHERE toxic = 0), 0), 4) AS DOUBLE) AS frr FROM labels""")
def rate_gates(t: Tables):
    """False accept and reject rates."""
    x, q = F.col("toxic"), F.col("quality")
    return t.labels.agg(row_count().alias("n"), F.count_if((x == 1) & (q == 1)).alias("false_accepts"), ratio(F.count_if((x == 1) & (q == 1)), F.count_if(x == 1)).cast("double").alias("far"), ratio(F.count_if((x == 0) & (q == 0)), F.count_if(x == 0)).cast("double").alias("frr"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_totalprice < 10000) AS small FROM orders GROUP BY 1""")
def conditional_counts(t: Tables):
    """G24, M09."""
    return t.orders.groupBy("o_orderpriority").agg(row_count().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_totalprice") < 10000).alias("small"))


@query("""SELECT r_name, count(*) AS n, sha256(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey)) AS fingerprint FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def table_fingerprint(t: Tables):
    """Content hash that no order of rows changes (for groups of bounded size)."""
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat_ws(":", "n_nationkey", "n_name").alias("x"))))
    return rows.groupBy("r_name").agg(row_count().alias("n"), F.sha2(F.array_join(F.transform(items, lambda i: i["x"]), "|"), 256).alias("fingerprint"))


def scalable_fingerprint(rows, *keys: str):
    """Order-free hash of groups of any size: sums of row hashes combine before the shuffle."""
    h = F.xxhash64(*rows.columns)
    return rows.groupBy(*keys).agg(row_count().alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


@query("""SELECT o_custkey, strftime(o_orderdate, '%Y') AS year, count(*) AS n, max(o_orderkey) AS latest_key, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'same' ELSE 'changed' END AS reason FROM orders GROUP BY 1, 2 HAVING count(*) >= 2""")
def duplicate_groups(t: Tables):
    """Groups of several versions, with the latest and whether they differ."""
    g = t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("year")).agg(row_count().alias("n"), F.max("o_orderkey").alias("latest_key"), F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    return g.filter("n >= 2").select("o_custkey", "year", "n", "latest_key", F.when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("reason"))


@query("""SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS keep, count(DISTINCT source) > 1 AS cross_source FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dedupe_documents(t: Tables):
    """Copies by exact text, the row that stays and whether sources differ."""
    hashed = t.documents.select(F.sha2("text", 256).alias("text_hash"), "doc_id", "source")
    g = hashed.groupBy("text_hash").agg(row_count().alias("n"), F.min("doc_id").alias("keep"), (F.min("source") != F.max("source")).alias("cross_source"))
    return g.filter("n > 1")


@query("""WITH e(name, expected) AS (VALUES ('region', 5), ('nation', 25), ('customer', 1500)) , n AS (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer) SELECT name, n, expected = n AS ok FROM e JOIN n USING (name)""")
def count_expectations(t: Tables):
    """Table counts against what is expected."""
    expected = {"region": 5, "nation": 25, "customer": 1500}
    out = None
    for name, want in expected.items():
        row = getattr(t, name).agg(row_count().alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == want).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT event_type, min(value) AS low, median(value) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS high, CAST(round(avg(CAST(value AS DECIMAL(18,4))), 4) AS DOUBLE) AS mean FROM events GROUP BY 1""")
def elapsed_stats(t: Tables):
    """Ranks by distributed selection beside plain aggregates."""
    ranks = Standing(t.events, ["event_type"], "value").at(middle_ranks() | {"p95": nearest_rank(0.95), "p99": nearest_rank(0.99)})
    plain = t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg(value_amount()), 4).cast("double").alias("mean"))
    return plain.join(ranks, "event_type").select("event_type", "low", median().alias("p50"), "p95", "p99", "high", "mean")


@query("""SELECT l_orderkey, l_returnflag, string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS items, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2""")
def nest_collect(t: Tables):
    """Facts nested under their statement, in order."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["l_linenumber"], i["l_partkey"])), ";")
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(text.alias("items"), F.min("l_linenumber").alias("first_line"))


@query("""SELECT event_type, CAST(sum(len(json_keys(props))) AS BIGINT) AS n_keys FROM events GROUP BY 1""")
def lateral_count(t: Tables):
    """Entries of JSON maps."""
    return t.events.groupBy("event_type").agg(F.sum(F.size(F.json_object_keys("props"))).alias("n_keys"))


@query("""SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def source_order(t: Tables):
    """Tally of sources and their order of appearance."""
    return t.documents.groupBy("source").agg(row_count().alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS used, count(*) FILTER (WHERE event_type = 'click') AS reserved, sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END) + count(*) FILTER (WHERE event_type = 'click') + 10 <= 1000 AS fits FROM events GROUP BY 1""")
def ledger_balance(t: Tables):
    """Used, reserved and one more against a limit."""
    used = F.sum(F.when(F.col("event_type") == "purchase", value_amount()).otherwise(F.lit(0)))
    reserved = F.count_if(F.col("event_type") == "click")
    return t.events.groupBy("user_id").agg(used.cast("double").alias("used"), reserved.alias("reserved"), (used + reserved + 10 <= 1000).alias("fits"))


@query("""SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1""")
def salted_revenue(t: Tables):
    """A sum over three hot keys in two steps."""
    return salted_sum(t.lineitem, ["l_returnflag"], amount(F.col("l_extendedprice"))).select("l_returnflag", F.col("total").cast("double").alias("revenue"))


@query()
def question_frequency_unicode(t: Tables):
    """G07 with the Unicode form, which SQL lacks."""
    return question_groups(t.conversations.filter("role = 'user'"), question_key(F.col("text")), "conv_id")
