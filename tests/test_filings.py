"""Pages as nodes, runs replaced in one commit, peers, labels and currencies on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import labels, markets
from ledgerlake.operators.peers import peers
from ledgerlake.operators.ranks import Standing, median, middle_ranks, nearest_rank, rounded_rank
from ledgerlake.operators.retrieval import nearest, reranked
from ledgerlake.sources import dom
from ledgerlake.sources.versions import Conflict, VersionedRuns

PAGE = """<html><body><p>before</p><h1 id="top">One <b>two</b></h1><p>a<p>b <i>c</i> d<ul><li>x<li>y <a href=#>z</a></ul>
<h2>Part</h2><table><tr><th>Item<td>Value<tr><td>Cash<td><ix:nonFraction name="us:Cash">12</ix:nonFraction></table>
<h3>Deep</h3><p>in three</p><h2>Next</h2><p>last<script>var x = "<p>no</p>"</script></span></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    pages = [(1, PAGE), (2, ""), (3, None), (None, PAGE), (4, "no tags"), (5, "<p>one<br>two</p></div>")]
    return dom.dom_nodes(spark.createDataFrame(pages, "page_id long, html string"))


def test_dom_nodes_are_intervals(nodes):
    rows = {r["pre"]: r for r in nodes.filter("page_id = 1").collect()}
    assert sorted(rows) == list(range(len(rows)))
    for r in rows.values():
        assert r["pre"] <= r["last"]
        if r["parent"] is not None:
            up = rows[r["parent"]]
            assert up["pre"] < r["pre"] <= r["last"] <= up["last"] and up["depth"] + 1 == r["depth"]
    elements = [r for _, r in sorted(rows.items()) if r["tag"] != dom.TEXT]
    tags = [r["tag"] for r in elements]
    assert tags == "html body p h1 b p p i ul li li a h2 table tr th td tr td td ix:nonfraction h3 p h2 p script".split()
    # Paragraphs, items and cells that the page leaves open end where the next one starts.
    within = {"p": "body", "li": "ul", "td": "tr", "th": "tr", "tr": "table"}
    assert all(rows[r["parent"]]["tag"] == within[r["tag"]] for r in elements if r["tag"] in within)
    assert next(r["anchor"] for r in elements if r["tag"] == "h1") == "top" and not any("no" in (r["text"] or "") for r in rows.values())
    assert [(r["tag"], r["text"]) for r in nodes.filter("page_id = 5").orderBy("pre").collect()] == [("p", None), (dom.TEXT, "one"), ("br", None), (dom.TEXT, "two")]
    assert nodes.filter("page_id IN (2, 3, 4) OR page_id IS NULL").count() == 0


def test_dom_sections_blocks_facts_and_relations(nodes):
    found = dom.sections(nodes).orderBy("section").collect()
    assert [(r["section"], r["level"], r["heading"]) for r in found] == [(0, 1, "One two"), (1, 2, "Part"), (2, 3, "Deep"), (3, 2, "Next")]
    end = nodes.filter("page_id = 1").count() - 1
    assert found[0]["until"] == found[3]["until"] == end and found[1]["until"] == found[3]["pre"] - 1 and found[2]["until"] == found[3]["pre"] - 1
    blocks = dom.blocks(nodes).filter("page_id = 1").orderBy("block").collect()
    assert [(r["tag"], r["text"], r["section"]) for r in blocks] == [
        ("p", "before", None), ("h1", "One two", 0), ("p", "a", 0), ("p", "b c d", 0), ("li", "x", 0), ("li", "y z", 0), ("h2", "Part", 1), ("table", "Item Value Cash 12", 1), ("h3", "Deep", 2), ("p", "in three", 2), ("h2", "Next", 3), ("p", "last", 3),
    ]
    table = next(r["pre"] for r in blocks if r["tag"] == "table")
    fact = nodes.filter("tag = 'ix:nonfraction'").first()["pre"]
    assert [tuple(r) for r in dom.facts(nodes).collect()] == [(1, fact, "us:Cash", "12", table)]
    kinds = [(r["kind"], r["from_pre"], r["to_pre"]) for r in dom.relations(nodes).collect()]
    assert ("table_fact", table, fact) in kinds and ("section_block", found[1]["pre"], table) in kinds and sum(k == "section_block" for k, *_ in kinds) == 7


RUNS = "parse_run_id string, x int"


def test_a_run_is_replaced_in_all_tables_at_once(spark, tmp_path):
    store = VersionedRuns(spark, str(tmp_path / "runs"))
    df = lambda *rows: spark.createDataFrame(list(rows), RUNS)
    rows = lambda name, version=None: sorted(tuple(r) for r in store.read(name, version).collect())
    assert store.version() == 0 and store.obsolete().collect() == []
    assert store.replace({"a": df(("r1", 1), ("r2", 2)), "b": df(("r1", 10), ("r2", 20))}) == 1
    assert store.replace({"a": df(("r1", 3))}) == 2
    assert rows("a") == [("r1", 3), ("r2", 2)] and rows("b") == [("r2", 20)]
    assert rows("a", 1) == [("r1", 1), ("r2", 2)] and rows("b", 1) == [("r1", 10), ("r2", 20)]

    # A failure between two tables leaves the version before whole.
    broken = df(("r2", 99)).withColumn("x", F.assert_true(F.lit(False)).cast("int"))
    with pytest.raises(Exception):
        store.replace({"a": df(("r2", 98)), "b": broken})
    assert store.version() == 2 and rows("a") == [("r1", 3), ("r2", 2)] and rows("b") == [("r2", 20)]

    # Two writers of the same number: the second takes the next one.
    real, seen = store.version, []
    store.version = lambda: 1 if not seen and not seen.append(1) else real()
    assert store.replace({"b": df(("r1", 5), ("r1", 5))}) == 3
    store.version = real
    assert rows("a") == [("r2", 2)] and rows("b") == [("r1", 5), ("r1", 5), ("r2", 20)]
    assert store.replace({}, df(("r2", 0)).select("parse_run_id")) == 4 and rows("a") == [] and store.obsolete().count() == 2
    store.version = lambda: 0
    with pytest.raises(Conflict):
        store.replace({"a": df(("r9", 1))})


def test_peers_against_plain_loops(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "b", None, "c"]), r.choice(["x", "y", None]), r.choice(["m", None]), r.random() < 0.3, r.random() < 0.8) for i in range(80)]
    rows += [(100 + i, None, None, None, i % 2 == 0, True) for i in range(6)] + [(200, "rare", None, None, False, True), (201, "rarer", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, sw3 string, sw2 string, sw1 string, kw boolean, ok boolean")
    for least in (1, 3, 30, 500):
        got = {}
        for x in peers(df, "id", ["sw3", "sw2", "sw1"], F.col("ok"), F.col("kw"), least).orderBy("nth").collect():
            got.setdefault((x["id"], x["level"], x["status"], x["n_peers"]), []).append(x["peer"])
        expected = {}
        for i, *values, kw, _ in rows:
            ready = [x for x in rows if x[5] and x[0] != i]
            options = [(c, [x[0] for x in ready if x[1 + n] == v]) for n, (c, v) in enumerate(zip(("sw3", "sw2", "sw1"), values)) if v is not None]
            enough = [o for o in options if len(o[1]) >= least]
            if enough:
                level, found, status = *enough[0], "ready"
            elif options:
                level, found, status = *max(options, key=lambda o: len(o[1])), "below_minimum"
            elif kw:
                level, found, status = "keyword", [x[0] for x in ready if x[4]], "review"
            else:
                level, found, status = "all", [x[0] for x in ready], "review"
            expected[i, level, status, len(found)] = found[:least] or [None]
        assert got == expected


@pytest.mark.parametrize(("label", "item"), [
    ("Revenue", "operating_revenue"), ("Total revenues, net", "operating_revenue"), ("Other income and gains", None), ("Interest income", None), ("Basic earnings per share", "basic_eps"), ("Net profit per share", None),
    ("Adjusted net profit", None), ("Adjusted net income", None), ("Non-GAAP net income", None), ("Profit for the year", "net_profit"), ("Total comprehensive income: profit for the year", None), ("Cost of sales of revenue", "cost_of_sales"),
    ("Net assets", "total_equity"), ("Net assets attributable to owners", None), ("Average total assets", None), ("Total assets less current liabilities", None), ("營業收入", "operating_revenue"), ("其他收入", None), ("", None), (None, None), ("Profit before income tax expense", "total_profit"),
])
def test_labels(spark, label, item):
    assert spark.createDataFrame([(label,)], "l string").select(labels.canonical_item(F.col("l"))).first()[0] == item


def test_hk_currency_precedence(spark):
    filings = spark.createDataFrame([(1, "USD"), (2, "USD"), (3, None), (4, "rmb"), (5, None)], "filing_id long, currency string")
    statements = spark.createDataFrame([(1, 1, "HK$ million", None, None, None), (1, 2, None, "Balance sheet", None, "EUR"), (2, 1, "HK$", None, None, None), (2, 2, None, "in RMB", None, None), (3, 1, None, None, None, None)], "filing_id long, statement_id int, unit string, title string, name string, currency string")
    items = spark.createDataFrame([(1, 1, None, None, 1), (1, 2, None, None, 2), (1, 9, None, None, 3), (1, 2, "GBP", "EUR", 4), (2, 1, None, None, 1), (2, 9, None, None, 2), (3, 1, None, None, 1), (3, 1, None, "chf", 2), (3, 1, "JPY million", None, 3), (4, 1, None, None, 1), (5, 1, None, None, 1)], "filing_id long, statement_id int, unit string, currency string, ordinal int")
    got = {(r["filing_id"], r["ordinal"]): (r["reporting_currency"], r["fact_currency"]) for r in markets.hk_currencies(filings, statements, items).collect()}
    assert got == {
        (1, 1): ("HKD", "HKD"), (1, 2): ("HKD", "EUR"), (1, 3): ("HKD", "HKD"), (1, 4): ("HKD", "GBP"), (2, 1): ("USD", "HKD"), (2, 2): ("USD", "USD"),
        (3, 1): ("CHF", "CHF"), (3, 2): ("CHF", "CHF"), (3, 3): ("CHF", "JPY"), (4, 1): ("CNY", "CNY"), (5, 1): (None, None),
    }


def test_ranks_against_sorted_lists(spark):
    """A hot group, a null one, ties, nulls and a group of one."""
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, -0.5, 3.0, r.random(), r.random()])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    standing = Standing(df, ["g"], "x")
    got = {x["g"]: x for x in standing.at(middle_ranks() | {"p95": nearest_rank(0.95), "p9": rounded_rank(0.9)}).withColumn("median", median()).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        n = len(values)
        assert got[g]["median"] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2)
        assert got[g]["p95"] == values[max(0, -(-95 * n // 100) - 1)] and got[g]["p9"] == values[round((n - 1) * 0.9)]
    for x in standing.upto().collect():
        assert x["upto"] == sum(v <= x["x"] for v in groups[x["g"]]) and x["n"] == len(groups[x["g"]])


def test_nearest_in_blocks_against_brute_force(spark):
    r = random.Random(9)
    vectors = [(i, [r.choice([0.0, 0.5, 1.0, r.random()]) for _ in range(3 if i % 10 else 2)] if i % 17 else None, r.choice("ab")) for i in range(150)] + [(5, [1.0, 1.0, 1.0], "a")]
    v = spark.createDataFrame(vectors, "vec_id long, v array<double>, g string")
    q = v.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "g")
    for group in (None, "g"):
        got = sorted(tuple(x) for x in nearest(q, v, 4, group, vector_block=20, query_block=5).select("query_id", "vec_id", "score", "rn").collect())
        expected = []
        for i, a, g in vectors:
            if i % 7 or a is None:
                continue
            scored = [(-round(sum(x * y for x, y in zip(a, b)) + 1e-12, 4), j) for j, b, h in vectors if j != i and b is not None and len(b) == len(a) and (group is None or g == h)]
            expected += [(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(scored)[:4])]
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(expected)]
        assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in sorted(expected)], abs=2e-4)
    plan = nearest(q, v, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rerank_falls_back_on_a_clients_errors_alone(spark):
    hits = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "text string, score double")
    failed = spark.sparkContext.accumulator(0)

    def unreachable(query, texts):
        raise ConnectionError("no route")

    def faulty(query, texts):
        raise ZeroDivisionError

    assert [r["score"] for r in reranked(hits, "q", unreachable, failures=failed).collect()] == [1.0, 2.0] and failed.value == 2
    assert [r["score"] for r in reranked(hits, "q", lambda q, t: [5.0] * len(t)).collect()] == [5.0, 5.0]
    with pytest.raises(Exception, match="ZeroDivision"):
        reranked(hits, "q", faulty).collect()
