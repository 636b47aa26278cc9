"""Scalar goldens, rules, sources and operators on small rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import money, numeric, text
from ledgerlake.operators import alignment, core, retrieval, rules, tables
from ledgerlake.plans import governed
from ledgerlake.sources import documents, html, xbrl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "value"), [("1,234", 1234), ("(1,234)", -1234), ("1，234.5", "1234.5"), ("n/a", None), ("", None), ("(x)", None)])
def test_parse_accounting(spark, raw, value):
    got = one(spark, numeric.parse_accounting(F.lit(raw)))
    assert got == (None if value is None else Decimal(str(value)))


@pytest.mark.parametrize(("raw", "value"), [("(1,234.50)", "-1234.50"), ("HK$ 2,000 million", "2000"), ("*5 273,951", "273951"), ("△204百万円", "-204"), ("-", None), ("１，２００", "1200")])
def test_parse_printed(spark, raw, value):
    got = one(spark, numeric.parse_printed(F.lit(raw)))
    assert got == (None if value is None else Decimal(value))


def test_first_number(spark):
    assert one(spark, numeric.first_number(F.lit("about (1,016) 百万欧元"))) == Decimal(-1016)


@pytest.mark.parametrize(("unit", "scale", "currency"), [("HK$ million", 1e6, "HKD"), ("RMB thousand", 1e3, "CNY"), ("KRW 100 million", 1e8, "KRW"), ("억원", 1e8, "KRW"), ("百万円", 1e6, "JPY"), ("plain", 1.0, None), ("億円", 1e8, "JPY"), ("十亿元", 1e9, "CNY"), ("億元", 1e8, "CNY"), ("萬元", 1e4, "CNY"), ("百萬港元", 1e6, "HKD"), ("人民幣千元", 1e3, "CNY"), ("GBP million", 1e6, "GBP"), ("Swiss franc thousand", 1e3, "CHF"), ("million yen", 1e6, "JPY"), ("billion won", 1e9, "KRW"), ("천원", 1e3, "KRW"), ("£", 1.0, "GBP")])
def test_units(spark, unit, scale, currency):
    assert one(spark, money.scale_of(F.lit(unit))) == scale and one(spark, money.currency_of(F.lit(unit))) == currency


def test_growth_policies(spark):
    assert one(spark, numeric.yoy(F.lit(5), F.lit(-10))) is None
    assert one(spark, numeric.yoy(F.lit(5), F.lit(-10), negative_base=True)) == 1.5
    assert one(spark, numeric.yoy(F.lit(5), F.lit(0))) is None
    assert one(spark, numeric.cagr(F.lit(100.0), F.lit(121.0), F.lit(2))) == pytest.approx(0.1)
    assert one(spark, numeric.cagr(F.lit(-1.0), F.lit(121.0), F.lit(2))) is None


def test_text(spark):
    assert one(spark, text.question_key(F.lit("  Ｗhat  IS it？ "))) == "what is it"
    assert one(spark, text.cjk_bigrams(F.lit("Net 净利润 表"))) == ["net", "净利", "利润", "表"]
    assert one(spark, text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"]
    assert one(spark, text.redacted(F.lit("https://u:p@h/x?token=abc&y=1"))) == "https://***@h/x?token=***&y=1"
    assert one(spark, text.html_text(F.lit("<style>x</style><p>a &amp; b</p><p>c</p>"))) == "a & b\nc"
    assert one(spark, documents.fenced_json(F.lit('x\n```json\n{"a": 1}\n```\n'))) == '{"a": 1}'


def test_bridges(spark):
    item = "k int, total_assets decimal(38,6), total_liabilities decimal(38,6), total_equity decimal(38,6), liabilities_and_equity decimal(38,6), revenue decimal(38,6), cost_of_sales decimal(38,6), gross_profit decimal(38,6)"
    d = Decimal
    rows = spark.createDataFrame([(1, d(1000), d(600), d(400), d(1000), d(3900), d(3000), d(900)), (2, d(1000), d(600), d(300), d(1000), None, None, None), (3, d(1000), d(600), d(300), d(900), None, None, None), (4, d(1000), None, d(400), None, None, None, None)], item)
    got = {(r["k"], r["rule_id"]): r["status"] for r in rules.checked(rows, ["k"]).collect()}
    assert [got[k, "balance"] for k in (1, 2, 3, 4)] == ["pass", "warning", "fail", "warning"]
    assert got[1, "gross_profit"] == "pass" and got[2, "gross_profit"] == "skipped" and got[1, "cash_end"] == "skipped"


def test_gate_enforcement():
    assert rules.enforce("allow") == "allowed" and rules.enforce("review", force=True, requester="a", reason="b") == "forced"
    for bad in ({"decision": "block"}, {"decision": "review"}, {"decision": "review", "force": True}, {"decision": "review", "hard": True, "force": True, "requester": "a", "reason": "b"}):
        with pytest.raises(PermissionError):
            rules.enforce(**bad)
    with pytest.raises(ValueError):
        rules.enforce("allow", force=True)


def test_upsert_prefers_the_newest_and_the_change_on_ties(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 9, "c")], "k int, v int, x string")
    changes = spark.createDataFrame([(1, 6, "A"), (2, 5, "B"), (3, 1, "C"), (4, 1, "D")], "k int, v int, x string")
    assert sorted(r["x"] for r in core.upsert(base, changes, ["k"], "v").collect()) == ["A", "B", "D", "c"]


def test_interval_overlap_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 1000), (1, 5, 6)], "k int, lo long, hi long")
    b = spark.createDataFrame([(1, 500, 2000), (1, 6, 7), (2, 0, 9)], "k int, lo long, hi long")
    assert core.interval_overlap(a, b, "k", 100).count() == 2


def test_chunks_cover_the_text():
    text_in = "\n".join(f"paragraph {i} " + "x" * (i * 37 % 1300) for i in range(40))
    chunks = retrieval.paragraph_chunks(text_in)
    assert all(0 < len(c) <= 900 for c in chunks) and all(p.strip()[:20] in "".join(chunks) for p in text_in.split("\n"))
    assert retrieval.paragraph_chunks(None) == [] == retrieval.paragraph_chunks(" \n ")


def test_rank_fusion_lifts_the_lexical_winner(spark):
    dense = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, dense_rank int")
    lexical = spark.createDataFrame([("c", 1)], "k string, lexical_rank int")
    assert retrieval.fused(dense, lexical, "k").orderBy(F.col("score").desc()).first()["k"] == "c"


def test_html_tables():
    cells = html.cells_of('<table><tr><th colspan=2>H</th></tr><tr><td rowspan=2>a</td><td>1 &amp; 2</td></tr><tr><td>3</td></tr></table>')
    assert cells == [(0, 0, 0, True, "H"), (0, 0, 1, True, "H"), (0, 1, 0, False, "a"), (0, 1, 1, False, "1 & 2"), (0, 2, 0, False, "a"), (0, 2, 1, False, "3")]
    assert html.cells_of(None) == [] and html.distinct_headers(["a", "", "a"]) == ["a", "column_2", "a_2"]


def test_table_facts(spark):
    grid = [["RMB million", "2024", "2023"], ["Revenue", "1,200", "(30)"], ["", "5", "6"], ["Cost", "n/a", "7"]]
    cells = spark.createDataFrame([("t", r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)], "t string, row int, col int, text string")
    got = {(r["label"], r["period"]): (float(r["value"]), r["currency"]) for r in tables.table_facts(cells, ["t"]).collect()}
    assert got == {("Revenue", "2024"): (1.2e9, "CNY"), ("Revenue", "2023"): (-3e7, "CNY"), ("Cost", "2023"): (7e6, "CNY")}


def test_logical_tables(spark):
    rows = [("d", 1, 0, 3, "H", "a"), ("d", 2, 0, 3, None, "b"), ("d", 2, 1, 3, "H2", "c"), ("d", 5, 0, 3, None, "e")]
    got = [(r["fragments"], r["markdown"]) for r in tables.logical_tables(spark.createDataFrame(rows, "doc string, page int, ordinal int, n_columns int, header string, markdown string"), "doc").orderBy("logical").collect()]
    assert got == [(2, "a\nb"), (1, "c"), (1, "e")]


def test_xbrl(spark):
    xml = """<x xmlns:d="u"><context id="c1"><entity/><period><instant>2024-12-31</instant></period><segment><d:explicitMember dimension="ax">m</d:explicitMember></segment></context>
    <unit id="u1"><divide><unitNumerator><measure>USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit><d:Assets contextRef="c1" unitRef="u1" decimals="0">1000</d:Assets><d:Lost contextRef="c9">x</d:Lost></x>"""
    got = {r["concept"]: r for r in xbrl.facts(spark.createDataFrame([("f", xml), ("bad", "<x"), ("none", None)], "filing_id string, xml string")).collect()}
    assert got["Assets"]["value"] == 1000 and got["Assets"]["instant"] == "2024-12-31" and got["Assets"]["dims"] == {"ax": "m"} and got["Assets"]["unit"] == "USD/shares"
    assert got["Lost"]["value"] is None and got["Lost"]["instant"] is None and len(got) == 2


def test_diarisation(spark):
    turns = spark.createDataFrame([("r", "ref", "A", 0.0, 10.0), ("r", "ref", "B", 10.0, 20.0), ("r", "hyp", "x", 0.0, 12.0), ("r", "hyp", "y", 12.0, 18.0), ("r", "hyp", "z", 25.0, 26.0)], "recording string, side string, speaker string, lo double, hi double")
    r = alignment.diarisation_errors(turns).first()
    assert (r["missed"], r["false_alarm"], r["confusion"], r["total"]) == (2.0, 1.0, 2.0, 20.0)


def test_diff_steps(spark):
    assert [tuple(s) for s in one(spark, alignment.diff_steps(F.lit("a b c"), F.lit("a x c d")))] == [("replace", 1, 2, 1, 2), ("insert", 3, 3, 3, 4)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "in" / "m" / "a").mkdir(parents=True)
    (tmp_path / "in" / "m" / "a" / "document_full.json").write_text('{\n"market": "hk"}')
    got = documents.json_documents(spark, str(tmp_path / "in"), spark.range(0).selectExpr("'' AS market").schema).collect()
    assert [r["market"] for r in got] == ["hk"] and documents.file_hashes(spark, str(tmp_path / "in")).count() == 1
    (tmp_path / "l.ndjson").write_text('{"a": 1}\n{oops\n\n{"a": 2}\n')
    good, bad = documents.json_lines(spark, str(tmp_path / "l.ndjson"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["{oops"]


def test_replacing_a_run_twice_changes_nothing_else(spark, tmp_path):
    path = str(tmp_path / "facts")
    documents.replace_runs(spark.createDataFrame([(1, "r1"), (2, "r2")], "v int, parse_run_id string"), path)
    for _ in range(2):
        documents.replace_runs(spark.createDataFrame([(3, "r1")], "v int, parse_run_id string"), path)
    assert sorted((r["v"], r["parse_run_id"]) for r in spark.read.parquet(path).collect()) == [(2, "r2"), (3, "r1")]


def test_company_facts(spark):
    schema = "id string, facts map<string, map<string, struct<label: string, units: map<string, array<struct<val: decimal(38,6), fy: int>>>>>>"
    rows = spark.createDataFrame([("f", {"us-gaap": {"Assets": ("Assets", {"USD": [(Decimal(1), 2024), (Decimal(2), 2023)]})}})], schema)
    assert sorted((r["concept"], r["unit"], r["fy"]) for r in documents.company_facts(rows, "id", "facts").collect()) == [("Assets", "USD", 2023), ("Assets", "USD", 2024)]


def test_governed_sql(spark):
    t = {"facts": spark.range(1000)}
    assert governed.governed_sql(spark, "SELECT id FROM facts", t).count() == 100
    assert governed.governed_sql(spark, "WITH x AS (SELECT id FROM facts WHERE id < 3) SELECT * FROM x", t, limit=9999).count() == 3
    assert governed.governed_sql(spark, "SELECT 'delete; drop table' AS x, (SELECT max(id) FROM facts) AS m", t).first()["m"] == 999
    for sql, code in [("SELECT 1; SELECT 2", "invalid_sql"), ("DROP TABLE facts", "not_read_only"), ("INSERT INTO facts SELECT 1", "not_read_only"), ("SELECT * FROM secret", "relation_not_allowed"), ("SELECT * FROM facts, `other`.`secret`", "relation_not_allowed"), ("SELECT * FROM facts WHERE id IN (SELECT id FROM secret)", "relation_not_allowed"), ("SELECT (SELECT max(id) FROM secret)", "relation_not_allowed"), ("WITH x AS (SELECT * FROM secret) SELECT * FROM x", "relation_not_allowed"), ("selec", "invalid_sql")]:
        with pytest.raises(governed.PolicyError) as e:
            governed.governed_sql(spark, sql, t)
        assert e.value.code == code, sql
    for sql in ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM facts", "SELECT reflect('java.lang.System', 'getenv') FROM facts", "SELECT try_reflect('java.lang.System', 'getenv')", "SELECT * FROM range(5)", "SELECT input_file_name() FROM facts", "SELECT * FROM facts WHERE id IN (SELECT explode(array(reflect('a', 'b'))))", "SELECT * FROM facts LATERAL VIEW stack(1, 2) AS x"):
        with pytest.raises(governed.PolicyError) as e:
            governed.governed_sql(spark, sql, t)
        assert e.value.code == "function_not_allowed", sql
    with pytest.raises(governed.PolicyError) as e:
        governed.governed_sql(spark, "SELECT * FROM parquet.`/root`", t)
    assert e.value.code == "relation_not_allowed" and not spark.catalog.tableExists("facts")
    rows = governed.governed_sql(spark, "SELECT id % 2 AS k, count(*) AS n, row_number() OVER (ORDER BY id % 2) AS r FROM facts GROUP BY id % 2 HAVING count(*) > 1 ORDER BY k LIMIT 5", t)
    assert [tuple(r) for r in rows.collect()] == [(0, 500, 1), (1, 500, 2)]


def refused(spark, sql, tables):
    with pytest.raises(governed.PolicyError) as e:
        governed.governed_sql(spark, sql, tables)
    return e.value.code


def test_governed_names_have_scopes(spark):
    t = {"d": spark.range(5), "e": spark.range(3)}
    spark.range(7).createOrReplaceTempView("secret")
    spark.range(70).createOrReplaceTempView("d")
    try:
        for sql in (
            "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
            "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS y) SELECT * FROM a",
            "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret), secret",
            "SELECT * FROM d WHERE id IN (WITH secret AS (SELECT 1 AS id) SELECT id FROM secret) AND id IN (SELECT id FROM secret)",
            "WITH x AS (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) SELECT * FROM x JOIN secret USING (id)",
            "SELECT * FROM SECRET",
            "WITH secret AS (SELECT 1 AS id) SELECT * FROM default.secret",
            "SELECT 1) UNION ALL (SELECT * FROM secret",
        ):
            assert refused(spark, sql, t) in ("relation_not_allowed", "invalid_sql"), sql
        # A name of the query's own may hide one that exists outside, and one that is allowed.
        ok = lambda sql: sorted(tuple(r) for r in governed.governed_sql(spark, sql, t).collect())
        assert ok("WITH secret AS (SELECT id FROM d WHERE id > 3) SELECT * FROM secret") == [(4,)]
        assert ok("WITH d AS (SELECT id FROM d WHERE id > 2) SELECT * FROM d") == [(3,), (4,)]
        assert ok("WITH e AS (SELECT 9 AS id), f AS (SELECT * FROM e) SELECT * FROM f") == [(9,)]
        assert ok("WITH x AS (SELECT 1 AS id) SELECT id FROM d WHERE id IN (SELECT id FROM X)") == [(1,)]
        assert ok("SELECT max(id) FROM d -- the end") == [(4,)]
        assert ok("SELECT max(id) FROM D ;") == [(4,)]
        # The session's own views are as they were.
        assert spark.table("d").count() == 70 and spark.table("secret").count() == 7
        assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("governed_")]
    finally:
        spark.catalog.dropTempView("secret")
        spark.catalog.dropTempView("d")


def test_governed_sizes(spark):
    t = {"d": spark.range(5)}
    for sql in ("SELECT repeat('x', 100000000) FROM d", "SELECT repeat('x', id) FROM d", "SELECT explode(sequence(1, 1000000000)) FROM d", "SELECT explode(sequence(0, id)) FROM d", "SELECT lpad('x', 1 + 1000000) FROM d", "SELECT * FROM d LATERAL VIEW explode(sequence(1, 1000000)) AS x"):
        assert refused(spark, sql, t) == "unbounded_function", sql
    assert governed.governed_sql(spark, "SELECT repeat('x', 3) AS x, size(sequence(-5, 5)) AS n, size(sequence(100000, 0, -1000)) AS m FROM d LIMIT 1", t).first() == ("xxx", 11, 101)


@pytest.mark.parametrize(("raw", "calculator", "importer", "verifier", "lookup"), [
    ("1,234.5", "1234.5", "1234.5", "1234.5", 1234.5), ("(1,234)", "-1234", "-1234", "-1234", -1234.0), ("HK$ 20 million", "20", None, "20", None), ("−5", "-5", None, "-5", None), ("12%", "12", "12", "12", None), ("n/a", None, None, None, None),
    ("see (7) there", "-7", None, None, None), ("1e3", "1", None, None, 1000.0), ("", None, None, None, None), ("--", None, None, None, None), (None, None, None, None, None), ("(-5)", "-5", "5", "-5", 5.0), ("5.", "5", "5", "5", 5.0),
])
def test_number_variants(spark, raw, calculator, importer, verifier, lookup):
    df = spark.createDataFrame([(raw,)], "t string")
    dec = lambda v: None if v is None else Decimal(v)
    got = df.select(numeric.calculator_number(F.col("t")), numeric.importer_number(F.col("t")), numeric.verifier_number(F.col("t")), numeric.lookup_number(F.col("t"))).first()
    assert tuple(got) == (dec(calculator), dec(importer), dec(verifier), lookup)


def test_sql_texts(spark):
    sql = F.lit("select ';' /* ; a */ from t -- x ; y\n; ; drop 'it''s; --'")
    assert one(spark, text.statements(sql)) == ["select ';'   from t", "drop 'it''s; --'"]
    assert one(spark, text.without_literals(sql)) == "select ''   from t  \n; ; drop ''"
    assert one(spark, text.statements(F.lit(None).cast("string"))) is None
