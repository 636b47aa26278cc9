"""Schemas, layouts, hooks and the time limit."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import markets, retrieval
from ledgerlake.plans import governed
from ledgerlake.sources import layout, schema, sinks


def test_bootstrap_and_latest_runs(spark, tmp_path):
    runs = [("r1", "f", "pass", None), ("r2", "f", "completed", "2024-01-02"), ("r3", "f", "failed", "2024-02-01"), ("r4", "f", "warning", "2024-01-02"), ("r5", "g", "pass", None)]
    rows = spark.createDataFrame(runs, "parse_run_id string, filing_id string, status string, completed_at string")
    rows.withColumn("completed_at", F.to_timestamp("completed_at")).write.parquet(str(tmp_path / "parse_runs"))
    assert set(schema.bootstrap(spark, str(tmp_path))) == set(schema.ENTITIES)
    assert {r["filing_id"]: r["parse_run_id"] for r in spark.table("latest_parse_runs").collect()} == {"f": "r4", "g": "r5"}
    assert spark.table("companies").count() == 0


def test_layout(spark):
    items = "id int, items array<struct<type: string, text: string, page_idx: int, bbox: array<double>>>"
    rows = spark.createDataFrame([(1, [("text", "a", 0, [1.0, 2.0, 3.0, 4.0]), ("table", "b", 1, [1.0])])], items)
    got = layout.layout_blocks(rows, "id", "items").orderBy("ordinal").collect()
    assert [(r["kind"], r["page_number"], r["bbox"]) for r in got] == [("text", 1, [1.0, 2.0, 3.0, 4.0]), ("table", 2, None)]
    pages = spark.createDataFrame([(1, "<h1>Risk</h1><p>one</p><p>two</p><h2 class=x>Cash</h2><p>three</p>")], "id int, html string")
    got = layout.html_sections(pages, "id", "html").orderBy("ordinal").collect()
    assert [(r["level"], r["text"], r["section"]) for r in got] == [(1, "Risk", "Risk"), (None, "one", "Risk"), (None, "two", "Risk"), (2, "Cash", "Cash"), (None, "three", "Cash")]


def test_hooks(spark):
    rows = spark.createDataFrame([("ab", 1.0), (None, 2.0)], "text string, score double")
    got = retrieval.embedded(rows, lambda texts: [[float(len(t)), 0.0] for t in texts], 2).orderBy("score").collect()
    assert [r["embedding"] for r in got] == [[1.0, 0.0], [0.0, 0.0]]

    def fails(query, texts):
        raise OSError

    assert [r["score"] for r in retrieval.reranked(rows, "q", fails).orderBy("score").collect()] == [1.0, 2.0]
    assert {r["score"] for r in retrieval.reranked(rows, "q", lambda q, t: [7.0] * len(t)).collect()} == {7.0}


def test_time_limit(spark):
    def slow(batches):
        for b in batches:
            time.sleep(8)
            yield b

    assert len(governed.rows_within(spark.range(5))) == 5
    with pytest.raises(governed.PolicyError) as e:
        governed.rows_within(spark.range(5).mapInPandas(slow, "id long"), 500)
    assert e.value.code == "timeout"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (None, "ü")], "id int, text string")
    sinks.write_json_lines(rows, str(tmp_path / "lines"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted(lines) == ['{"id":1,"text":"a b"}', '{"id":2,"text":null}', '{"id":null,"text":"ü"}']
    got = sinks.embedded(spark.range(70).selectExpr("CAST(id AS STRING) AS text").coalesce(1), lambda texts: [[float(len(texts)), float(t)] for t in texts])
    got = {int(r["embedding"][1]): int(r["embedding"][0]) for r in got.collect()}
    assert got == {i: 32 if i < 64 else 6 for i in range(70)}
    new = spark.createDataFrame([(2, "two"), (3, "three"), (None, "none")], "id int, text string")
    assert {(r["id"], r["text"]) for r in sinks.upserted(rows, new, ["id"]).collect()} == {(1, "a b"), (2, "two"), (3, "three"), (None, "none")}


def test_market_rules(spark):
    cases = [
        ("HK", None, "700.HK", "HK:00700"), ("HK", None, "HK0005", "HK:00005"), ("HK", "hk:fixture:1", "700", "hk:fixture:1"), ("HK", None, "abc", "HK:ABC"), ("HK", "kept", " ", "kept"),
        ("JP", None, "E02144", "JP:E02144"), ("KR", "old", None, "old"), ("US", None, "320193", "US:CIK0000320193"), ("EU", None, "lei9", "EU:DE:SAP:lei9"), ("EU", "EU:FIXTURE:2", "lei9", "EU:FIXTURE:2"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, market string, current string, code string, expected string")
    made = markets.company_id(F.col("market"), F.col("current"), F.col("code"), F.lit("de"), F.lit("sap"))
    assert [r["made"] for r in rows.select("i", made.alias("made")).orderBy("i").collect()] == [c[3] for c in cases]
    concepts = [("us-gaap:Assets", "balance_sheet"), ("GrossProfit", "income_statement"), ("NetCashProvidedByUsedInOperatingActivities", "cash_flow_statement"), ("EntityName", "as is"), (None, "as is")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(concepts)], "i int, concept string, expected string")
    assert [r["s"] for r in rows.select("i", markets.us_statement(F.col("concept"), F.lit("as is")).alias("s")).orderBy("i").collect()] == [c[1] for c in concepts]
    one = spark.createDataFrame([("JP", None, None, None), ("EU", "chf", None, None), ("EU", None, "US$ million", "gbp"), ("EU", None, None, None)], "m string, stated string, unit string, own string")
    reporting = markets.reporting_currency(F.col("m"), F.col("stated"))
    assert [r[0] for r in one.select(markets.fact_currency(F.col("own"), F.col("unit"), reporting)).collect()] == ["JPY", "CHF", "gbp", None]


XBRL = """<x:xbrl xmlns:x="http://www.xbrl.org/2003/instance" xmlns:j="http://disclosure.edinet-fsa.go.jp/taxonomy/jppfs">
<x:context id="c"><x:entity><x:segment><d:explicitMember xmlns:d="d" dimension="axis">m</d:explicitMember></x:segment></x:entity><x:period><x:instant>2024-03-31</x:instant></x:period></x:context>
<x:unit id="u"><x:measure>iso4217:JPY</x:measure></x:unit><j:Cash contextRef="c" unitRef="u">1,500</j:Cash><j:Name contextRef="c">text</j:Name><j:Lost contextRef="none" unitRef="none">(2)</j:Lost></x:xbrl>"""
INLINE = """<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><p><ix:nonFraction name="ifrs-full:Revenue" contextRef="q" scale="6" sign="-" unitRef="e">1,2<b>34</b></ix:nonFraction></p></html>"""


def test_filing_facts_of_every_format(spark, tmp_path):
    import io
    import zipfile

    from ledgerlake.sources import packages

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("PublicDoc/a.xbrl", XBRL)
        z.writestr("readme.txt", "none")
    files = {"JP/f1/doc.zip": packed.getvalue(), "EU/f2/r.xhtml": INLINE.encode(), "KR/f3/api.json": b'{"list": [{"account_id": "Cash", "account_nm": "n", "thstrm_amount": "7"}, {"account_id": "No", "thstrm_amount": "-"}, {"thstrm_amount": "1"}]}', "US/f4/facts.json": b'{"facts": [{"concept": "us-gaap:Cash", "value": 5, "unit": "USD", "dimensions": {"a": 1}}]}'}
    files |= {"US/bad/x.xml": b"<no", "US/bad/y.json": b"{", "US/bad/z.zip": b"PK", "US/_hidden/a.json": b'{"facts": [{"concept": "c", "value": 1}]}', "US/stray.json": b"{}", "US/f5/big.json": b'{"facts": [{"concept": "c", "value": "1e40"}, {"concept": "d", "value": "NaN"}]}'}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for split in (1, 1 << 20):
        got = {(r["filing_id"], r["concept"]): r for r in packages.filing_facts(spark, str(tmp_path), split).collect()}
        assert set(got) == {("f1", "jppfs:Cash"), ("f1", "jppfs:Lost"), ("f2", "ifrs-full:Revenue"), ("f3", "dart:Cash"), ("f4", "us-gaap:Cash")}
        cash, lost, revenue, row, fact = (got[k] for k in sorted(got))
        assert (cash["value"], cash["unit"], cash["instant"], cash["dims"], cash["source_file"], cash["market"]) == (1500, "iso4217:JPY", "2024-03-31", {"axis": "m"}, "PublicDoc/a.xbrl", "JP")
        assert (lost["value"], lost["unit"], lost["instant"]) == (-2, "none", None) and (revenue["value"], revenue["source_type"], revenue["label"]) == (-1234000000, "inline_xbrl", "Revenue")
        assert (row["value"], row["unit"], row["source_type"]) == (7, "KRW", "account_row") and (fact["value"], fact["dims"]) == (5, {"a": "1"})


def test_many_filings_take_few_files(spark, tmp_path, monkeypatch):
    """filing_imports of 2,000 customers: archives by tasks and markets, not a file a filing."""
    from ledgerlake.plans import filings, registry

    path = tmp_path / "filings"
    monkeypatch.setattr(filings, "scratch", lambda spark, label: f"file://{path}")
    orders = spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 2000).alias("o_custkey"), (F.col("id") + 0.25).alias("o_totalprice"), F.lit("2024-03-31").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "in" / "orders.parquet"))
    got = registry.queries()["filing_imports"](spark, str(tmp_path / "in")).collect()
    assert len(got) == 4000 == len({(r["filing_id"], r["concept"]) for r in got}) and {r["market"] for r in got} == {"US", "JP", "KR", "EU"}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = [p for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert 4 <= len(found) <= 4 * parts and all(p.suffix == ".zip" for p in found)


def test_bulk_archives_are_read_by_ranges(spark, tmp_path):
    """Members of an archive are read once each, however it is cut; hidden, stray and broken ones give no facts."""
    import zipfile

    from ledgerlake.sources import packages

    (tmp_path / "US").mkdir()
    with zipfile.ZipFile(tmp_path / "US" / "all.ZIP", "w") as z:
        for i in range(40):
            z.writestr(f"f{i}/facts.json", '{"facts": [{"concept": "us-gaap:Cash", "value": %d}]}' % i)
        z.writestr("f40/broken.json", '{"facts": [{"concept": "kaput", "value": 1}]}')
        for name in ("stray.json", "_f/a.json", "f1/.a.json", "f2/readme.txt"):
            z.writestr(name, '{"facts": [{"concept": "c", "value": 1}]}')
    data = (tmp_path / "US" / "all.ZIP").read_bytes()
    (tmp_path / "US" / "all.ZIP").write_bytes(data.replace(b"kaput", b"other", 1))  # another checksum
    (tmp_path / "US" / ".part-1").write_bytes(data)
    (tmp_path / "US" / "none.zip").write_bytes(b"PK")
    (tmp_path / "US" / "f41").mkdir()
    (tmp_path / "US" / "f41" / "facts.json").write_text('{"facts": [{"concept": "us-gaap:Cash", "value": 41}]}')
    for split in (100, 1000, 1 << 20):
        got = packages.filing_facts(spark, str(tmp_path), split).collect()
        assert sorted((int(r["filing_id"][1:]), int(r["value"]), r["source_file"]) for r in got) == [(i, i, "facts.json") for i in [*range(40), 41]]


def test_contract_of_packages_in_files(spark, tmp_path):
    import hashlib
    import json

    from ledgerlake.sources import contract

    def write(package, drop=(), **changes):
        files = {"README.md": "r", "raw/filing.htm": "<p>", "sections/s.json": "[]", "tables/t.json": "[]", "xbrl/x.json": "[]", "metrics/financial_checks.json": "{}", "qa/quality_report.json": json.dumps(dict.fromkeys(contract.QUALITY_FIELDS, 0))}
        files["metrics/financial_data.json"] = json.dumps({"statements": [{"items": [{"canonical_name": "cash", "sources": {"FY": {"evidence_id": "e1"}}}]}], "key_metrics": [{"name": "eps", "sources": {"FY": {"evidence_id": "e2", "page": 3}}}]})
        files["qa/source_map.json"] = json.dumps({"entries": [{"evidence_id": "e1", "target": "x"}, {"evidence_id": "e2", "source_url": "u"}]})
        files |= {k: v for k, v in changes.items() if "/" in k}
        manifest = dict.fromkeys(contract.MANIFEST_FIELDS, "x") | {"schema_version": contract.SCHEMA_VERSION, "market": "JP", "local_source_path": "raw/filing.htm", "artifact_hashes": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in files.items()}}
        files["manifest.json"] = json.dumps(manifest | changes.get("manifest", {}))
        for rel, content in files.items():
            if rel not in drop:
                path = tmp_path / package / rel
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(content)

    write("good")
    write("holes", drop=("README.md", "xbrl/x.json", "raw/filing.htm"))
    write("wrong", manifest={"schema_version": "v0", "market": "", "ticker": None, "artifact_hashes": {"README.md": "00"}})
    write("cites", **{"metrics/financial_data.json": json.dumps({"operating_metrics": [{"name": "users", "sources": {"Q1": {}}}, {"sources": None}, {"name": "mau", "sources": {"Q1": {"evidence_id": "gone"}}}]}), "qa/source_map.json": json.dumps({"entries": [{"target": "t"}, {"evidence_id": "e"}]}), "qa/quality_report.json": "{}"})
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "manifest.json").write_text(" ")
    artifacts = contract.packages_of(spark, str(tmp_path))
    found = contract.breaches(artifacts)
    got = {}
    for r in found.collect():
        got.setdefault(r["package"], []).append((r["code"], r["detail"]))
    assert "good" not in got
    assert sorted(got["holes"]) == sorted([("file_missing", "README.md"), ("directory_missing", "xbrl"), ("directory_missing", "raw"), ("local_source_missing", "raw/filing.htm"), ("artifact_missing", "README.md"), ("artifact_missing", "xbrl/x.json"), ("artifact_missing", "raw/filing.htm")])
    assert sorted(got["wrong"]) == sorted([("schema_version", "v0"), ("market", ""), ("manifest_field_blank", "market"), ("manifest_field_blank", "ticker"), ("artifact_hash_mismatch", "README.md")])
    cites = [x for x in got["cites"] if x[0] != "quality_field_missing"]
    assert sorted(cites) == sorted([("item_without_evidence", "users:Q1"), ("item_without_evidence", "unknown"), ("evidence_unresolved", "mau:gone"), ("evidence_without_id", "t"), ("evidence_without_target", ""), ("evidence_without_target", "e")][:4] + [("evidence_without_target", "e")])
    assert len(got["cites"]) - len(cites) == len(contract.QUALITY_FIELDS) and {c for c, _ in got["empty"]} >= {"manifest_empty", "artifact_hashes_empty", "schema_version"}
    assert {r["package"]: r["ok"] for r in contract.kept(artifacts, found).collect()} == {"good": True, "holes": False, "wrong": False, "cites": False, "empty": False}


def test_contract_is_judged_within_packages(spark, tmp_path):
    """package_contract shuffles keys and line numbers, once each, and writes nothing; loose artefacts are shuffled once."""
    from ledgerlake.plans import registry
    from ledgerlake.sources import contract

    spark.range(600).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1800).select((F.col("id") % 300).alias("l_orderkey"), F.expr("cast(id div 300 % 4 + 1 as int)").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = registry.queries()["package_contract"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 2
    got = {r["code"]: r["count"] for r in found.groupBy("code").count().collect()}
    lines = [(i % 300 % 6, i // 300 % 4 + 1) for i in range(1800)]
    assert got.pop("item_without_evidence") == sum(f == 4 and n % 2 == 0 for f, n in lines) and got.pop("evidence_without_target") == sum(f == 4 and n == 3 for f, n in lines)
    assert got.pop("evidence_unresolved") == sum(f == 5 and n == 1 for f, n in lines)
    assert got == dict.fromkeys(("artifact_hash_mismatch", "file_missing", "artifact_missing", "manifest_field_blank", "market", "quality_field_missing"), 100)
    loose = spark.createDataFrame([("p", "manifest.json", "00", "{}")], "package string, rel string, sha256 string, text string")
    assert contract.breaches(loose)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_contract_of_odd_packages(spark):
    """Nulls, broken texts, repeated items; a package of 10,000 listed files of which half are others and a fifth is missing."""
    import json

    from ledgerlake.sources import contract

    many = {f"raw/{i}": f"{i:064x}" for i in range(10_000)}
    manifest = dict.fromkeys(contract.MANIFEST_FIELDS, "x") | {"schema_version": contract.SCHEMA_VERSION, "market": "EU", "local_source_path": "raw/0"}
    rows = [("many", "manifest.json", "0", json.dumps(manifest | {"artifact_hashes": many | {"manifest.json": "1", "raw/null": "2", "xbrl/any": None}}))]
    rows += [("many", rel, sha256 if i % 2 else "other", None) for i, (rel, sha256) in enumerate(many.items()) if i % 5] + [("many", "raw/null", None, None), ("many", "xbrl/any", "3", None), ("many", "raw/unlisted", "4", None)]
    item = {"name": "twice", "sources": {"FY": {"evidence_id": "gone"}}}
    rows += [("odd", contract.DATA, "0", json.dumps({"statements": [None, {"items": [item, item]}, {"items": None}], "key_metrics": [None, {"name": "n", "sources": {"Q1": None, "Q2": {"evidence_id": "e"}}}]}))]
    rows += [("odd", contract.SOURCE_MAP, "0", json.dumps({"entries": [None, {"evidence_id": "e", "target": "t"}]})), ("odd", contract.QUALITY, "0", "["), ("odd", "manifest.json", "0", None), ("odd", None, None, None)]
    artifacts = spark.createDataFrame(rows, "package string, rel string, sha256 string, text string")
    got = {}
    for r in contract.breaches(artifacts).collect():
        got.setdefault((r["package"], r["code"]), []).append(r["detail"])
    assert sorted(got["many", "artifact_missing"]) == sorted(["raw/null", *(f"raw/{i}" for i in range(0, 10_000, 5))])
    assert sorted(got["many", "artifact_hash_mismatch"]) == sorted(f"raw/{i}" for i in range(0, 10_000, 2) if i % 5)
    assert got["many", "local_source_missing"] == ["raw/0"] and ("many", "artifact_hashes_empty") not in got
    assert sorted(got["odd", "evidence_unresolved"]) == ["twice:gone"] * 2 and sorted(got["odd", "item_without_evidence"]) == ["n:Q1", "unknown"]
    assert got["odd", "evidence_without_id"] == [""] == got["odd", "evidence_without_target"] and ("odd", "quality_field_missing") not in got
    assert got["odd", "manifest_empty"] == ["manifest.json"] == got["odd", "artifact_hashes_empty"] and len(got["odd", "manifest_field_missing"]) == len(contract.MANIFEST_FIELDS)
    assert "artifact_hash_mismatch" not in {r["code"] for r in contract.breaches(artifacts, strict_hashes=False).collect()}


def test_relational_scan_in_ranges(spark, tmp_path):
    from ledgerlake.sources import relational

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id AS ID", "cast(id % 7 AS string) AS NAME").write.jdbc(url, "ITEMS", properties={"driver": driver})
    df = relational.scanned(spark, url, "ITEMS", "ID", 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and sorted(r["ID"] for r in df.collect()) == list(range(100))
    plan = df.filter("ID > 90").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,90)" in plan and "ReadSchema: struct<NAME" in plan
    assert relational.scanned(spark, url, "ITEMS", driver=driver).count() == 100
    spark.range(0).selectExpr("id AS ID").write.jdbc(url, "NOTHING", properties={"driver": driver})
    assert relational.scanned(spark, url, "NOTHING", "ID", driver=driver).count() == 0
