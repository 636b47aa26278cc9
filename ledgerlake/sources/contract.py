"""The contract of an evidence package, as rules over its artefacts and the references between them.

A package is rows of artefacts (package, rel, sha256, text): from files by packages_of(), or from anywhere else; or one row with
all of them. Every rule is an expression over such a row and gives breaches (package, code, severity, detail); a package without
an error keeps the contract. What refers to what: the manifest lists artefacts with their hashes and names the local source; items of the
financial data cite evidence; the source map has the evidence and where each piece of it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract.
SCHEMA_VERSION = "market_evidence_package_v1"
MARKETS = ("US", "HK", "JP", "KR", "EU")
MANIFEST_FIELDS = (
    "schema_version", "market", "filing_id", "company_id", "ticker", "company_name", "source_id", "form", "report_type", "fiscal_year", "fiscal_period", "period_end", "published_at",
    "source_url", "local_source_path", "accounting_standard", "parser_version", "rules_version", "quality_status", "artifact_hashes",
)
DIRECTORIES = ("raw", "sections", "tables", "xbrl", "metrics", "qa")
DATA, SOURCE_MAP, QUALITY = "metrics/financial_data.json", "qa/source_map.json", "qa/quality_report.json"
READ = ("manifest.json", DATA, SOURCE_MAP, QUALITY)
FILES = ("manifest.json", "README.md", DATA, "metrics/financial_checks.json", QUALITY, SOURCE_MAP)
QUALITY_FIELDS = ("overall_status", "section_count", "table_count", "raw_fact_count", "normalized_metric_count", "evidence_coverage_ratio", "required_statement_status", "critical_warnings", "parser_warnings", "rule_warnings")

_ITEM = "struct<canonical_name: string, name: string, sources: map<string, map<string, string>>>"
_DATA = f"statements array<struct<items: array<{_ITEM}>>>, key_metrics array<{_ITEM}>, operating_metrics array<{_ITEM}>"
_ENTRY = "struct<evidence_id: string, target: string, local_path: string, source_url: string>"
_SOURCES = f"entries array<{_ENTRY}>"


def packages_of(spark: SparkSession, root: str) -> DataFrame:
    """Artefacts of the packages that are the folders right under `root`. Texts of JSON files alone are kept.
    Spark doesn't list files without a byte: they count as missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), f"^{base}/", "")
    text = F.when(F.col("path").endswith(".json"), F.decode("content", "UTF-8"))
    return files.select(F.substring_index(inside, "/", 1).alias("package"), F.regexp_replace(inside, "^[^/]*/", "").alias("rel"), F.sha2("content", 256).alias("sha256"), text.alias("text"))


def bundled(artifacts: DataFrame) -> DataFrame:
    """package, files (rel, sha256, text): artefacts that lie as rows anywhere, by one shuffle. Texts that no rule reads stay behind."""
    text = F.when(F.col("rel").isin(*READ), F.col("text"))
    return artifacts.groupBy("package").agg(F.collect_list(F.struct("rel", "sha256", text.alias("text"))).alias("files"))


def breaches(artifacts: DataFrame, strict_hashes: bool = True) -> DataFrame:
    """package, code, severity, detail of each breach, over all packages. artifacts: package, rel, sha256, text, a row a file;
    texts other than of JSON files may be null."""
    return breaches_within(bundled(artifacts), strict_hashes)


def breaches_within(packages: DataFrame, strict_hashes: bool = True) -> DataFrame:
    """The breaches of packages that are a row each (package, files). No reference leaves its package, so all are followed
    within its row, in one pass: nothing is shuffled or written. Names meet as hashed sets (array_except, array_intersect)."""
    fields = "map<string, string>"
    no_fields, no_items, no_entries = F.create_map().cast(fields), F.array().cast(f"array<{_ITEM}>"), F.array().cast(f"array<{_ENTRY}>")
    breach = lambda code, detail, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    no_breach = F.array().cast("array<struct<code: string, severity: string, detail: string>>")
    once = lambda wrong, code, detail: F.when(wrong, F.array(breach(code, detail, "error"))).otherwise(no_breach)
    each = lambda rows, code, detail=lambda x: x, severity="error": F.transform(rows, lambda x: breach(code, detail(x), severity))
    words = lambda names: F.array(*map(F.lit, names))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(-1)) <= 0

    # What several rules read is made once: the texts are parsed in one step, references taken from them in the next.
    parsed = lambda rel, schema: F.transform(F.filter("texts", lambda f: f["rel"] == rel), lambda f: F.from_json(f["text"], schema))
    statement_items = lambda j: F.coalesce(F.flatten(F.transform(j["statements"], lambda s: F.coalesce(s["items"], no_items))), no_items)
    all_items = lambda j: F.concat(statement_items(j), F.coalesce(j["key_metrics"], no_items), F.coalesce(j["operating_metrics"], no_items))
    named = lambda i: F.struct(F.coalesce(i["canonical_name"], i["name"], F.lit("unknown")).alias("item"), i["sources"].alias("sources"))
    pair = lambda sha256, rel: F.concat(F.hex(sha256), F.lit("/"), rel)  # noqa: E731 - hex digits have no slash
    slim = packages.select("package", F.transform("files", lambda f: F.struct(f["rel"].alias("rel"), f["sha256"].alias("sha256"))).alias("files"), F.filter("files", lambda f: f["rel"].isin(*READ)).alias("texts"))
    read = slim.select(
        "package", "files",
        F.transform(parsed("manifest.json", fields), lambda j: F.coalesce(j, no_fields)).alias("manifests"),
        parsed(DATA, _DATA).alias("data"),
        parsed(SOURCE_MAP, _SOURCES).alias("maps"),
        F.array_compact(parsed(QUALITY, fields)).alias("qualities"),
    )
    of = lambda m, name: F.coalesce(F.element_at(m, F.lit(name)), F.lit(""))
    read = read.select(
        "package", "files", "manifests", "qualities",
        F.transform("manifests", lambda m: F.from_json(of(m, "artifact_hashes"), fields)).alias("lists"),
        F.transform(F.flatten(F.transform("data", all_items)), named).alias("items"),
        F.flatten(F.transform("maps", lambda j: F.coalesce(j["entries"], no_entries))).alias("entries"),
    )
    cite = lambda i: F.transform(F.map_entries(i["sources"]), lambda s: F.struct(i["item"].alias("item"), s["key"].alias("period"), s["value"].alias("evidence"), F.element_at(s["value"], F.lit("evidence_id")).alias("evidence_id")))
    listed = lambda h: F.map_filter(F.coalesce(h, no_fields), lambda rel, _: rel != "manifest.json")
    read = read.withColumn("cited", F.flatten(F.array_compact(F.transform("items", cite))))
    # Evidence that is cited and not in the source map.
    read = read.withColumn("unknown", F.array_except(F.array_compact(F.transform("cited", lambda c: c["evidence_id"])), F.transform("entries", lambda e: e["evidence_id"])))

    rels = F.col("files")["rel"]
    directories = F.transform(rels, lambda r: F.when(F.contains(r, F.lit("/")), F.substring_index(r, "/", 1)))
    out = [each(F.array_except(words(FILES), rels), "file_missing"), each(F.array_except(words(DIRECTORIES), directories), "directory_missing")]

    # The manifest: a map of its fields as they stand, and of the hashes that it lists.
    def of_manifest(m: Column) -> Column:
        there = F.array_intersect(words(f for f in MANIFEST_FIELDS if f != "artifact_hashes"), F.map_keys(m))
        version, market, source = of(m, "schema_version"), of(m, "market"), of(m, "local_source_path")
        return F.concat(
            once(F.size(m) == 0, "manifest_empty", F.lit("manifest.json")),
            each(F.array_except(words(MANIFEST_FIELDS), F.map_keys(m)), "manifest_field_missing"),
            each(F.filter(there, lambda f: blank(F.element_at(m, f))), "manifest_field_blank"),
            once(version != SCHEMA_VERSION, "schema_version", version),
            once(~market.isin(*MARKETS), "market", market),
            once((source != "") & ~F.coalesce(F.array_contains(rels, source), F.lit(False)), "local_source_missing", source),
        )

    # A file that can't be read has no hash: it counts as missing.
    hashed = F.transform("files", lambda f: F.when(f["sha256"].isNotNull(), f["rel"]))
    found = F.transform("files", lambda f: pair(f["sha256"], f["rel"]))

    def mismatches(h: Column) -> Column:
        stated = F.map_filter(h, lambda _, sha256: sha256.isNotNull())
        others = F.array_except(found, F.transform(F.map_entries(stated), lambda e: pair(e["value"], e["key"])))
        return each(F.array_intersect(F.map_keys(stated), F.transform(others, lambda p: F.substr(p, F.instr(p, "/") + 1))), "artifact_hash_mismatch")

    out += [F.flatten(F.transform("manifests", of_manifest)), F.flatten(F.transform("lists", lambda h: once(empty(h), "artifact_hashes_empty", F.lit("manifest.json"))))]
    out.append(F.flatten(F.transform("lists", lambda h: each(F.array_except(F.map_keys(listed(h)), hashed), "artifact_missing"))))
    if strict_hashes:
        out.append(F.flatten(F.transform("lists", lambda h: mismatches(listed(h)))))

    # Items cite evidence, which the source map holds.
    out.append(each(F.filter("items", lambda i: empty(i["sources"])), "item_without_evidence", lambda i: i["item"]))
    out.append(each(F.filter("cited", lambda c: empty(c["evidence"])), "item_without_evidence", lambda c: F.concat_ws(":", c["item"], c["period"])))
    out.append(each(F.filter("entries", lambda e: blank(e["evidence_id"])), "evidence_without_id", lambda e: F.coalesce(e["target"], e["local_path"], e["source_url"], F.lit(""))))
    out.append(each(F.filter("entries", lambda e: blank(e["target"]) & blank(e["local_path"]) & blank(e["source_url"])), "evidence_without_target", lambda e: F.coalesce(e["evidence_id"], F.lit(""))))
    out.append(each(F.filter("cited", lambda c: F.array_contains("unknown", c["evidence_id"])), "evidence_unresolved", lambda c: F.concat_ws(":", c["item"], c["evidence_id"])))
    out.append(F.flatten(F.transform("qualities", lambda m: each(F.array_except(words(QUALITY_FIELDS), F.map_keys(m)), "quality_field_missing", severity="warning"))))
    # The outer form, as Spark would else work the whole list out once more to see if it is empty.
    return read.select("package", F.concat(*out).alias("out")).select("package", F.inline_outer("out")).filter("code IS NOT NULL")


def kept(artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """package, errors, warnings, ok of each package."""
    counts = found.groupBy("package").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = artifacts.select("package").distinct().join(counts, "package", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("ok", F.col("errors") == 0)
