"""JSON document packages, line-delimited JSON, and writing facts back by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions_for


def json_documents(spark: SparkSession, root: str, schema: T.StructType, name: str = "document_full.json") -> DataFrame:
    """Every document of that name under a folder, one row a file, with its path."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", name)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def file_hashes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, sha256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of the malformed ones."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r._bad IS NULL").select("r.*").drop("_bad")
    return good, parsed.filter("r._bad IS NOT NULL").select("value")


def fenced_json(text: F.Column, kind: str = "json") -> F.Column:
    """The body of the first fenced block of a kind in Markdown."""
    return F.nullif(F.regexp_extract(text, rf"(?s)```{kind}\s*\n(.*?)\s*```", 1), F.lit(""))


def company_facts(docs: DataFrame, id_col: str, facts_col: str) -> DataFrame:
    """taxonomy, concept, unit, and each value of a four-level map of facts."""
    level = docs.select(id_col, F.explode(facts_col).alias("taxonomy", "concepts")).select(id_col, "taxonomy", F.explode("concepts").alias("concept", "body"))
    units = level.select(id_col, "taxonomy", "concept", F.col("body.label").alias("label"), F.explode("body.units").alias("unit", "values"))
    return units.select(id_col, "taxonomy", "concept", "label", "unit", F.posexplode("values").alias("ordinal", "value")).select(id_col, "taxonomy", "concept", "label", "unit", "ordinal", "value.*")


def replace_runs(rows: DataFrame, path: str, run_col: str = "parse_run_id") -> None:
    """Replace what a run wrote before; other runs stay. Writing twice leaves the same files' rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def load_plan(rows: DataFrame, gate: F.Column, path: str) -> None:
    """Canonical rows where the gate allows, the others to quarantine with their reason; artifacts are written by callers."""
    judged = rows.withColumn("_allowed", gate)
    judged.filter("_allowed").drop("_allowed").write.mode("overwrite").parquet(f"{path}/canonical")
    judged.filter("_allowed IS NULL OR NOT _allowed").drop("_allowed").write.mode("overwrite").parquet(f"{path}/quarantine")


def fact_projection(heads: DataFrame, items: DataFrame, kind: str, order: list[str], statements: list[str], operating: str) -> DataFrame:
    """Rows of the tables that a load writes: target, artifact_id, market, statement, item_index, canonical_name, value.

    heads: artifact_id, market; items: artifact_id, `kind`, canonical_name, value. A kind of `statements` gives a row of its
    own a filing, and its items are numbered in it; items of kind `operating` go to their own table, all others are facts."""
    n = partitions_for(items)
    placed = items.repartition(n, "artifact_id").join(heads.repartition(n, "artifact_id"), "artifact_id")
    is_statement, none = F.col(kind).isin(*statements), lambda c: F.lit(None).cast(c)
    one = placed.filter(is_statement).select("artifact_id", "market", kind).distinct()
    rows = one.select(F.lit("financial_statements").alias("target"), "artifact_id", "market", F.col(kind).alias("statement"), none("long").alias("item_index"), none("string").alias("canonical_name"), none("double").alias("value"))
    number = F.row_number().over(Window.partitionBy("artifact_id", kind).orderBy(*order)).cast("long")
    target = F.when(F.col(kind) == operating, "operating_metric_facts").otherwise("financial_facts")
    return rows.unionByName(placed.select(target.alias("target"), "artifact_id", "market", F.when(is_statement, F.col(kind)).alias("statement"), number.alias("item_index"), "canonical_name", "value"))
