"""Schemas of the core entities, and a catalog of views over their Parquet folders."""

from __future__ import annotations

from pyspark.sql import SparkSession

AMOUNT, RATIO = "decimal(38,6)", "decimal(38,12)"
#: Natural keys are strings; instants have period_end, durations have both ends; loose fields stay JSON in `raw`.
ENTITIES = {
    "companies": "company_id string, market string, ticker string, company_name string, aliases array<string>, raw string",
    "filings": "filing_id string, company_id string, report_type string, form string, fiscal_year int, fiscal_period string, period_end date, filing_date date, raw string",
    "parse_runs": "parse_run_id string, filing_id string, status string, started_at timestamp, completed_at timestamp, artifact_hashes map<string,string>, raw string",
    "statement_items": f"item_uid string, filing_id string, parse_run_id string, statement_type string, canonical_name string, period_key string, value {AMOUNT}, raw_value string, unit string, scale string, evidence_id string, raw string",
    "financial_facts": f"metric_id string, parse_run_id string, canonical_name string, period_start date, period_end date, value {AMOUNT}, currency string, dimensions map<string,string>, confidence double, evidence_id string, raw string",
    "evidence": "evidence_id string, parse_run_id string, fact_id string, page_number int, table_index int, quote_text string, bbox array<double>, raw string",
    "quality_checks": "check_id string, parse_run_id string, rule_id string, status string, detail string",
    "chunks": "chunk_uid string, parse_run_id string, chunk_index int, chunk_type string, text string, embedding array<float>",
}
#: Statuses of a run that counts as successful.
SUCCESS = ("pass", "warning", "completed", "success")


def bootstrap(spark: SparkSession, root: str, only: list[str] | None = None) -> list[str]:
    """A view for each entity: the table under `root` if it is there, else an empty one of the same schema."""
    made = []
    for name in only or ENTITIES:
        try:
            rows = spark.read.schema(ENTITIES[name]).parquet(f"{root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], ENTITIES[name])
        rows.createOrReplaceTempView(name)
        made.append(name)
    spark.sql(LATEST_RUNS).createOrReplaceTempView("latest_parse_runs") if {"parse_runs"} <= set(made) else None
    return made


LATEST_RUNS = f"""
SELECT filing_id, parse_run_id, completed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY completed_at DESC NULLS LAST, parse_run_id DESC) AS n
  FROM parse_runs WHERE status IN {SUCCESS}
) WHERE n = 1
"""
