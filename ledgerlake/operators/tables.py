"""Facts from tables, logical tables from fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.money import currency_of, scale_of
from ledgerlake.functions.numeric import parse_printed
from ledgerlake.sources.shared import stored

PERIOD = r"(?:19|20)\d{2}(?:[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?)?"


def table_facts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells: keys, row, col, text. Columns whose head names a period give a fact for each row with a label; a unit named
    anywhere in the table's first three rows scales its amounts. keys, label, period, value, unit, currency."""
    cells = stored(cells.select(*keys, "row", "col", "text"), "cells")  # heads, units, labels and body are read apart
    period = F.regexp_extract("text", PERIOD, 0)
    heads = cells.filter(F.col("row") <= 2).select(*keys, "col", "row", period.alias("period")).filter("period != '' AND col > 0")
    heads = heads.groupBy(*keys, "col").agg(F.max_by("period", "row").alias("period"), F.max("row").alias("head_row"))
    units = cells.filter((F.col("row") <= 2) & (scale_of(F.col("text")) != 1.0)).groupBy(*keys).agg(F.min_by("text", F.struct("row", "col")).alias("unit"))
    labels = cells.filter((F.col("col") == 0) & (F.trim("text") != "")).select(*keys, "row", F.trim("text").alias("label"))
    body = cells.filter("col > 0").join(heads, [*keys, "col"]).filter(F.col("row") > F.col("head_row"))
    rows = body.join(labels, [*keys, "row"]).join(units, keys, "left")
    value = parse_printed(F.col("text"))
    scale = F.coalesce(scale_of(F.col("unit")), F.lit(1.0)).cast("decimal(20,0)")
    return rows.filter(value.isNotNull()).select(*keys, "label", "period", (value * scale).alias("value"), "unit", currency_of(F.col("unit")).alias("currency"))


def logical_tables(fragments: DataFrame, doc: str) -> DataFrame:
    """fragments: doc, page, ordinal, n_columns, header, markdown. A fragment continues the one before it on the same or
    the next page if it has as many columns and no header of its own; each run is one logical table."""
    w = Window.partitionBy(doc).orderBy("page", "ordinal")
    follows = (F.col("page") - F.lag("page").over(w) <= 1) & (F.col("n_columns") == F.lag("n_columns").over(w)) & (F.coalesce("header", F.lit("")) == "")
    parts = fragments.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("logical", F.sum("new").over(w))
    ordered = F.sort_array(F.collect_list(F.struct("page", "ordinal", "markdown")))
    return parts.groupBy(doc, "logical").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("fragments"), F.array_join(F.transform(ordered, lambda p: p["markdown"]), "\n").alias("markdown"))
