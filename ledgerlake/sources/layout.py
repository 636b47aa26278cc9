"""Blocks, sections and tables of parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import html_text


def layout_blocks(docs: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """items: array of struct(type, text, page_idx, bbox). One row an item in reading order; a box that is not four numbers
    is none."""
    rows = docs.select(id_col, F.posexplode(items_col).alias("ordinal", "i"))
    box = F.when(F.size("i.bbox") == 4, F.col("i.bbox"))
    kind = F.when(F.col("i.type").isin("table", "image", "figure"), F.col("i.type")).otherwise("text")
    return rows.select(id_col, "ordinal", kind.alias("kind"), F.col("i.text").alias("text"), (F.col("i.page_idx") + 1).alias("page_number"), box.alias("bbox"))


def document_tables(docs: DataFrame, id_col: str, tables_col: str) -> DataFrame:
    """One row a table of each document, with its columns."""
    return docs.select(id_col, F.posexplode(tables_col).alias("ordinal", "t")).select(id_col, "ordinal", "t.*")


def html_sections(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Blocks of a page's text, each under the last heading before it (h1 to h6 lines are marked by their level)."""
    marked = F.regexp_replace(F.col(html_col), r"(?i)<h([1-6])\b[^>]*>", "\n#h$1# ")
    lines = pages.select(id_col, F.posexplode(F.split(html_text(marked), "\n")).alias("ordinal", "line"))
    level = F.regexp_extract("line", r"^\s*#h([1-6])# ", 1)
    rows = lines.select(id_col, "ordinal", F.when(level != "", level.cast("int")).alias("level"), F.trim(F.regexp_replace("line", r"^\s*#h[1-6]# ", "")).alias("text")).filter("text != ''")
    before = Window.partitionBy(id_col).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(before))
