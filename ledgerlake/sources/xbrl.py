"""XBRL instances: contexts, units and facts as DataFrames, joined by their references."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_frames, in_small_batches, stored

ROWS = "filing_id string, kind string, ref string, concept string, value string, context_ref string, unit_ref string, decimals string, instant string, start string, end string, dims map<string,string>, unit string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def instance_rows(filing_id: str, text: str | None) -> list[tuple]:
    """Rows of one instance; one that is no XML gives none."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out = []
    for node in root:
        name = _local(node.tag)
        if name == "context":
            found = {_local(n.tag): (n.text or "").strip() for n in node.iter()}
            dims = {n.get("dimension"): (n.text or "").strip() for n in node.iter() if _local(n.tag) == "explicitMember"}
            out.append((filing_id, "context", node.get("id"), None, None, None, None, None, found.get("instant"), found.get("startDate"), found.get("endDate"), dims, None))
        elif name == "unit":
            measures = {side: [(m.text or "").strip() for m in part.iter() if _local(m.tag) == "measure"] for side in ("unitNumerator", "unitDenominator") for part in node.iter() if _local(part.tag) == side}
            plain = [(m.text or "").strip() for m in node if _local(m.tag) == "measure"]
            unit = "*".join(plain) if plain else "/".join("*".join(measures.get(side, [])) for side in ("unitNumerator", "unitDenominator"))
            out.append((filing_id, "unit", node.get("id"), None, None, None, None, None, None, None, None, None, unit))
        elif node.get("contextRef"):
            out.append((filing_id, "fact", node.get("id"), name, (node.text or "").strip(), node.get("contextRef"), node.get("unitRef"), node.get("decimals"), None, None, None, None, None))
    return out


def facts(instances: DataFrame, id_col: str = "filing_id", xml_col: str = "xml") -> DataFrame:
    """Facts with the period, dimensions and unit that they refer to; a fact without its context or unit keeps nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (row for i, text in zip(batch["id"], batch["xml"]) for row in instance_rows(i, text))
            yield from in_frames(rows, [c.split()[0] for c in ROWS.split(", ")])

    rows = in_small_batches(instances).select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).alias("xml")).mapInPandas(run, ROWS)
    rows = stored(rows, "instances")  # contexts, units and facts are read apart; an instance is parsed once
    contexts = rows.filter("kind = 'context'").select("filing_id", F.col("ref").alias("context_ref"), "instant", "start", "end", "dims")
    units = rows.filter("kind = 'unit'").select("filing_id", F.col("ref").alias("unit_ref"), "unit")
    found = rows.filter("kind = 'fact'").select("filing_id", "concept", F.col("value").try_cast("decimal(38,6)").alias("value"), "context_ref", "unit_ref", "decimals")
    return found.join(contexts, ["filing_id", "context_ref"], "left").join(units, ["filing_id", "unit_ref"], "left")
