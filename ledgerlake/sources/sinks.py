"""Sinks: line-delimited JSON, and chunks with their embeddings by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; nulls stay as null, so that every line has every key."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", size: int = 32) -> DataFrame:
    """Adds embedding. `embed` gets `size` texts at most at a time, within tasks; null texts are embedded as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                yield part.assign(embedding=embed([t or "" for t in part[text]]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{schema}, embedding array<float>")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those of the new keys, and the new ones. Keys with nulls match each other."""
    same = None
    fresh = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    return stored.join(fresh, same, "left_anti").unionByName(new)
