"""The folder that all executors share, for what a query writes on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows of one frame that a task gives, and rows that one partition of a spread table has.
FRAME, PART = 5000, 400_000
#: Bytes of texts that a task takes at once.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="ledgerlake-")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset a local master (as in tests) gets one of our own; on
    a cluster other executors could not read it, so it is an error there."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file://{_own_dir()}"
    return f"{base.rstrip('/')}/ledgerlake/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: what reads it twice reads the same, and a lost executor costs one step."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that hands texts to Python a few megabytes at a time, unless it has a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df


def in_frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of FRAME rows, made one after the other: a task never holds all that a batch of texts gives."""
    for part in batched(rows, FRAME):
        yield pd.DataFrame(part, columns=columns)


def partitions_for(df: DataFrame) -> int:
    """How many partitions the rows of a table should be dealt to: a task's share stays the same when the table grows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART))
