"""What several training-data operators share: the shared folder, written intermediate tables, words."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls 09-0D, nothing else of Unicode.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Narrow rows that a file of an intermediate table of known size holds.
FILE_ROWS = 200_000


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="ledgerlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master (as in tests) gets one
    of our own; on a cluster other executors could not read it, so it is an error there."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + _own_dir()
    return f"{base.rstrip('/')}/ledgerlake"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps start from files that outlive any executor.

    rows: a known bound of its rows, narrow ones: as few tasks and files are made as have FILE_ROWS of them.
    """
    small_batches(df.sparkSession)
    path = fresh_dir(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes for whole texts: what a Python worker and the executor beside it hold at a time. A value
    that is set already stays."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as a string and text: pandas has no null among longs, but strings pass it whole. ids_back() turns it back."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))


def ids_back(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split() parts at exactly those six characters."""
    return text.encode().split() if text else []
