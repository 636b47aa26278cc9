"""A bounded sample of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows that a classifier is fitted on, at most: those of the smallest hash of their id.
SAMPLE = 3000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, text and label of at most `most` labelled documents, as a written table. Rows without a label don't count; of
    rows that repeat an id the text of the smallest hash does."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = chosen.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    # Broadcast of `most` rows of two numbers, whatever the data's size.
    met = texts.join(F.broadcast(chosen), "_id")
    return written(met.groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_id", "text", "label"), "labelled")
