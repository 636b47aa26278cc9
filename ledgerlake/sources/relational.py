"""Tables of a relational database as partitioned, read-only scans over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scanned(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table, or a query in brackets with a name. With a numeric or time `key` it is read in `parts` ranges between the key's
    ends, which one row tells first; filters and columns are pushed to the database. options: user, driver and others."""
    reader = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), pushDownPredicate="true", **options)
    if key is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f"(SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH FROM {table}) ENDS").load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.option("dbtable", table).options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()
