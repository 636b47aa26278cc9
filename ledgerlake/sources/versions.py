"""Replacement of all that a run wrote, over any number of tables, in one commit.

Data files of a commit lie under its own name in each table's folder. Nothing is visible until the commit's entry in the log
is: a folder that holds the runs it replaces, written under a temporary name and renamed, which shared file systems do at once
and refuse where the target is there. So a writer that fails between two tables leaves the version before whole, two
writers can't take the same number, and a reader sees every table of one version.

root/data/<table>/_commit=<id>/...   root/log/_seq=<n>/ (run, commit_id, rows by table)
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 20


class Conflict(Exception):
    """Other writers took every number that was tried."""


class VersionedRuns:
    def __init__(self, spark: SparkSession, root: str, run_col: str = "parse_run_id"):
        self.spark, self.root, self.run_col = spark, root.rstrip("/"), run_col

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("_seq=")) for n in names if n.startswith("_seq="))

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max(self._numbers(), default=0)

    def replace(self, tables: Mapping[str, DataFrame], runs: DataFrame | None = None) -> int:
        """Commit new rows of the runs that `tables` name, and of `runs`: what these wrote before is gone in every table,
        those left out too. A run without rows is deleted. Returns the version."""
        commit = f"c{uuid.uuid4().hex}"  # no text that reads as a number
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/data/{name}/_commit={commit}")
        written = [self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{name}/_commit={commit}") for name, rows in tables.items()]
        named = [d.select(F.col(self.run_col).alias("run")) for d in [*written, *([runs] if runs is not None else [])]]
        entry = reduce(DataFrame.unionByName, named).distinct().withColumn("commit_id", F.lit(commit))
        waiting = f"{self.root}/log/.waiting-{commit}"
        entry.write.parquet(waiting)
        return self._publish(waiting)

    def _publish(self, waiting: str) -> int:
        fs, source = self._fs(waiting)
        for _ in range(ATTEMPTS):
            n = self.version() + 1
            target = self._fs(f"{self.root}/log/_seq={n}")[1]
            try:
                if not fs.exists(target) and fs.rename(source, target):
                    return n
            except Exception:  # some file systems raise where the target is there
                if not fs.exists(target):
                    raise
        raise Conflict(waiting)

    def current(self, version: int | None = None) -> DataFrame:
        """run and the commit that holds its rows, as of a version. The log has a row a run and commit."""
        last = self.version() if version is None else version
        known = [n for n in self._numbers() if n <= last]
        if not known:
            return self.spark.createDataFrame([], "run string, commit_id string")
        log = self.spark.read.option("basePath", f"{self.root}/log").parquet(*[f"{self.root}/log/_seq={n}" for n in known])
        return log.groupBy("run").agg(F.max_by("commit_id", "_seq").alias("commit_id"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows of one version. Commits that hold none of it are pruned by their folders."""
        path = f"{self.root}/data/{table}"
        rows = self.spark.read.parquet(path)
        now = self.current(version).select(F.col("run").alias(self.run_col), F.col("commit_id").alias("_commit"))
        return rows.join(now, [self.run_col, "_commit"], "left_semi").drop("_commit")

    def obsolete(self) -> DataFrame:
        """Commits that no run's current rows are in: their folders may be deleted once no reader uses an older version."""
        n = self._numbers()
        if not n:
            return self.spark.createDataFrame([], "commit_id string")
        log = self.spark.read.option("basePath", f"{self.root}/log").parquet(*[f"{self.root}/log/_seq={i}" for i in n])
        return log.select("commit_id").distinct().join(self.current().select("commit_id"), "commit_id", "left_anti")
