"""A keyed table that micro-batches add to, kept as a few runs of Parquet files (L-02).

Every batch writes its own rows as a run.  While the run before is smaller than
twice those after it, they are merged, so each run is at least twice the next
one and all of them together at most twice the merged table; a row is rewritten
a number of times that grows with the logarithm of the table, not once a batch.

A batch ends with its manifest, the list of live runs, written under another
name and renamed.  What no manifest lists is not read: a batch that failed half
way leaves nothing behind but files that the next one deletes, and a batch that
is run again after its manifest was written is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Runs:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.schema, self.merge = spark, root, schema, merge
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def manifest(self) -> tuple[int, list[tuple[str, int]]]:
        """The last batch that is whole, and its runs (name, rows), oldest and largest first."""
        done = [int(n) for n in self._names("manifests") if n.isdigit()]
        if not done:
            return -1, []
        text = self.spark.read.text(f"{self.root}/manifests/{max(done)}", wholetext=True).first()[0]
        return max(done), [(name, rows) for name, rows in json.loads(text)]

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/runs/{name}")

    def _write(self, df: DataFrame, name: str) -> tuple[str, int]:
        df.write.mode("overwrite").parquet(f"{self.root}/runs/{name}")
        return name, self._run(name).count()

    def _union(self, runs: list[tuple[str, int]]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for k, (name, _) in enumerate(runs):
            out = out.unionByName(self._run(name)) if k else self._run(name)
        return self.merge(out)

    def add(self, rows: DataFrame, number: int) -> None:
        """Add a batch's merged rows."""
        last, runs = self.manifest()
        if number <= last:
            return
        new = self._write(rows, f"{number}")
        if new[1]:
            first, total = len(runs), new[1]
            while first and runs[first - 1][1] < 2 * total:
                first -= 1
                total += runs[first][1]
            runs, merged = runs[:first], [*runs[first:], new]
            runs.append(self._write(self._union(merged), f"{number}m") if len(merged) > 1 else new)
        self._commit(number, runs)

    def _commit(self, number: int, runs: list[tuple[str, int]]) -> None:
        draft = self.path(f"{self.root}/manifests/.{number}")
        out = self.fs.create(draft, True)
        out.write(json.dumps(runs).encode())
        out.close()
        if not self.fs.rename(draft, self.path(f"{self.root}/manifests/{number}")):
            raise OSError(f"could not commit batch {number} in {self.root}")
        live = {name for name, _ in runs}
        for folder, keep in (("runs", live), ("manifests", {str(number)})):
            for name in self._names(folder):
                if name not in keep:
                    self.fs.delete(self.path(f"{self.root}/{folder}/{name}"), True)

    def read(self) -> DataFrame:
        """The merged table after the last batch."""
        return self._union(self.manifest()[1])
