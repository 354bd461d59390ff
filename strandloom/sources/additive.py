"""A store of unique reads that grows by batches of files.

Each batch of files is checked, collapsed and written once, as partial counts;
what the store holds is the sum over its batches, so a new lane costs only
itself.  A manifest says which files are in which batch.  It is written anew,
after the counts, with every change: readers take the newest whole one, so a
batch whose writer failed is not there, and can be given again.

A file that is in the store is refused, and so is a batch with other settings.
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import PrepConfig
from strandloom.operators import qc
from strandloom.plans.staging import _store

MANIFEST = "file string, batch string, settings string"


class UniqueStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        """Numbers of the manifests that were written to their end."""
        at, fs = _store(self.spark, f"{self.path}/manifest/v*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName()[1:]) for x in fs.globStatus(at) or [])

    def manifest(self) -> DataFrame:
        """``file, batch, settings``"""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{found[-1]}")

    def _commit(self, rows: DataFrame) -> None:
        found = self._versions()
        # a manifest that failed half way may lie under the next number
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{found[-1] + 1 if found else 0}")

    def missing(self, files: list[str]) -> list[str]:
        """Those of ``files`` that are not in the store."""
        given = self.spark.createDataFrame([(f,) for f in files], "file string")
        new = {r["file"] for r in given.join(self.manifest(), "file", "left_anti").collect()}
        return [f for f in files if f in new]

    def add(self, files: list[str], reads: DataFrame, cfg: PrepConfig) -> None:
        """Merge ``reads``, which come from ``files``."""
        twice = sorted(set(files) - set(self.missing(files))) + sorted({f for f in files if files.count(f) > 1})
        if twice:
            raise ValueError(f"already merged: {', '.join(twice)}")
        if not files:
            raise ValueError("a batch needs files")
        known = self.manifest()
        if known.where(F.col("settings") != repr(cfg)).limit(1).count():
            raise ValueError("the store was made with other settings")
        batch = uuid.uuid4().hex
        qc.tally(reads, cfg).write.parquet(f"{self.path}/counts/{batch}")
        new = self.spark.createDataFrame([(f, batch, repr(cfg)) for f in files], MANIFEST)
        self._commit(known.unionByName(new))

    def tally(self) -> DataFrame:
        """All batches added up; see ``qc.tally``."""
        batches = sorted(r["batch"] for r in self.manifest().select("batch").distinct().collect())
        if not batches:
            raise ValueError(f"nothing in {self.path}")
        rows = self.spark.read.parquet(*(f"{self.path}/counts/{b}" for b in batches))
        return rows.groupBy(*(c for c in rows.columns if c != "n")).agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Make one batch of all, so that reading has fewer files to add up; old counts go once the manifest names them no more."""
        known = self.manifest()
        old = [r["batch"] for r in known.select("batch").distinct().collect()]
        batch = uuid.uuid4().hex
        self.tally().write.parquet(f"{self.path}/counts/{batch}")
        self._commit(known.withColumn("batch", F.lit(batch)))
        for b in old:
            at, fs = _store(self.spark, f"{self.path}/counts/{b}")
            fs.delete(at, True)
