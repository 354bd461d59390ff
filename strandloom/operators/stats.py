"""Read counts along the way, as a long table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import ALL_UNMATCHED, FILTERED, GOOD, LOADED, LONG, MAPPED, MATCHED, MAX_UNMATCHED

SCHEMA = "sample string, metric string, region int, n_unique long, n_reads long"


@dataclass(frozen=True)
class ReadStats:
    """An immutable log of ``sample, metric, region, n_unique, n_reads`` and a number for each addition.

    Region null is global.  Global metrics append; of regional ones with one name
    and region the last addition counts.  That is settled by one aggregate when
    ``rows`` are asked for, however many additions there were.
    """

    log: DataFrame
    n_regions: int = 5
    added: int = 0

    @staticmethod
    def empty(spark, n_regions: int = 5) -> ReadStats:
        return ReadStats(spark.createDataFrame([], f"{SCHEMA}, turn int"), n_regions)

    def add(self, metric: str, values: DataFrame, n_unique: str | None, n_reads: str, region: str | None = None) -> ReadStats:
        number = (F.col(region) if region else F.lit(None)).cast("int")
        if region:
            wrong = F.raise_error(F.lit("no such region")).cast("int")
            number = F.when((number > self.n_regions) | (number < 1) | number.isNull(), wrong).otherwise(number)
        new = values.select(
            "sample",
            F.lit(metric).alias("metric"),
            number.alias("region"),
            (F.col(n_unique) if n_unique else F.lit(None)).cast("long").alias("n_unique"),
            F.col(n_reads).cast("long").alias("n_reads"),
            F.lit(self.added).alias("turn"),
        )
        return ReadStats(self.log.unionByName(new), self.n_regions, self.added + 1)

    @property
    def rows(self) -> DataFrame:
        if "turn" not in self.log.columns:
            return self.log
        last = F.max_by(F.struct("n_unique", "n_reads"), "turn").alias("v")
        regional = self.log.where("region is not null").groupBy("sample", "metric", "region").agg(last)
        return self.log.where("region is null").drop("turn").unionByName(regional.select("sample", "metric", "region", "v.*"))

    def get(self, sample: str, metric: str) -> int:
        """The count of a global metric of a sample, the first one added."""
        found = self.log.where((F.col("sample") == sample) & (F.col("metric") == metric) & F.col("region").isNull())
        row = (found.orderBy("turn") if "turn" in found.columns else found).first()
        if row is None:
            raise KeyError(metric)
        return row["n_reads"]

    def show(self) -> None:
        self.rows.orderBy("sample", F.col("region").asc_nulls_first(), "metric").show(1000, truncate=False)


def funnel_stats(spark, qc: DataFrame, mapped: DataFrame, filtered: DataFrame, match: DataFrame) -> ReadStats:
    """All eight metrics from the tables of the stages, without upserts, so as one union."""
    kinds = [(LOADED, "loaded"), (LONG, "long"), (GOOD, "good")]
    part = lambda df, metric, region, unique, reads: df.select(
        "sample", F.lit(metric).alias("metric"), region.cast("int").alias("region"), unique.cast("long").alias("n_unique"), reads.cast("long").alias("n_reads")
    )
    none, r = F.lit(None), F.col("region")
    rows = [part(qc, m, none, none, F.col(c)) for m, c in kinds]
    rows += [part(mapped, MAPPED, r, F.col("n_unique"), F.col("n_reads")), part(filtered, FILTERED, r, F.col("n_unique"), F.col("n_reads"))]
    rows += [
        part(match, MATCHED, r, F.col("matched_unique"), F.col("matched_reads")),
        part(match, MAX_UNMATCHED, r, F.lit(1), F.col("max_unmatched")),
        part(match, ALL_UNMATCHED, r, F.col("unmatched_unique"), F.col("unmatched_reads")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return ReadStats(out)
