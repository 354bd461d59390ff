"""The reference database as Parquet, one directory per region."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import RANKS, db_paths
from strandloom.operators.taxonomy import blank_taxonomy

REF_SCHEMA = "bact_id long, kmer string, is_perfect_match boolean, region int"
CATALOG_SCHEMA = "bact_id long, headers array<double>, sequence string"


def read_len_of(path: str) -> int | None:
    """The read length that a database name holds as ``RL<number>``."""
    found = re.search(r"RL(\d+)", path)
    return int(found[1]) if found else None


def write_reference(ref: DataFrame, path: str) -> None:
    """``bact_id, region, kmer, is_perfect_match``; regions become directories that reads can prune."""
    ref.write.mode("overwrite").partitionBy("region").parquet(path)


def read_reference(spark: SparkSession, path: str, use_regions: list[int] | None = None) -> DataFrame:
    ref = spark.read.schema(REF_SCHEMA).parquet(path)
    return ref.where(F.col("region").isin(*use_regions)) if use_regions else ref


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_catalog(spark: SparkSession, db_dir: str, name: str, with_sequences: bool = False) -> DataFrame:
    """Headers, and sequences if asked for; a table of headers alone is used where there is one."""
    paths = db_paths(db_dir, name)
    if with_sequences or not _exists(spark, paths["headers"]):
        out = spark.read.schema(CATALOG_SCHEMA).parquet(paths["catalog"])
        return out if with_sequences else out.drop("sequence")
    return spark.read.schema("bact_id long, headers array<double>").parquet(paths["headers"])


def read_taxonomy(spark: SparkSession, db_dir: str, bacteria: DataFrame) -> tuple[DataFrame, bool]:
    """The taxonomy and whether there is one; blank names stand in for a missing one."""
    path = db_paths(db_dir, "")["taxonomy"]
    if not _exists(spark, path):
        return blank_taxonomy(bacteria), False
    return spark.read.schema("bact_id long, " + ", ".join(f"`{r}` string" for r in RANKS)).parquet(path), True
