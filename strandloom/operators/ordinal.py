"""Numbers in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.plans.staging import stage


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: numbers from 1 within ``by``, in ``order``.

    Rows are dealt to ranges; each range numbers its own rows and starts where
    those before it end, so no task holds all rows of a value of ``by``.
    """
    rows = stage(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ordinals")
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return rows.withColumn("_i", own).join(starts, [*by, "_range"]).withColumn(name, (F.col("_i") + F.col("_start")).cast("int")).drop("_range", "_i", "_start")
