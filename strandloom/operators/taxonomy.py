"""Roll-up of groups along the ranks, and the choice of one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.config import RANKS
from strandloom.functions.hashing import members_hash
from strandloom.plans.staging import large


def paths(taxonomy: DataFrame, ranks=RANKS) -> DataFrame:
    """``bact_id, path``; missing names are blank."""
    return taxonomy.select("bact_id", F.array(*(F.coalesce(F.col(r).cast("string"), F.lit("")) for r in ranks)).alias("path"))


def blank_taxonomy(bacteria: DataFrame, ranks=RANKS) -> DataFrame:
    """Stands in where no taxonomy is given."""
    return bacteria.select("bact_id", *(F.lit("").alias(r) for r in ranks))


def levels(members: DataFrame, taxonomy: DataFrame, ranks=RANKS) -> DataFrame:
    """``sample, group_id, level, path, members, n_members, fraction, hash`` for every prefix of a lineage.

    ``members`` has ``sample, group_id, bact_id``.
    """
    known = members.join(large(paths(taxonomy, ranks)), "bact_id", "left")
    known = known.withColumn("path", F.coalesce("path", F.array(*(F.lit("") for _ in ranks))))
    # the lineages of a group are far fewer than its members, so they are counted before levels multiply them
    lineages = known.groupBy("sample", "group_id", "path").agg(F.collect_list("bact_id").alias("members"))
    by_level = lineages.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(len(ranks)))))
    by_level = (
        by_level.groupBy("sample", "group_id", "level", F.slice("path", 1, F.col("level")).alias("path"))
        .agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("members"))
        .withColumn("n_members", F.size("members").cast("long"))
    )
    whole = Window.partitionBy("sample", "group_id", "level")
    return by_level.withColumn("fraction", F.col("n_members") / F.sum("n_members").over(whole)).withColumn("hash", members_hash(F.col("members")))


def soft_split(by_level: DataFrame, found: DataFrame) -> DataFrame:
    """Frequency and reads of a group shared among its lineages."""
    return by_level.join(found, ["sample", "group_id"]).select(
        "sample", "group_id", "level", "path", (F.col("freq") * F.col("fraction")).alias("freq"), F.round(F.col("reads") * F.col("fraction")).cast("long").alias("reads")
    )


def majority(by_level: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """The largest lineage of each group, the first in order among equals; it gets the whole frequency.

    ``reads`` is the rounded share of that lineage alone; level 8 adds a digest
    of the group to the path.
    """
    depth = min(level, 7)
    order = Window.partitionBy("sample", "group_id").orderBy(F.desc("fraction"), F.asc("path"))
    top = by_level.where(F.col("level") == depth)
    digest = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "hash")).over(Window.partitionBy("sample", "group_id"))), lambda x: x["hash"]), ","))
    top = top.withColumn("digest", digest).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    path = F.concat("path", F.array("digest")) if level == 8 else F.col("path")
    return top.join(found, ["sample", "group_id"]).select(
        "sample", "group_id", path.alias("path"), "freq", F.round(F.col("reads") * F.col("fraction")).cast("long").alias("reads")
    )
