"""Routing of reads to regions by their primers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import PrepConfig, primers
from strandloom.functions import dna


def distances(uni: DataFrame, rows=None) -> DataFrame:
    """A row for each read and region with the mismatches at either end.

    The second mate is turned round, so a pair reads along one strand.  The few
    regions are expressions, exploded: no join and no shuffle.
    """
    both = uni.withColumn("seq", F.concat("r1", dna.revcomp(F.col("r2"))))
    ends = [
        F.struct(
            F.lit(p.region).alias("region"),
            dna.primer_distance(F.col("seq"), p.forward).alias("d_forward"),
            dna.primer_distance(F.col("seq"), dna.revcomp_text(p.reverse), at_end=True).alias("d_reverse"),
            F.lit(len(p.forward)).alias("n_forward"),
            F.lit(len(p.reverse)).alias("n_reverse"),
        )
        for p in (primers(rows) if rows else primers())
    ]
    return both.withColumn("hit", F.explode(F.array(*ends))).select(*both.columns, "hit.*")


def assign(uni: DataFrame, cfg: PrepConfig, rows=None) -> DataFrame:
    """``sample, region, seq, n``: reads within the allowed mismatches of both primers, primers cut off.

    A read may belong to several regions.  Single ends are refused, unless
    ``either_end`` asks for their own routing.
    """
    if not cfg.dest_paired and cfg.either_end:
        return assign_ends(uni, cfg, rows)
    if not cfg.dest_paired:
        raise NotImplementedError("single-end reads can't be routed to regions")
    near = distances(uni, rows).where(
        (F.col("d_forward") <= cfg.max_err_in_primer) & (F.col("d_reverse") <= cfg.max_err_in_primer)
    )
    length = F.char_length("seq") - F.col("n_forward") - F.col("n_reverse")
    seq = F.col("seq") if cfg.with_primer else F.substring(F.col("seq"), F.col("n_forward") + 1, length)
    return near.select("sample", "region", seq.alias("seq"), "n")


def assign_ends(uni: DataFrame, cfg: PrepConfig, rows=None) -> DataFrame:
    """``sample, region, seq, n, side``: single reads by the primer at either end, which is cut off.

    ``side`` is 1 for the forward primer at a read's start, -1 for the reverse one
    at its end; a read that has both counts as reverse.
    """
    ends = distances(uni, rows)
    most = F.lit(cfg.max_err_in_primer)
    side = F.when(F.col("d_reverse") <= most, -1).when(F.col("d_forward") <= most, 1)
    near = ends.withColumn("side", side).where("side is not null")
    forward = F.substring(F.col("seq"), F.col("n_forward") + 1, F.char_length("seq"))
    reverse = F.substring(F.col("seq"), F.lit(1), F.char_length("seq") - F.col("n_reverse"))
    seq = F.col("seq") if cfg.with_primer else F.when(F.col("side") == 1, forward).otherwise(reverse)
    return near.select("sample", "region", seq.alias("seq"), "n", "side")


def collapse(assigned: DataFrame) -> DataFrame:
    """Reads that are equal once trimmed; their counts add up. Those of either side stay apart."""
    by = [c for c in ("sample", "region", "seq", "side") if c in assigned.columns]
    return assigned.groupBy(*by).agg(F.sum("n").alias("n"))


def totals(assigned: DataFrame, samples: DataFrame | None = None, regions=(1, 2, 3, 4, 5)) -> DataFrame:
    """Unique reads and counts by sample and region; with ``samples``, zeros where there are none."""
    found = assigned.groupBy("sample", "region").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_reads"))
    if samples is None:
        return found
    grid = samples.select("sample").distinct().withColumn("region", F.explode(F.array(*map(F.lit, regions))))
    return grid.join(found, ["sample", "region"], "left").na.fill(0, ["n_unique", "n_reads"])
