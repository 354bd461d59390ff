"""Pruning of bacteria, ambiguity groups, and the mixture solve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import EPS, AlgoConfig
from strandloom.operators.mixture import em_solve, scaled, solve_blocks, with_rows
from strandloom.operators.refdb import FINGERPRINT, fingerprint
from strandloom.plans.staging import large, stage


def evidence(lik: DataFrame) -> DataFrame:
    """Per sample, bacterium and region: the likelihood mass and the reads that match without error."""
    return lik.groupBy("sample", "bact_id", "region").agg(F.sum("p").alias("mass"), F.count_if(F.col("d") == 0).alias("perfect"))


def present_everywhere(lik: DataFrame, ref: DataFrame, norm: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """``sample, bact_id, norm`` of bacteria with evidence in every region where they must show.

    ``do_filter`` 1 asks for a perfect read in each region with perfect primers
    (and, for single ends, both ends or none elsewhere); 2 asks for
    ``num_reads_matched`` of them; 0 asks nothing.
    """
    if cfg.do_filter == 2 and cfg.num_reads_matched is None:
        raise ValueError("do_filter=2 needs num_reads_matched")
    need = cfg.num_reads_matched if cfg.do_filter == 2 else cfg.halves
    ev = evidence(lik)
    seen = ev.groupBy("sample", "bact_id").agg(F.sum("mass").alias("mass"), F.count_if(F.col("perfect") >= need).alias("full_regions"))
    # regions with perfect primers that show enough perfect reads, against how many there are
    pm = ref.where("is_perfect_match").select("bact_id", "region")
    met = ev.join(large(pm), ["bact_id", "region"]).groupBy("sample", "bact_id").agg(F.count_if(F.col("perfect") >= need).alias("met"))
    asked = pm.groupBy("bact_id").agg(F.count("*").alias("asked"))
    kept = (
        seen.join(met, ["sample", "bact_id"], "left")
        .join(large(asked), "bact_id", "left")
        .join(large(norm), "bact_id")
        .where("mass > 0 and norm > 0")
    )
    if cfg.do_filter in (1, 2):
        kept = kept.where("coalesce(asked, 0) = coalesce(met, 0)")
    if cfg.do_filter == 1 and cfg.halves > 1:
        other = ev.join(large(pm), ["bact_id", "region"], "left_anti").where((F.col("perfect") > 0) & (F.col("perfect") < need))
        kept = kept.join(other.select("sample", "bact_id").distinct(), ["sample", "bact_id"], "left_anti")
    return kept.select("sample", "bact_id", "norm")


def ambiguity_groups(lik: DataFrame, kept: DataFrame) -> DataFrame:
    """``sample, bact_id, representative``: bacteria with equal columns of the system, and the smallest of them.

    A likelihood depends on length and distance alone, so columns are compared
    by those integers, as fingerprints.
    """
    own = lik.join(kept, ["sample", "bact_id"])
    # written, as both sides of the join need it
    prints = stage(own.groupBy("sample", "bact_id", "norm").agg(*fingerprint("region", "seq", "len", F.col("d"), F.round(F.log10("p"), 9))), "prints")
    least = prints.groupBy("sample", "norm", *FINGERPRINT).agg(F.min("bact_id").alias("representative"))
    return large(prints).join(least, ["sample", "norm", *FINGERPRINT]).select("sample", "bact_id", "representative", "norm")


def supports(lik: DataFrame, groups: DataFrame) -> DataFrame:
    """``sample, region, seq, col, n, len, d, p, norm``: the system, one column per group."""
    reps = groups.where("bact_id = representative").select("sample", "bact_id", "norm")
    return lik.join(reps, ["sample", "bact_id"]).withColumnRenamed("bact_id", "col")


#: Longs of a column's signature.
SIGNATURE = 4


def included(system: DataFrame) -> DataFrame:
    """``sample, col`` of columns whose rows are a strict part of another column's.

    Columns with equal rows are one set, compared once.  A set that holds another
    holds its rarest row too: only there do they meet, and only if it is larger and
    its signature, a bit set of hashed rows, has all bits of the other's.  What is
    left is counted row by row, so no signature decides by itself.
    """
    own = system.select("sample", F.xxhash64("region", "seq").alias("row"), "col")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("row", 8), F.lit(64)).cast("int"))
    signature = [F.bit_or(F.when(F.pmod("row", F.lit(SIGNATURE)) == k, bit).otherwise(0)).alias(f"s{k}") for k in range(SIGNATURE)]
    signs = [f"s{k}" for k in range(SIGNATURE)]
    columns = own.groupBy("sample", "col").agg(*fingerprint("row"), *signature)
    same = ["sample", *FINGERPRINT]
    sets = columns.groupBy(*same, *signs).agg(F.min("col").alias("set"))
    rows = own.withColumnRenamed("col", "set").join(sets.select("sample", "set"), ["sample", "set"], "left_semi")
    pairs = containment_pairs(rows, sets.select("sample", "set", F.col("f_n").alias("nnz"), *signs))
    of = lambda c: rows.select("sample", "row", F.col("set").alias(c))
    shared = pairs.join(of("i"), ["sample", "i"]).join(of("j"), ["sample", "j", "row"]).groupBy("sample", "i", "j", "ni").agg(F.count("*").alias("shared"))
    held = shared.where("shared = ni").select("sample", F.col("i").alias("set")).distinct()
    return columns.join(sets.join(held, ["sample", "set"], "left_semi").select(*same), same, "left_semi").select("sample", "col")


def containment_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``sample, i, j, ni``: sets ``i`` that ``j`` may hold, from ``sample, row, set`` and ``sample, set, nnz`` with signatures."""
    signs = [c for c in sets.columns if c not in ("sample", "set", "nnz")]
    held = rows.groupBy("sample", "row").agg(F.count("*").alias("n_sets"))
    rare = rows.join(held, ["sample", "row"]).groupBy("sample", "set").agg(F.min(F.struct("n_sets", "row")).alias("rare"))
    side = lambda s: sets.select("sample", F.col("set").alias(s), F.col("nnz").alias(f"n{s}"), *(F.col(c).alias(f"{s}_{c}") for c in signs))
    # a row of one set alone is in no other
    small = rare.where("rare.n_sets > 1").select("sample", F.col("set").alias("i"), F.col("rare.row").alias("row")).join(side("i"), ["sample", "i"])
    large = rows.withColumnRenamed("set", "j").join(side("j"), ["sample", "j"])
    may = F.col("nj") > F.col("ni")
    for c in signs:
        may = may & (F.col(f"i_{c}").bitwiseAND(F.bitwise_not(f"j_{c}")) == 0)
    return small.join(large, ["sample", "row"]).where(may).select("sample", "i", "j", "ni")


def without_included(system: DataFrame, cfg: AlgoConfig) -> DataFrame:
    return system.join(included(system), ["sample", "col"], "left_anti") if cfg.filter_included else system


def odd_supports(system: DataFrame) -> DataFrame:
    """Per sample, how many columns have an odd number of rows."""
    nnz = system.groupBy("sample", "col").agg(F.count("*").alias("nnz"))
    return nnz.groupBy("sample").agg(F.count_if(F.col("nnz") % 2 == 1).alias("odd"), F.count("*").alias("columns"))


def matched_totals(lik: DataFrame) -> DataFrame:
    """Per sample, all reads matched to the reference; they normalise the observations."""
    reads = lik.select("sample", "region", "seq", "n").distinct()
    return reads.groupBy("sample").agg(F.sum("n").alias("matched"))


def assemble(system: DataFrame, lik: DataFrame) -> DataFrame:
    """``sample, region, seq, row, col, a, y``: the scaled system with its right-hand side; ``row`` is a number for region and read."""
    return system.join(matched_totals(lik), "sample").select(
        "sample", "region", "seq", F.xxhash64("region", "seq").alias("row"), "col", (F.col("p") / F.col("norm")).alias("a"), (F.col("n") / F.col("matched")).alias("y"), "norm", "p", "n"
    )


def em_init(sys: DataFrame) -> DataFrame:
    """``sample, col, x``: the observations carried back, scaled to sum 1."""
    return scaled(sys.groupBy("sample", "col").agg(F.sum(F.col("a") * F.col("y")).alias("x")))


def em_step(sys: DataFrame, x: DataFrame) -> DataFrame:
    """One multiplicative update as joins and sums."""
    xs = with_rows(sys).select("sample", "row", "col", "a", "y").join(x, ["sample", "col"])
    theta = xs.groupBy("sample", "row").agg(F.sum(F.col("a") * F.col("x")).alias("theta"))
    ratio = xs.join(theta, ["sample", "row"])
    factor = ratio.groupBy("sample", "col", "x").agg(F.sum(F.col("a") * F.col("y") / (F.col("theta") + F.lit(EPS))).alias("f"))
    return factor.select("sample", "col", (F.col("x") * F.col("f")).alias("x"))


def em(sys: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """``sample, col, x, iterations``, a task per sample; those of more than ``distribute_above`` entries by blocks across tasks."""
    if cfg.distribute_above is None:
        return em_tasks(sys, cfg)
    large = sys.groupBy("sample").agg(F.count("*").alias("entries")).where(F.col("entries") > cfg.distribute_above)
    small = sys.join(large, "sample", "left_anti")
    return em_tasks(small, cfg).unionByName(solve_blocks(sys.join(large, "sample", "left_semi"), cfg))


def em_tasks(sys: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """``sample, col, x, iterations``, a task per sample."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"], ignore_index=True)
        row, rows = pd.factorize(frame["row"])
        cols, col = np.unique(frame["col"].to_numpy(), return_inverse=True)
        y = np.zeros(len(rows))
        y[row] = frame["y"]
        x, steps = em_solve(row, col, frame["a"].to_numpy(), y, cfg)
        return pd.DataFrame({"sample": frame["sample"].iloc[0], "col": cols, "x": x, "iterations": steps})

    rows = with_rows(sys).select("sample", "row", "col", "a", "y")
    return rows.groupBy("sample").applyInPandas(solve, "sample string, col long, x double, iterations int")


def frequencies(x: DataFrame, sys: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """``sample, col, freq``: per amplified region, tiny ones cut, scaled to sum 1."""
    norm = sys.select("sample", "col", "norm").distinct()
    f = x.where(F.col("x") > cfg.zero).join(norm, ["sample", "col"]).select("sample", "col", (F.col("x") / F.col("norm")).alias("x"))
    return scaled(f).withColumnRenamed("x", "freq")


def assigned_reads(sys: DataFrame, freq: DataFrame) -> DataFrame:
    """``sample, col, reads``: each read shared out by posterior, rounded in each region, then summed."""
    joint = with_rows(sys).select("sample", "region", "row", "col", "p", "n").join(freq, ["sample", "col"]).withColumn("j", F.col("p") * F.col("freq"))
    total = joint.groupBy("sample", "row").agg(F.sum("j").alias("t"))
    shares = joint.join(total, ["sample", "row"]).withColumn("r", F.col("n") * F.col("j") / (F.col("t") + F.lit(EPS)))
    by_region = shares.groupBy("sample", "col", "region").agg(F.round(F.sum("r")).cast("long").alias("r"))
    return by_region.groupBy("sample", "col").agg(F.sum("r").alias("reads"))


def amplified_regions(groups: DataFrame, ref: DataFrame) -> DataFrame:
    """Per group, which regions of its representative are amplified, in order of region."""
    reps = groups.where("bact_id = representative").select("sample", "bact_id")
    flags = ref.groupBy("bact_id").agg(
        F.sort_array(F.collect_list(F.struct("region", F.col("kmer").isNotNull().alias("amplified")))).alias("regions")
    )
    return reps.join(large(flags), "bact_id").select("sample", F.col("bact_id").alias("representative"), F.col("regions.amplified").alias("amplified"))
