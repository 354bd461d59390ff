"""Quality control of reads, and collapse of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import PrepConfig
from strandloom.functions import dna


def long_enough(s: Column, cfg: PrepConfig) -> Column:
    return F.char_length(s) >= cfg.read_len


def good_read(s: Column, q: Column, low_q: Column, cfg: PrepConfig) -> Column:
    """Few ambiguous letters, enough bases above the threshold, few very bad ones; no qualities pass."""
    s, q, low_q = (F.substring(x, 1, cfg.read_len) for x in (s, q, low_q))
    share = dna.high_quality(q, cfg.qual_th) / F.lit(cfg.read_len)
    by_quality = (share >= cfg.prc_high_qual) & (dna.low_quality(low_q) < cfg.low10_th)
    return (dna.ambiguous(s) <= cfg.max_num_ns) & F.coalesce(by_quality, F.lit(True))


def checked(reads: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Adds ``is_long`` and ``is_good``; pairs need both mates."""
    if not cfg.paired:
        ok = long_enough(F.col("s1"), cfg)
        return reads.withColumns({"is_long": ok, "is_good": ok & good_read(F.col("s1"), F.col("q1"), F.col("q1"), cfg)})
    ok = long_enough(F.col("s1"), cfg) & long_enough(F.col("s2"), cfg)
    low2 = F.col("q1" if cfg.r2_low_quality_from == "r1" else "q2")
    good = good_read(F.col("s1"), F.col("q1"), F.col("q1"), cfg) & good_read(F.col("s2"), F.col("q2"), low2, cfg)
    return reads.withColumns({"is_long": ok, "is_good": ok & good})


def counts(reads: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Loaded, long and good reads of each sample, in one pass."""
    return checked(reads, cfg).groupBy("sample").agg(
        F.count("*").alias("loaded"),
        F.count_if("is_long").alias("long"),
        F.count_if("is_good").alias("good"),
    )


def good_reads(reads: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Reads that pass, cut to length: pairs as ``r1, r2``, or single ends stacked as ``r1``."""
    good = checked(reads, cfg).where("is_good")
    cut = lambda c: F.substring(c, 1, cfg.read_len)
    if not cfg.paired:
        return good.select("sample", cut("s1").alias("r1"), F.lit("").alias("r2"))
    if cfg.dest_paired:
        return good.select("sample", cut("s1").alias("r1"), cut("s2").alias("r2"))
    return good.select("sample", F.explode(F.array(cut("s1"), cut("s2"))).alias("r1"), F.lit("").alias("r2"))


def unique_reads(good: DataFrame) -> DataFrame:
    """``sample, r1, r2, n``; counts combine before the shuffle."""
    return good.groupBy("sample", "r1", "r2").agg(F.count("*").alias("n"))


def tally(reads: DataFrame, cfg: PrepConfig) -> DataFrame:
    """``sample, is_long, is_good, r1, r2, n``: unique good reads, and how many others, in one pass over the reads.

    Read counts and unique reads are both sums of it, so files are parsed once.
    Partial tallies of disjoint reads add up.
    """
    cut = lambda c: F.substring(c, 1, cfg.read_len)
    pair = lambda a, b: F.struct(a.alias("r1"), b.alias("r2"))
    if not cfg.paired:
        own = F.array(pair(cut("s1"), F.lit("")))
    elif cfg.dest_paired:
        own = F.array(pair(cut("s1"), cut("s2")))
    else:
        own = F.array(pair(cut("s1"), F.lit("")), pair(cut("s2"), F.lit("")))
    null = F.lit(None).cast("string")
    rows = checked(reads, cfg).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_long", "is_good")})
    ends = rows.select("sample", "is_long", "is_good", F.inline(F.when(F.col("is_good"), own).otherwise(F.array(pair(null, null)))))
    return ends.groupBy("sample", "is_long", "is_good", "r1", "r2").agg(F.count("*").alias("n"))


def tally_counts(tallied: DataFrame, cfg: PrepConfig) -> DataFrame:
    """What ``counts`` gives, from a tally; a pair stacked as single ends is in it twice."""
    ends = 2 if cfg.paired and not cfg.dest_paired else 1
    n = F.when(F.col("is_good"), F.col("n") / ends).otherwise(F.col("n")).cast("long")
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    # ends are summed before they are halved, as an end may be odd in number
    by = tallied.groupBy("sample", "is_long", "is_good").agg(F.sum("n").alias("n")).withColumn("n", n)
    return by.groupBy("sample").agg(F.sum("n").alias("loaded"), of("is_long").alias("long"), of("is_good").alias("good"))


def tally_uniques(tallied: DataFrame) -> DataFrame:
    """What ``unique_reads`` gives, from a tally."""
    return tallied.where("is_good").groupBy("sample", "r1", "r2").agg(F.sum("n").alias("n"))
