"""The reference: k-mers of amplified regions, and who shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import AlgoConfig, primers
from strandloom.operators.match import hamming_join
from strandloom.operators.ordinal import ordinals
from strandloom.plans.staging import large, stage


def project(values: DataFrame, read_len: int, const_len: bool = False, with_primer: bool = False, rows=None) -> DataFrame:
    """Database halves to reads of ``read_len``: ``values`` is forward half and reverse half in one text.

    Without primers, either half loses its primer; with constant length, the
    windows after the primers are as long as a read.
    """
    p = primers(rows) if rows else primers()
    of = lambda f: F.create_map(*(F.lit(x) for r in p for x in (r.region, f(r))))[F.col("region")]
    zero = F.lit(0)
    pf, pr = (zero, zero) if with_primer else (of(lambda r: len(r.forward)), of(lambda r: len(r.reverse)))
    v, n, k = F.col("kmer"), F.char_length("kmer"), F.lit(read_len)
    if const_len:
        cut = F.concat(F.substring(v, pf + 1, k), F.substring(v, n - pr - k + 1, k))
    else:
        cut = F.concat(F.substring(v, pf + 1, k - pf), F.substring(v, n - k + 1, k - pr))
    return values.withColumn("kmer", cut)


def kmers(ref: DataFrame) -> DataFrame:
    """Distinct k-mers with ids in sorted order from 1 within a region."""
    return ordinals(ref.where("kmer is not null").select("region", "kmer").distinct(), ["region"], ["kmer"], "kmer_id")


def bact_kmers(ref: DataFrame, known: DataFrame) -> DataFrame:
    """``bact_id, region, kmer_id``: every k-mer here has a bacterium and the other way round."""
    return large(ref.where("kmer is not null")).join(known, ["region", "kmer"]).select("bact_id", "region", "kmer_id")


def augment(reads: DataFrame, known: DataFrame, of: DataFrame, cfg: AlgoConfig, max_len: int, least: int, limit: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The k-mers and ``bact_kmers`` grown by frequent reads close to them.

    A read above ``least`` in a sample, whose nearest k-mer is 1 to ``limit`` away,
    joins with the bacteria of its nearest k-mers.  Then others may be near it, for
    at most so many rounds, or until none joins.  K-mers keep their ids; new ones
    get the next, in order within a round.  Reads that an older k-mer is near have
    joined, or are known, so a round compares the others with its newest k-mers only.
    """
    waiting = stage(reads.where(F.col("n") > least).select("region", "seq").distinct(), "augment-reads")
    newest = known = stage(known.select("region", "kmer", "kmer_id"), "augment-kmers")
    of = stage(of, "augment-of")
    for _ in range(rounds):
        near = hamming_join(waiting, newest, ["region"], "seq", "kmer", limit, max_len, cfg.max_num_ns).select("region", "seq", "kmer_id", "d")
        near = stage(near, "augment-near")
        nearest = near.groupBy("region", "seq").agg(F.min("d").alias("d"))
        joined = ordinals(nearest.where("d > 0").select("region", "seq"), ["region"], ["seq"], "i")
        top = known.groupBy("region").agg(F.max("kmer_id").alias("top"))
        new = stage(joined.join(top, "region").select("region", F.col("seq").alias("kmer"), (F.col("i") + F.col("top")).cast("int").alias("kmer_id")), "augment-new")
        if not new.limit(1).count():
            break
        ids = new.select("region", F.col("kmer").alias("seq"), F.col("kmer_id").alias("new_id"))
        carried = near.join(nearest, ["region", "seq", "d"]).join(ids, ["region", "seq"]).join(of, ["region", "kmer_id"])
        of = stage(of.unionByName(carried.select(*(F.col("new_id").alias(c) if c == "kmer_id" else c for c in of.columns)).distinct()), "augment-of")
        known = stage(known.unionByName(new), "augment-kmers")
        waiting = stage(waiting.join(near.select("region", "seq").distinct(), ["region", "seq"], "left_anti"), "augment-reads")
        newest = new
    return known, of


def amplified(ref: DataFrame) -> DataFrame:
    """Per bacterium, how many regions are amplified."""
    return ref.groupBy("bact_id").agg(F.count("kmer").alias("norm"))


def mean_amplified(ref: DataFrame) -> DataFrame:
    return ref.groupBy("region").agg(F.avg(F.col("kmer").isNotNull().cast("int")).alias("mean_amplified"))


def subsample(ref: DataFrame, prob_amp: float, seed: int) -> DataFrame:
    """Drop amplified regions at random, so that about ``prob_amp`` of all stay; 1 keeps all.

    The draw is a digest of seed, bacterium and region, so it is the same in every run.
    """
    if prob_amp >= 1:
        return ref
    share = ref.select(F.avg(F.col("kmer").isNotNull().cast("int")).alias("share"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bact_id").cast("string"), F.col("region").cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)
    keep = draw < F.lit(prob_amp) / F.col("share")
    return ref.crossJoin(F.broadcast(share)).withColumn("kmer", F.when(keep, F.col("kmer"))).drop("share")


def read_lengths(read_len: int, with_primer: bool = False, const_len: bool = False, rows=None) -> dict[int, int]:
    """How long the reads of each region are once their primers are cut."""
    cut = not (with_primer or const_len)
    return {p.region: 2 * read_len - cut * (len(p.forward) + len(p.reverse)) for p in (primers(rows) if rows else primers())}


def check_lengths(ref: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """The reference, or an error when read where a k-mer's length differs from the reads'."""
    want = F.create_map(*(F.lit(x) for item in lengths.items() for x in item))[F.col("region")]
    ok = F.col("kmer").isNull() | (F.char_length("kmer") == want)
    return ref.withColumn("kmer", F.when(ok, F.col("kmer")).otherwise(F.raise_error(F.lit("k-mer and read lengths differ"))))


def fingerprint(*cols) -> list:
    """A set of rows as constant-size sums, whatever their order: equal sets, equal values.

    The sums combine before a shuffle, where lists of rows would not.
    """
    return [
        F.count("*").alias("f_n"),
        F.bit_xor(F.xxhash64(*cols)).alias("f_x"),
        F.sum(F.xxhash64(F.lit(7), *cols).cast("decimal(20,0)")).alias("f_s"),
    ]


FINGERPRINT = ["f_n", "f_x", "f_s"]


def classes(ref: DataFrame) -> DataFrame:
    """Bacteria that no region tells apart: ``bact_id, class_id``, the smallest member."""
    prints = ref.groupBy("bact_id").agg(*fingerprint("region", F.coalesce("kmer", F.lit("-")), "is_perfect_match"))
    least = prints.groupBy(*FINGERPRINT).agg(F.min("bact_id").alias("class_id"))
    return large(prints).join(least, FINGERPRINT).select("bact_id", "class_id")


#: Parts that the members of a class are dealt into.
DEAL = 16


def least_members(ref: DataFrame, of_class: DataFrame) -> DataFrame:
    """The reference of one bacterium a class, which stands for all of it until ``each_member``."""
    return ref.join(large(of_class.where("bact_id = class_id").select("bact_id")), "bact_id", "left_semi")


def each_member(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """Rows of least members, once for every bacterium of the class: ``bact_id`` and the other columns.

    A class is dealt into parts, so no task has all of a large one.  Few rows may
    become many here; with a number of partitions given, small ones are not merged.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumnRenamed("bact_id", "class_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    right = of_class.withColumn("_part", F.pmod(F.xxhash64("bact_id"), F.lit(DEAL)).cast("int"))
    by = ["class_id", "_part"]
    return left.repartition(n, *by).join(large(right.repartition(n, *by)), by).drop(*by)


def halves(ref: DataFrame, fwd_len: int) -> DataFrame:
    """Single ends: each half a k-mer of its own, weighing one by the number of distinct halves."""
    ends = ref.where("kmer is not null").select(
        "bact_id",
        "region",
        F.explode(F.array(F.substring("kmer", 1, fwd_len), F.expr(f"substring(kmer, {fwd_len + 1})"))).alias("kmer"),
    )
    ends = ends.distinct()
    per = ends.groupBy("bact_id", "region").agg(F.count("*").alias("n_halves"))
    return ends.join(per, ["bact_id", "region"]).withColumn("weight", 1 / F.col("n_halves"))
