"""Abundance filter, and the similarity join of reads with reference k-mers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import AlgoConfig
from strandloom.functions import dna
from strandloom.plans.staging import large


def abundant(reads: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """Reads with at least a share of their sample's and region's total, and a least count."""
    if not cfg.filter_reads:
        return reads
    totals = reads.groupBy("sample", "region").agg(F.sum("n").alias("total"))
    # one row per sample and region, so the join is cheaper than a window over all reads
    return (
        reads.join(totals, ["sample", "region"])
        .where(F.col("n") >= F.greatest(F.col("total") * cfg.min_read_freq, F.lit(cfg.min_read_count)))
        .drop("total")
    )


def _key_classes(seq: str, parts: int):
    return F.array(*(F.xxhash64(F.char_length(seq), dna.every(F.col(seq), parts, i)) for i in range(parts)))


def keyed(right: DataFrame, right_seq: str, parts: int, max_len: int) -> DataFrame:
    """The right side of ``hamming_join``: a row for each class of places, with its key."""
    words = dna.n_words(max_len)
    b = right.withColumn("_kb", _key_classes(right_seq, parts)).withColumn("_pb", dna.pack(F.col(right_seq), words))
    return b.select("*", F.posexplode("_kb").alias("_i", "_key"))


def hamming_join(left: DataFrame, right: DataFrame, on: list[str], left_seq: str, right_seq: str, cut: int, max_len: int, max_ns: int = 0) -> DataFrame:
    """All pairs of rows equal in ``on`` whose sequences differ in at most ``cut`` places; adds ``d``.

    Places are dealt into ``cut + 1`` interleaved classes (more if reads may
    hold N).  Pairs within the limit agree wholly in one class at least, so
    equal classes are the join key; conserved stretches lie in all classes
    alike.  A pair found in several classes is kept for the first one only, so
    no distinct is needed.
    """
    return hamming_join_keyed(left, keyed(right, right_seq, cut + max_ns + 1, max_len), on, left_seq, right_seq, cut, max_len, max_ns)


def hamming_join_keyed(left: DataFrame, right: DataFrame, on: list[str], left_seq: str, right_seq: str, cut: int, max_len: int, max_ns: int = 0) -> DataFrame:
    """``hamming_join`` with a right side that is ``keyed`` already, and perhaps laid out by its keys."""
    parts, words = cut + max_ns + 1, dna.n_words(max_len)
    a = left.withColumn("_ka", _key_classes(left_seq, parts)).withColumn("_pa", dna.pack(F.col(left_seq), words)).withColumn("_ma", dna.n_mask(F.col(left_seq), words))
    a = a.select("*", F.posexplode("_ka").alias("_i", "_key"))
    same = F.array(*(F.get("_ka", F.lit(i)) == F.get("_kb", F.lit(i)) for i in range(parts)))
    d = dna.hamming(F.col("_pa"), F.col("_pb"), words, F.col("_ma") if max_ns else None)
    return (
        a.join(right, [*on, "_i", "_key"])
        # keys hold the length; as an equality of either side's it would be a join key that no bucket is laid out by
        .where(F.char_length(left_seq) - F.char_length(right_seq) == 0)
        .where(F.array_position(same, True) - 1 == F.col("_i"))
        .withColumn("d", d)
        .where(F.col("d") <= cut)
        .drop("_i", "_key", "_ka", "_kb", "_pa", "_pb", "_ma")
    )


def matches(reads: DataFrame, known: DataFrame, cfg: AlgoConfig, max_len: int) -> DataFrame:
    """``sample, region, seq, n, kmer_id, kmer, d``: all k-mers within the cut, not only the nearest."""
    return hamming_join(reads, known, ["region"], "seq", "kmer", cfg.n_mm_cut, max_len, cfg.max_num_ns)


@dataclass(frozen=True)
class Catalogue:
    """A reference laid out once for the joins of every batch.

    ``keys`` are k-mers bucketed by region, class of places and key, ``of`` says
    which bacteria have them, bucketed by region and k-mer.  A batch then
    shuffles its reads and matches alone, never the reference.
    """

    keys: DataFrame
    of: DataFrame
    cut: int
    max_ns: int
    max_len: int

    @staticmethod
    def write(known: DataFrame, of: DataFrame, name: str, path: str, cfg: AlgoConfig, max_len: int, buckets: int) -> Catalogue:
        """Lay the reference out below ``path``, as tables that begin with ``name``.

        As many buckets as shuffles have partitions, or more: with fewer, a join
        may rather shuffle both sides.
        """
        parts = cfg.n_mm_cut + cfg.max_num_ns + 1
        for what, rows, by in (("keys", keyed(known, "kmer", parts, max_len), ["region", "_i", "_key"]), ("of", of, ["region", "kmer_id"])):
            writer = rows.repartition(buckets, *by).write.mode("overwrite").option("path", f"{path}/{what}")
            writer.bucketBy(buckets, *by).sortBy(*by).saveAsTable(f"{name}_{what}")
        return Catalogue.read(known.sparkSession, name, cfg, max_len)

    @staticmethod
    def read(spark, name: str, cfg: AlgoConfig, max_len: int) -> Catalogue:
        keys = spark.table(f"{name}_keys")
        parts = len(keys.select("_kb").first()[0]) if keys.limit(1).count() else 0
        if parts and parts != cfg.n_mm_cut + cfg.max_num_ns + 1:
            raise ValueError(f"{name} was laid out for {parts} classes")
        return Catalogue(keys, spark.table(f"{name}_of"), cfg.n_mm_cut, cfg.max_num_ns, max_len)

    def matches(self, reads: DataFrame) -> DataFrame:
        return hamming_join_keyed(reads, self.keys, ["region"], "seq", "kmer", self.cut, self.max_len, self.max_ns)

    def likelihoods(self, found: DataFrame, cfg: AlgoConfig) -> DataFrame:
        return likelihoods(found, self.of, cfg)


def likelihoods(found: DataFrame, of: DataFrame, cfg: AlgoConfig) -> DataFrame:
    """``sample, region, seq, bact_id, n, len, d, p``: chances summed over a bacterium's k-mers; ``d`` the least."""
    p = dna.likelihood(F.char_length("seq"), F.col("d"), cfg.pe)
    weight = F.col("weight") if "weight" in of.columns else F.lit(1.0)
    return (
        found.join(large(of), ["region", "kmer_id"])
        .groupBy("sample", "region", "seq", "bact_id")
        .agg(F.first("n").alias("n"), F.min("d").alias("d"), F.sum(p * weight).alias("p"))
        .withColumn("len", F.char_length("seq"))
        .where("p > 0")
    )


def match_stats(reads: DataFrame, found: DataFrame) -> DataFrame:
    """Matched and unmatched reads by sample and region."""
    hit = found.select("sample", "region", "seq").distinct().withColumn("hit", F.lit(True))
    marked = reads.join(hit, ["sample", "region", "seq"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return marked.groupBy("sample", "region").agg(
        F.count_if("hit").alias("matched_unique"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched_reads"),
        F.coalesce(F.max(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("max_unmatched"),
        F.count_if(~F.col("hit")).alias("unmatched_unique"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("unmatched_reads"),
    )
