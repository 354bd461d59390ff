"""From read files to reports: one plan for all samples of a batch."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import Config, db_paths, get_config
from strandloom.operators import match, qc, refdb, regions, report, solve, stats, taxonomy
from strandloom.sources import additive, files, reference, sinks, splits

log = logging.getLogger("strandloom")


@dataclass
class Profile:
    """Tables of all stages; each is lazy and may be registered as a view."""

    qc: DataFrame
    unireads: DataFrame
    region_reads: DataFrame
    filtered: DataFrame
    matches: DataFrame
    lik: DataFrame
    groups: DataFrame
    system: DataFrame
    found: DataFrame
    members: DataFrame
    levels: DataFrame
    stats: stats.ReadStats

    def register(self, prefix: str = "") -> None:
        for name, value in vars(self).items():
            (value.rows if isinstance(value, stats.ReadStats) else value).createOrReplaceTempView(prefix + name)


def profile(reads: DataFrame, ref: DataFrame, taxa: DataFrame, cfg: Config, keep=lambda df, name: df) -> Profile:
    """All stages. ``keep(df, name)`` may write a stage and read it back."""
    return profile_tally(keep(qc.tally(reads, cfg.prep), "tally"), ref, taxa, cfg, keep)


def profile_tally(tallied: DataFrame, ref: DataFrame, taxa: DataFrame, cfg: Config, keep=lambda df, name: df, catalogue: match.Catalogue | None = None) -> Profile:
    """All stages from a tally of the reads on, which may come from a store of many batches.

    A ``catalogue`` is ``ref`` laid out for the joins, so that no batch shuffles it.
    """
    spark = tallied.sparkSession
    counted = keep(qc.tally_counts(tallied, cfg.prep), "qc")
    uni = keep(qc.tally_uniques(tallied), "unireads")
    region_reads = keep(regions.collapse(regions.assign(uni, cfg.prep, cfg.primers)), "region_reads")
    filtered = keep(match.abundant(region_reads, cfg.algo), "filtered")
    ref = refdb.subsample(ref, cfg.algo.prob_amp, cfg.algo.seed)
    if catalogue:
        found = keep(catalogue.matches(filtered), "matches")
        lik = keep(catalogue.likelihoods(found, cfg.algo), "lik")
    else:
        known = refdb.kmers(ref)
        found = keep(match.matches(filtered, known, cfg.algo, 2 * cfg.prep.read_len), "matches")
        lik = keep(match.likelihoods(found, refdb.bact_kmers(ref, known), cfg.algo), "lik")
    norm = refdb.amplified(ref)
    groups = keep(solve.ambiguity_groups(lik, solve.present_everywhere(lik, ref, norm, cfg.algo)), "groups")
    system = keep(solve.assemble(solve.without_included(solve.supports(lik, groups), cfg.algo), lik), "system")
    freq = keep(solve.frequencies(solve.em(system, cfg.algo), system, cfg.algo), "freq")
    result = freq.join(solve.assigned_reads(system, freq), ["sample", "col"]).withColumnRenamed("col", "group_id")
    members = groups.select("sample", F.col("representative").alias("group_id"), "bact_id").join(result.select("sample", "group_id"), ["sample", "group_id"], "left_semi")
    sizes = lambda df: regions.totals(df, counted, cfg.regions)
    table = stats.funnel_stats(spark, counted, sizes(region_reads), sizes(filtered), match.match_stats(filtered, found))
    return Profile(counted, uni, region_reads, filtered, found, lik, groups, system, result, members, taxonomy.levels(members, taxa), table)


def run(
    spark: SparkSession,
    reads_dir: str,
    db_dir: str,
    db_name: str,
    results: str,
    kmer_len: int | str = 100,
    generate_group_results: bool = False,
    cfg: Config | None = None,
    flat: bool = False,
    store: str | None = None,
) -> dict[str, str]:
    """Profile every sample below ``reads_dir`` and write the reports; returns their paths.

    Without a taxonomy only ``groups`` is reported; with one ``species`` is, and
    ``groups`` too if group results are asked for.  With a ``store`` only files
    that it has not are read; they join it, and all it holds is profiled.
    """
    cfg = cfg or get_config(kmer_len)
    out_dir = os.path.dirname(results)
    if "://" not in results and out_dir and not os.path.isdir(out_dir):
        log.error("no such folder: %s", out_dir)
        return {}
    good, bad = files.skip_invalid(spark, reads_dir, cfg.prep.paired)
    for d in [] if flat else bad:
        log.warning("skipped %s: no read files, an odd number, or a first one without its second", d)
    if not flat and not good:
        log.error("no sample below %s", reads_dir)
    skip = [] if flat else bad
    paths = db_paths(db_dir, db_name)
    halves = reference.read_reference(spark, paths["regions"], list(cfg.regions))
    ref = refdb.project(halves, cfg.prep.read_len, cfg.algo.const_len, cfg.prep.with_primer, cfg.primers)
    ref = refdb.check_lengths(ref, refdb.read_lengths(cfg.prep.read_len, cfg.prep.with_primer, cfg.algo.const_len, cfg.primers))
    catalog = reference.read_catalog(spark, db_dir, db_name, generate_group_results)
    taxa, known = reference.read_taxonomy(spark, db_dir, catalog)
    stages = f"{results}_stages"
    sinks.clear(spark, results, stages)
    keep = lambda df, name: sinks.save_stage(df, f"{stages}/{name}")
    if store:
        kept = additive.UniqueStore(spark, store)
        new = kept.missing([p.r1 for p in files.read_pairs(reads_dir, cfg.prep.paired, flat, skip)])
        if new:
            kept.add(new, splits.read_files(spark, reads_dir, cfg.prep.paired, flat, skip, only=new), cfg.prep)
        found = profile_tally(kept.tally(), ref, taxa, cfg, keep)
    else:
        found = profile(splits.read_files(spark, reads_dir, cfg.prep.paired, flat, skip), ref, taxa, cfg, keep)
    sinks.write_unique_fasta(found.unireads, f"{stages}/unique_fasta")
    samples = sorted(r["sample"] for r in found.qc.select("sample").collect())
    sources = report.group_sources(found.members, catalog) if cfg.report.print_resolution else None
    report_levels = (["species", "groups"] if generate_group_results else ["species"]) if known else ["groups"]
    written = {}
    for name in report_levels:
        level = 8 if name == "groups" else 7
        top = taxonomy.majority(found.levels, found.found, level)
        total = {r["sample"]: r["reads"] for r in report.totals(top, found.qc.select("sample")).collect()}
        by = report.taxa(top, cfg.report)
        written[name] = sinks.report_path(results, name)
        sinks.write_table(report.community_rows(report.pivot(by, samples), samples, total, level, cfg.report), written[name])
        if sources is not None:
            sizes = report.mean_sources(top, sources, strict=True).join(by.select("path").distinct(), "path", "left_semi")
            wide = report.pivot(sizes.withColumn("mean_sources", F.round("mean_sources")), samples, "mean_sources")
            written[f"{name} sizes"] = sinks.report_path(results, name, "GroupSizes_")
            rows = report.community_rows(wide, samples, total, level, replace(cfg.report, write_counts=False))
            sinks.write_table(rows, written[f"{name} sizes"])
    table = report.funnel(found.stats.rows, samples, cfg.regions).orderBy("sample")
    rows = [["Sample name", *table.columns[1:]]] + [[r[0], *("NaN" if v is None else str(v) for v in r[1:])] for r in table.collect()]
    for r in rows[1:]:
        log.info("%s", report.progress(dict(zip(rows[0], r, strict=True)), cfg.regions))
    written["stats"] = sinks.stats_path(results)
    sinks.write_table(rows, written["stats"])
    if generate_group_results:
        sinks.write_group_fasta(found.members, catalog, f"{stages}/group_fasta")
    return written


