"""Cross-sample tables and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.config import EPS, FILTERED, GLOBAL_METRICS, GOOD, LOADED, MAPPED, MATCHED, RANKS, REGION_METRICS, ReportConfig
from strandloom.functions.dna import significant
from strandloom.plans.staging import large

PREFIXES = "kpcofgs"


def shorten(name: Column) -> Column:
    """A sample name up to its last underscore."""
    return F.regexp_replace(name, "_[^_]*$", "")


def shortened(samples: list[str], cfg: ReportConfig) -> list[str]:
    """Sample names as a report prints them; two that would look alike stay as they are."""
    short = [s.rpartition("_")[0] or s for s in samples]
    return [x if short.count(x) == 1 else s for x, s in zip(short, samples, strict=True)] if cfg.shorten_names else samples


def progress(funnel_row: dict, regions=(1, 2, 3, 4, 5)) -> str:
    """How much of a sample each step kept, from its row of the funnel."""
    n = lambda m: sum(int(funnel_row[f"{m} {r}"]) for r in regions if str(funnel_row[f"{m} {r}"]).isdigit())
    steps = [("good", int(funnel_row[GOOD]), int(funnel_row[LOADED])), ("mapped", n(MAPPED), int(funnel_row[GOOD]))]
    steps += [("above the abundance filter", n(FILTERED), n(MAPPED)), ("matched", n(MATCHED), n(FILTERED))]
    return f"{funnel_row['Sample name']}: " + ", ".join(f"{100 * a / b:.0f}% {name}" if b else f"none {name}" for name, a, b in steps)


def mark_passed(top: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Drops rare groups and adds ``passed``: the most frequent that together reach the cut, with the one that passes it."""
    up_to = Window.partitionBy("sample").orderBy(F.desc("freq"), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = top.where(F.col("freq") >= cfg.min_freq)
    return kept.withColumn("passed", F.coalesce(F.sum("freq").over(up_to), F.lit(0.0)) <= cfg.cut_freq_th)


def taxa(top: DataFrame, cfg: ReportConfig) -> DataFrame:
    """``sample, path, freq, passed``: groups of one lineage added up; lineages that pass in no sample are gone."""
    f = significant(F.col("freq")) if cfg.five_digits else F.col("freq")
    by = mark_passed(top, cfg).groupBy("sample", "path").agg(F.sum(f).alias("freq"), F.count_if("passed").alias("passed"))
    alive = by.where("passed > 0").select("path").distinct()
    return by.join(alive, "path", "left_semi")


def renamed(path: Column) -> Column:
    """Names as printed; done after lineages are told apart, so two may look alike."""
    return F.transform(path, lambda x: F.replace(x, F.lit("Assigned"), F.lit("Unknown")))


def lineage_name(path: Column) -> Column:
    """``k__a;p__b``, with underscores for blanks."""
    parts = F.transform(path, lambda x, i: F.concat(F.substring(F.lit(PREFIXES), i + 1, F.lit(1)), F.lit("__"), x))
    return F.replace(F.array_join(parts, ";"), F.lit(" "), F.lit("_"))


def pivot(by: DataFrame, samples: list[str], value: str = "freq") -> DataFrame:
    """Lineages by samples; 0 where a sample has none of one."""
    wide = by.groupBy("path").pivot("sample", samples).agg(F.sum(value))
    return wide.na.fill(0, [s for s in samples if s in wide.columns])


def totals(top: DataFrame, samples: DataFrame) -> DataFrame:
    """Reads of each sample: of each group the majority lineage's share; 0 for an empty sample."""
    return samples.join(top.groupBy("sample").agg(F.sum("reads").alias("reads")), "sample", "left").na.fill(0, ["reads"])


def counts(by: DataFrame, total: DataFrame) -> DataFrame:
    """Frequencies as reads, rounded."""
    return by.join(total, "sample").select("sample", "path", F.round(F.col("freq") * F.col("reads")).cast("long").alias("count"))


def group_sources(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """``sample, group_id, headers``: all source headers of a group's members."""
    return (
        members.join(large(catalog.select("bact_id", "headers")), "bact_id")
        .groupBy("sample", "group_id")
        .agg(F.flatten(F.collect_list("headers")).alias("headers"))
    )


def matched_sources(top: DataFrame, sources: DataFrame) -> DataFrame:
    """Groups with their headers; an error when read where a group has no headers, or headers no group.

    The check is part of the join that the report needs anyway, so it costs no pass of its own.
    """
    both = top.withColumn("_top", F.lit(True)).join(sources, ["sample", "group_id"], "full")
    name = F.concat_ws(" ", F.col("sample"), F.col("group_id").cast("string"))
    wrong = F.raise_error(F.concat(F.lit("numbers of answers and headers differ: "), name))
    return both.where(F.when(F.col("_top").isNull() | F.col("headers").isNull(), wrong.cast("boolean")).otherwise(True)).drop("_top")


def mean_sources(top: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """Mean number of distinct sources of a lineage, weighted by frequency; variants of a source share its whole number.

    ``strict`` asks that groups and headers match one to one.
    """
    n = F.size(F.array_distinct(F.transform("headers", lambda h: F.floor(h))))
    w = (matched_sources(top, sources) if strict else top.join(sources, ["sample", "group_id"])).withColumn("n", n)
    return w.groupBy("sample", "path").agg((F.sum(F.col("freq") * F.col("n")) / (F.sum("freq") + F.lit(EPS))).alias("mean_sources"))


def funnel(stats: DataFrame, samples: list[str] | None = None, regions=(1, 2, 3, 4, 5)) -> DataFrame:
    """A row per sample, a column per metric and region; what is missing is null."""
    heads = [(m, None) for m in GLOBAL_METRICS] + [(m, r) for r in regions for m in REGION_METRICS]
    pick = lambda m, r: F.max(
        F.when((F.col("metric") == m) & (F.col("region").isNull() if r is None else F.col("region") == r), F.col("n_reads"))
    ).alias(m if r is None else f"{m} {r}")
    return stats.groupBy("sample").agg(*(pick(m, r) for m, r in heads))


def cell(value) -> str:
    """A table cell as text: six decimals for numbers, nothing for nothing."""
    if value is None:
        return ""
    return f"{value:f}" if isinstance(value, (int, float)) else str(value)


def line(cells: list, delimiter: str = "\t") -> str:
    return delimiter.join(map(cell, cells))


def line_column(cols: list[Column], kinds: list[str], delimiter: str = "\t") -> Column:
    """A row as text, on the JVM."""
    out = [F.format_string("%.6f", c.cast("double")) if k != "string" else F.coalesce(c, F.lit("")) for c, k in zip(cols, kinds, strict=True)]
    return F.concat_ws(delimiter, *out)


def community_rows(wide: DataFrame, samples: list[str], total: dict[str, int], level: int, cfg: ReportConfig | None = None) -> list[list]:
    """The community report as rows of cells, headers first. The table is one row per lineage found."""
    cfg = cfg or ReportConfig()
    names, shown = [*RANKS, "groups"][:level], shortened(samples, cfg)
    rows = wide.orderBy("path").withColumn("path", renamed(F.col("path"))).collect()
    if not cfg.write_counts:
        head = [["Total # of reads", *[""] * (level - 1), *(str(total[s]) for s in samples)], [*names, *shown]]
        return head + [[*r["path"], *(float(r[s]) for s in samples)] for r in rows]
    n = {id(r): [float(int(r[s] * total[s] + 0.5)) for s in samples] for r in rows}
    if cfg.lineage_prefixes:
        head = [["Total # of reads", "", *(str(total[s]) for s in samples)], ["Taxonomy", "Count", *shown]]
        name = lambda p: ";".join(f"{a}__{b}" for a, b in zip(PREFIXES, p, strict=False)).replace(" ", "_")
        return head + [[name(r["path"]), sum(n[id(r)]), *n[id(r)]] for r in rows]
    head = [["Total # of reads", *[""] * level, *(str(total[s]) for s in samples)], [*names, "Count", *shown]]
    return head + [[*r["path"], sum(n[id(r)]), *n[id(r)]] for r in rows]
