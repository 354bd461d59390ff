import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from strandloom.config import Config, PrepConfig, ReportConfig
from strandloom.operators import refdb, report
from strandloom.operators.ordinal import ordinals
from strandloom.plans import catalog, fixture, profile
from strandloom.sources import additive, files, reference, sinks, splits

DATA = "/root/testdata/sf0.001"


def fastq(rows):
    return "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)


def test_sample_names(spark):
    names = {"RDB123_ATGAGTGC_L001_R1_001.fastq.gz": "RDB123_ATGAGTGC", "S_R5_L001_R1_001.fastq": "", "plain.fastq": "", "A_L001_X_R1.fastq": ""}
    assert {n: files.sample_name(n) for n in names} == names
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.s for r in df.select("name", files.sample_name_column(F.col("name")).alias("s")).collect()} == names
    with pytest.raises(ValueError):
        files.sample_name("a_L001_L002_R1_.fastq")


def test_reads_of_all_kinds(spark, tmp_path):
    one, two = [("a", "ACGT", "IIII"), ("b", "GGTT", "!!!!")], [("a", "TTTT", "IIII"), ("b", "CCCC", "####")]
    for sample in "XYZ":
        (tmp_path / sample).mkdir()
    for n, rows in ((1, one), (2, two)):
        (tmp_path / f"X/X_L001_R{n}_001.fastq").write_text(fastq(rows))
        with gzip.open(tmp_path / f"Y/Y_L001_R{n}_001.fastq.gz", "wt") as f:
            f.write(fastq(rows))
        with zipfile.ZipFile(tmp_path / f"Z/Z_L001_R{n}_001.fastq.zip", "w") as z:
            z.writestr("x.fastq", fastq(rows))
    got = files.read_files(spark, str(tmp_path)).select("sample", "record_no", "s1", "q1", "s2", "q2").collect()
    assert sorted(map(tuple, got)) == sorted((s, i, a[1], a[2], b[1], b[2]) for s in "XYZ" for i, (a, b) in enumerate(zip(one, two, strict=True)))
    (tmp_path / "Q").mkdir()
    (tmp_path / "Q/q_L001_R1_001.fastq").write_text(fastq(one))
    with pytest.raises(Exception, match="no second reads"):
        files.read_files(spark, str(tmp_path)).count()
    good, bad = files.skip_invalid(spark, str(tmp_path))
    assert [d.rsplit("/", 1)[-1] for d in good] == ["X", "Y", "Z"] and len(bad) == 1
    # the file's name gives the sample, not the directory's
    skipped = files.read_files(spark, str(tmp_path), skip=bad)
    assert {r["sample"] for r in skipped.select("sample").distinct().collect()} == set("XYZ")


def test_single_fasta(spark, tmp_path):
    (tmp_path / "s.fasta").write_text(">a b\nACG\nT\n>c\nGG\n")
    got = files.read_files(spark, str(tmp_path), paired=False).select("h1", "s1", "q1").collect()
    assert [tuple(r) for r in got] == [("a b", "ACGT", None), ("c", "GG", None)]


def test_reference_projection(spark):
    halves = spark.createDataFrame([(1, 1, "A" * 18 + "CGT" + "T" * 139 + "G" * 139 + "ACC" + "C" * 19 + "", True)], "bact_id long, region int, kmer string, is_perfect_match boolean")
    out = refdb.project(halves, 20).first().kmer
    assert len(out) == 2 * 20 - 18 - 19 and out.startswith("CG")


@pytest.mark.parametrize("name", ["q03_flat_names", "q11_iupac_expand", "q15_abundance_filter", "q19_fuzzy_match", "q26_inclusion_filter", "q31_read_assignment", "q34_taxa_pivot", "q39_stats_funnel"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_whole_profile_from_files(spark, tmp_path):
    """Files to reports, with the fixture's reads and reference."""
    t = fixture.tables(spark, DATA)
    reads = t["reads"].where("sample in ('S0', 'S1')").toPandas()
    for s, own in reads.groupby("sample"):
        d = tmp_path / "in" / s
        d.mkdir(parents=True)
        for n in (1, 2):
            with gzip.open(d / f"{s}_L001_R{n}_001.fastq.gz", "wt") as f:
                f.write(fastq(zip(own["pair_key"], own[f"s{n}"], own[f"q{n}"], strict=True)))
    # the database holds halves with primers, as long as reads
    p = t["primers"]
    full = F.when(F.col("kmer").isNotNull(), F.concat("f", F.expr("substring(kmer, 1, 40 - length(f))"), F.expr("substring(kmer, 41 - length(f))"), F.reverse(F.translate("r", "ACGT", "TGCA"))))
    ref = t["ref"].join(p, "region").select("bact_id", "region", full.alias("kmer"), "is_perfect_match")
    paths = profile.db_paths(str(tmp_path / "db"), "x")
    reference.write_reference(ref, paths["regions"])
    part = spark.read.parquet(f"{DATA}/part.parquet")
    part.select(F.col("p_partkey").alias("bact_id"), F.array(F.col("p_partkey").cast("double")).alias("headers"), F.lit("ACGT").alias("sequence")).write.parquet(paths["catalog"])
    t["taxonomy"].write.parquet(paths["taxonomy"])
    cfg = Config(prep=PrepConfig(read_len=40), report=ReportConfig(print_resolution=True))
    bad = tmp_path / "in" / "broken"
    bad.mkdir()
    (bad / "other_L001_R1_001.fastq").write_text("@a\nACGT\n+\nIIII\n")
    out = profile.run(spark, str(tmp_path / "in"), str(tmp_path / "db"), "x", str(tmp_path / "res"), cfg=cfg, generate_group_results=True)
    assert set(out) == {"species", "groups", "stats", "species sizes", "groups sizes"}
    sizes = [x.split("\t") for x in open(out["species sizes"]).read().splitlines()]
    assert out["species sizes"].endswith("GroupSizes_SPECIES_res") and {float(v) for r in sizes[2:] for v in r[7:]} <= {float(i) for i in range(1000)}
    assert spark.read.text(f"{tmp_path}/res_stages/unique_fasta").count() > 0
    rows = [x.split("\t") for x in open(out["species"]).read().splitlines()]
    assert rows[1][-2:] == ["S0", "S1"] and abs(sum(float(r[-1]) for r in rows[2:]) - 1) < 1e-4
    # the same lanes by way of a store, in two batches and a run that finds nothing new; what the runs before left is gone
    (tmp_path / "res_stages/left_behind").mkdir()
    kept = additive.UniqueStore(spark, str(tmp_path / "store"))
    first = [p.r1 for p in files.read_pairs(str(tmp_path / "in"), skip=[str(bad)])][:1]
    kept.add(first, splits.read_files(spark, str(tmp_path / "in"), skip=[str(bad)], only=first), cfg.prep)
    again = profile.run(spark, str(tmp_path / "in"), str(tmp_path / "db"), "x", str(tmp_path / "res"), cfg=cfg, generate_group_results=True, store=str(tmp_path / "store"))
    assert set(again) == set(out) and kept.manifest().count() == 2 and not (tmp_path / "res_stages/left_behind").exists()
    assert [x.split("\t") for x in open(again["species"]).read().splitlines()] == rows
    stats = [x.split("\t") for x in open(out["stats"]).read().splitlines()]
    assert len(stats[0]) == 29 and [r[0] for r in stats[1:]] == ["S0", "S1"]
    for r in stats[1:]:
        for k in range(5):
            mapped, filtered, matched, most, unmatched = map(int, r[4 + 5 * k : 9 + 5 * k])
            assert mapped >= filtered == matched + unmatched and most <= unmatched


def test_unique_fasta(spark, tmp_path):
    uni = spark.createDataFrame([("S", "A", "C", 1)] + [("S", "G" * i, "T", 1) for i in range(1, 10)], "sample string, r1 string, r2 string, n long")
    assert sinks.numbered(uni).agg(F.max("header")).first()[0] == "10"
    sinks.write_unique_fasta(uni, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).where("mate = 1 and value like '>%'").count() == 10


def test_a_stage_holds_one_run_only(spark, tmp_path):
    both = spark.createDataFrame([("A", 1, 5), ("A", 2, 6), ("B", 1, 7)], "sample string, region int, n long")
    assert sinks.save_stage(both, str(tmp_path / "s")).count() == 3
    assert [r["sample"] for r in sinks.save_stage(both.where("sample = 'A' and region = 1"), str(tmp_path / "s")).collect()] == ["A"]


def test_wrong_lengths_are_an_error(spark):
    lengths = refdb.read_lengths(40)
    assert lengths[1] == 80 - 18 - 19 and refdb.read_lengths(40, with_primer=True)[1] == 80
    ref = spark.createDataFrame([(1, 1, "A" * 43), (2, 1, None), (3, 1, "A" * 44)], "bact_id long, region int, kmer string")
    assert refdb.check_lengths(ref.where("bact_id < 3"), lengths).count() == 2
    with pytest.raises(Exception, match="lengths differ"):
        refdb.check_lengths(ref, lengths).collect()


def test_ordinals_are_row_numbers(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 1000) for i in range(1000)], "g int, v int").distinct()
    got = ordinals(df, ["g"], ["v"], "n").collect()
    for g in range(3):
        own = sorted((r.v, r.n) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_shortened_names_and_progress():
    cfg = ReportConfig(shorten_names=True)
    assert report.shortened(["a_1", "b_2", "c_1", "c_2"], cfg) == ["a", "b", "c_1", "c_2"] and report.shortened(["a_1"], ReportConfig()) == ["a_1"]
    row = {"Sample name": "S", report.LOADED: "200", report.GOOD: "100"} | {f"{m} {r}": v for r in (1, 2) for m, v in ((report.MAPPED, "40"), (report.FILTERED, "30"), (report.MATCHED, "NaN"))}
    assert report.progress(row, (1, 2)) == "S: 50% good, 80% mapped, 75% above the abundance filter, 0% matched"
