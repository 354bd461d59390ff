import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import IUPAC, AlgoConfig, PrepConfig
from strandloom.functions import dna, hashing, iupac
from strandloom.operators import match, qc, refdb, regions, report, solve, taxonomy


def test_iupac_expansion_order_and_errors():
    assert [s for s, _ in iupac.expand("ARY")] == ["AAC", "AAT", "AGC", "AGT"]
    assert iupac.expand("AR", "h")[0] == ("AA", "h_R0002A")
    assert iupac.expand("RRR", max_ambiguous=2) == []
    with pytest.raises(ValueError):
        iupac.expand("AX")


def test_expand_column_matches_expand(spark):
    seqs = ["ARY", "ACGT", "NNA", "GTKW"]
    got = iupac.expand_column(spark.createDataFrame([(s,) for s in seqs], "s string"), "s").collect()
    assert sorted((r.s, r.variant) for r in got) == sorted((s, v) for s in seqs for v, _ in iupac.expand(s))


def test_datahash_known_values():
    assert hashing.datahash([]) != "" and hashing.datahash(np.zeros((0, 0))) == "240f5f01f052bd89f38da2165dcf25c7"
    assert hashing.datahash("abc", "sha-256", kind="ascii") == hashlib.sha256(b"abc").hexdigest()
    for m, n in (("md5", 22), ("sha-1", 27), ("sha-256", 43), ("sha-384", 65), ("sha-512", 86)):
        assert len(hashing.datahash("x", m, "base64")) == n
    assert hashing.datahash({"b": 1, "a": 2}) == hashing.datahash({"a": 2, "b": 1})
    for bad in ({"method": "md9"}, {"fmt": "oct"}, {"kind": "x"}):
        with pytest.raises(ValueError):
            hashing.datahash("x", **bad)


def test_digest_column_matches_datahash(spark):
    df = spark.createDataFrame([("abc",), ("",)], "s string")
    for m in hashing.METHODS:
        for fmt in ("hex", "HEX", "base64"):
            got = [r[0] for r in df.select(hashing.digest_column(F.encode("s", "ISO-8859-1"), m, fmt)).collect()]
            assert got == [hashing.datahash(s, m, fmt, "ascii") for s in ("abc", "")]


def test_quality_predicates(spark):
    cfg = PrepConfig(read_len=8)
    rows = [
        ("all at 30", "ACGTACGT", "?" * 8, False),
        ("three quarters at 31", "ACGTACGT", "@" * 6 + "5" * 2, True),
        ("N", "ACGTNCGT", "I" * 8, False),
        ("short", "ACGT", "IIII", False),
        ("no qualities", "ACGTACGT", None, True),
    ]
    df = spark.createDataFrame([("S", n, s, q, s, q) for n, s, q, _ in rows], "sample string, name string, s1 string, q1 string, s2 string, q2 string")
    got = {r["name"]: r["is_good"] for r in qc.checked(df, cfg).collect()}
    assert got == {n: ok for n, _, _, ok in rows}


def test_second_mate_low_quality_follows_setting(spark):
    s = "ACGTACGTACGT"
    df = spark.createDataFrame([("S", s, "I" * 12, s, "I" * 9 + "###")], "sample string, s1 string, q1 string, s2 string, q2 string")
    assert qc.checked(df, PrepConfig(read_len=12)).first()["is_good"]
    assert not qc.checked(df, PrepConfig(read_len=12, r2_low_quality_from="r2")).first()["is_good"]


def test_primer_distance(spark):
    rng = random.Random(5)
    primer = "GTGTAGCGGTGRAATGCGNW"
    seqs = ["".join(rng.choice("ACGTN") for _ in range(30)) for _ in range(50)] + ["GTGTAGCGGTGAAATGCGAA" + "C" * 10]
    want = lambda part: sum(b not in IUPAC[c] and b != "N" for b, c in zip(part, primer, strict=True))
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in df.select("s", dna.primer_distance(F.col("s"), primer).alias("a"), dna.primer_distance(F.col("s"), primer, True).alias("b")).collect():
        assert (r.a, r.b) == (want(r.s[: len(primer)]), want(r.s[-len(primer) :]))


def test_hamming_join_is_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(6)]

    def near(s, most):
        s = list(s)
        for _ in range(rng.randint(0, most)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        return "".join(s)

    left = [(i, 1 + i % 2, near(rng.choice(base), 4)) for i in range(80)]
    right = [(i, 1 + i % 2, near(rng.choice(base), 3).replace("N", "A")) for i in range(40)]
    dist = lambda a, b: sum(x != y and x != "N" for x, y in zip(a, b, strict=True))
    want = {(i, j, dist(a, b)) for i, r, a in left for j, q, b in right if r == q and dist(a, b) <= 2}
    a = spark.createDataFrame(left, "i int, region int, seq string")
    b = spark.createDataFrame(right, "j int, region int, kmer string")
    got = match.hamming_join(a, b, ["region"], "seq", "kmer", 2, 70, max_ns=4).collect()
    assert len(got) == len(want) and {(r.i, r.j, r.d) for r in got} == want


def test_abundance_threshold(spark):
    df = spark.createDataFrame([("S", 1, "a", 49991), ("S", 1, "b", 4), ("S", 1, "c", 5)], "sample string, region int, seq string, n long")
    assert {r.seq for r in match.abundant(df, AlgoConfig()).collect()} == {"a", "c"}


def test_inclusion_filter(spark):
    rows = [("S", 1, r, c) for c, own in ((1, "ab"), (2, "abc"), (3, "d"), (4, "d")) for r in own]
    df = spark.createDataFrame(rows, "sample string, region int, seq string, col long")
    assert [r.col for r in solve.included(df).collect()] == [1]


def test_em_matches_dense():
    rng = np.random.default_rng(2)
    a = rng.random((30, 5)) * (rng.random((30, 5)) < 0.5) + np.eye(30, 5)
    y = rng.random(30)
    y /= y.sum()
    row, col = np.nonzero(a)
    x, steps = solve.em_solve(row, col, a[row, col], y, AlgoConfig())
    z, n, moved = a.T @ y / (a.T @ y).sum(), 0, 1.0
    while moved >= AlgoConfig().tol:
        new = z * (a.T @ (y / (a @ z + 2.0**-52)))
        z, n, moved = new, n + 1, np.abs(new - z).sum()
    z[z <= 1e-10] = 0
    assert steps == n > 1 and np.allclose(x, z / z.sum(), atol=1e-9)


def test_em_prunes_tiny_frequencies():
    # the second column explains nothing that the first does not
    row, col, a, y = np.array([0, 1, 0]), np.array([0, 0, 1]), np.array([1.0, 1.0, 0.5]), np.array([0.5, 0.5])
    x, _ = solve.em_solve(row, col, a, y, AlgoConfig(zero=1e-3, prune_every=5, tol=1e-12))
    assert x.tolist() == [1.0, 0.0]
    assert solve.em_solve(row, col, a, y, AlgoConfig(num_iter=7, tol=0.0))[1] == 7


def test_static_classes_and_single_ends(spark):
    ref = spark.createDataFrame([(1, 1, "ACGT", True), (2, 1, "ACGT", True), (3, 1, "ACGA", True), (4, 1, None, False)], "bact_id long, region int, kmer string, is_perfect_match boolean")
    got = {r.bact_id: r.class_id for r in refdb.classes(ref).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.weight for r in refdb.halves(ref, 2).collect()} == {0.5}
    assert refdb.kmers(ref).count() == 2  # also where all are amplified but one


def test_majority_takes_first_of_equals(spark):
    taxa = spark.createDataFrame([(1, *"DPCOFG", "b"), (2, *"DPCOFG", "a")], "bact_id long, domain string, phylum string, class string, `order` string, family string, genus string, species string")
    members = spark.createDataFrame([("S", 1, 1), ("S", 1, 2)], "sample string, group_id long, bact_id long")
    found = spark.createDataFrame([("S", 1, 1.0, 9)], "sample string, group_id long, freq double, reads long")
    levels = taxonomy.levels(members, taxa)
    assert levels.where("level = 7").count() == 2 and levels.where("level = 6").count() == 1
    top = taxonomy.majority(levels, found, 7).collect()
    assert [(r.path[-1], r.freq, r.reads) for r in top] == [("a", 1.0, 5)]
    assert len(taxonomy.majority(levels, found, 8).first().path) == 8


def test_report_rows_and_empty_sample(spark):
    top = spark.createDataFrame([("A", 1, ["D"], 1.0, 7)], "sample string, group_id long, path array<string>, freq double, reads long")
    samples = spark.createDataFrame([("A",), ("B",)], "sample string")
    total = {r.sample: r.reads for r in report.totals(top, samples).collect()}
    wide = report.pivot(report.taxa(top, report.ReportConfig()), ["A", "B"])
    rows = report.community_rows(wide, ["A", "B"], total, 1)
    assert [report.line(r) for r in rows] == ["Total # of reads\t7\t0", "domain\tA\tB", "D\t1.000000\t0.000000"]


def test_md2_known_values():
    assert hashing.datahash("abc", "md2", kind="ascii") == "da853b0d3f88d99b30283a69e6ded6bb" and hashing.datahash("", "md2", kind="ascii") == "8350e5a3e24c153df2275c9f80692773"


def test_single_end_quality(spark):
    df = spark.createDataFrame([("S", "ACGTACGT", "I" * 8), ("S", "ACGTACGT", "#" * 8), ("S", "ACGT", "IIII")], "sample string, s1 string, q1 string")
    cfg = PrepConfig(read_len=8, paired=False)
    assert [tuple(r) for r in qc.good_reads(df, cfg).collect()] == [("S", "ACGTACGT", "")]
    assert tuple(qc.counts(df, cfg).first()) == ("S", 3, 2, 1)


def test_constant_length_projection(spark):
    values = spark.createDataFrame([(1, 1, "f" * 18 + "A" * 30 + "C" * 30 + "r" * 19, True)], "bact_id long, region int, kmer string, is_perfect_match boolean")
    assert refdb.project(values, 30, const_len=True).first().kmer == "A" * 30 + "C" * 30
    assert refdb.project(values, 20, const_len=True).first().kmer == "A" * 20 + "C" * 20


def test_single_ends_are_refused(spark):
    with pytest.raises(NotImplementedError):
        regions.assign(spark.createDataFrame([], "sample string, r1 string, r2 string, n long"), PrepConfig(dest_paired=False))
