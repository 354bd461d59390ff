"""Read files in ranges, the store of unique reads, and what a run leaves behind."""

import gzip
import random
import struct
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.config import PrepConfig
from strandloom.operators import qc, report, stats
from strandloom.sources import additive, files, reference, sinks, splits


def fastq(rows, end="\n"):
    return "".join(f"@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows)


def block_gzip(data: bytes, size=700) -> bytes:
    """Members with their sizes in an extra field, and the empty one that ends a file."""
    out = b""
    for at in (*range(0, len(data), size), None):
        part = b"" if at is None else data[at : at + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def some_reads(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        k = draw.randrange(0, 60)
        out.append((f"read{i}/{'x' * draw.randrange(30)}", "".join(draw.choices("ACGTN", k=k)), "".join(draw.choices("!#+5@I", k=k))))
    return out


def put(path, name, data, kind):
    path.mkdir(parents=True, exist_ok=True)
    if kind == "plain":
        (path / name).write_bytes(data)
    elif kind == "blocks":
        (path / f"{name}.gz").write_bytes(block_gzip(data))
    elif kind == "gzip":
        (path / f"{name}.gz").write_bytes(gzip.compress(data))
    else:
        with zipfile.ZipFile(path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)


def taken(df):
    return sorted(map(tuple, df.select("sample", "record_no", "h1", "s1", "q1", "h2", "s2", "q2").collect()), key=str)


@pytest.mark.parametrize("kind", ["plain", "blocks", "gzip", "zip"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_equal_the_serial_reader(spark, tmp_path, kind, end):
    one, two = some_reads(300), some_reads(300, 2)
    for n, rows in ((1, one), (2, two)):
        put(tmp_path / "A", f"A_L001_R{n}_001.fastq", fastq(rows, end).encode(), kind)
    want = taken(files.read_files(spark, str(tmp_path)))
    assert len(want) == 300
    for size in (1 << 20, 5000, 997):
        got = splits.read_files(spark, str(tmp_path), range_bytes=size)
        assert taken(got) == want
        if kind in ("plain", "blocks") and size < 1 << 20:
            assert got.rdd.getNumPartitions() >= 3


def test_blank_lines_and_empty_reads(spark, tmp_path):
    """Blank lines between records are none; in a record they are an empty sequence."""
    draw = random.Random(4)
    text = "".join("\n" * draw.choice((0, 0, 0, 1, 3)) + fastq([r]) for r in some_reads(120)) + "\n\n"
    (tmp_path / "one.fastq").write_text(text)
    want = taken(files.read_files(spark, str(tmp_path), paired=False))
    for size in (333, 1000, 4000):
        assert taken(splits.read_files(spark, str(tmp_path), paired=False, range_bytes=size)) == want
    lines = text.split("\n")
    for a in range(0, len(lines), 17):
        own = lines[a : a + 40]
        for state in range(4):
            begun, now = 0, state
            for x in own:
                if now == 0 and x:
                    begun += 1
                now = now if now == 0 and not x else (now + 1) % 4
            assert splits.passage(len(own), [i for i, x in enumerate(own) if not x], state) == (begun, now)


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_blocks_hold_the_lines_of_a_range(end):
    """Whatever the pieces: a line belongs to the range with the feed before it."""
    draw = random.Random(5)
    for _ in range(300):
        data = b"".join(b"x" * draw.choice((0, 0, 1, 5)) + end for _ in range(draw.randrange(1, 12))) + draw.choice((b"", b"last"))
        high = draw.randrange(1, len(data) + 1)
        cuts = sorted({0, high, len(data), *(draw.randrange(len(data)) for _ in range(4))})
        parts = [(data[a:b], a < high) for a, b in zip(cuts, cuts[1:], strict=False)]
        begins = [0, *(i + 1 for i, c in enumerate(data) if c == 10)]
        lines = [(a, x) for a, x in zip(begins, data.split(b"\n"), strict=True) if a < len(data)]
        for first in (True, False):
            blocks = list(splits.line_blocks(iter(parts), first))
            for own in (True, False):
                want = [x for a, x in lines[not first :] if (a <= high) == own]
                got = [b for b, o in blocks if o == own]
                assert b"".join(got).removesuffix(b"\n") == b"\n".join(want)
                n, empty = 0, []
                for b in got:
                    more, at = splits.count_lines(b)
                    empty += [n + i for i in at]
                    n += more
                assert (n, empty) == (len(want), [i for i, x in enumerate(want) if not x.rstrip(b"\r")])


def test_short_ranges_share_tasks_and_read_little_more(spark, tmp_path):
    """Neither tasks nor bytes grow with the number of ranges alone."""
    for n in (1, 2):
        put(tmp_path / "A", f"A_L001_R{n}_001.fastq", fastq(some_reads(3000, n)).encode(), "plain")
    path = str(tmp_path / "A/A_L001_R1_001.fastq")
    size = (tmp_path / "A/A_L001_R1_001.fastq").stat().st_size
    got = splits.read_files(spark, str(tmp_path), range_bytes=1000)
    assert size > 200_000 and 4 <= got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert taken(got) == taken(files.read_files(spark, str(tmp_path)))
    after = [len(data) for data, own in splits.pieces(path, 5000, 6000) if not own]
    assert after[0] <= 4096 and 6000 + sum(after) == size


def test_a_file_is_joined_from_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).alias("sample"), F.format_string("%05d", "id").alias("value"))
    rows = rows.repartitionByRange(7, "sample", "value").sortWithinPartitions("sample", "value")
    assert rows.where("sample = 1").select(F.spark_partition_id()).distinct().count() > 2
    sinks.write_named_text(rows, f"file://{tmp_path}/out", ["sample"], lambda sample: f"S{sample}/{sample}.txt")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/S0/0.txt", "out/S1/1.txt"]
    for k in (0, 1):
        assert (tmp_path / f"out/S{k}/{k}.txt").read_text().split() == [f"{i:05d}" for i in range(k, 5000, 2)]


def test_damaged_files_are_errors(spark, tmp_path):
    rows = some_reads(200)
    put(tmp_path / "A", "A_L001_R1_001.fastq", fastq(rows).encode(), "plain")
    put(tmp_path / "A", "A_L001_R2_001.fastq", fastq(rows[:-1]).encode(), "plain")
    with pytest.raises(Exception, match="differ in their number of records"):
        splits.read_files(spark, str(tmp_path), range_bytes=2000).count()
    lines = fastq(rows).split("\n")
    del lines[401]
    put(tmp_path / "B", "b.fastq", "\n".join(lines).encode(), "plain")
    with pytest.raises(Exception, match="damaged record"):
        splits.read_files(spark, str(tmp_path / "B"), paired=False, range_bytes=2000).count()


def test_what_only_looks_like_a_block(tmp_path):
    data = block_gzip(b"abc\n" * 2000)
    junk = b"\x1f\x8b\x08\x04" + bytes(20)
    path = tmp_path / "x.gz"
    path.write_bytes(junk + data)
    with open(path, "rb") as f:
        assert splits.first_member(f, 0, len(junk + data)) == len(junk)
        assert splits.first_member(f, len(junk) + 1, len(junk + data)) == len(junk) + splits.member_size(data[:64])
    assert splits.member_size(gzip.compress(b"x")[:64]) is None and not splits.cut(str(tmp_path / "y.fastq.zip"))


def test_a_zip_is_never_held_whole(tmp_path):
    draw = random.Random(1)
    text = fastq([(str(i), "".join(draw.choices("ACGT", k=90)), "I" * 90) for i in range(60_000)])
    put(tmp_path, "big.fastq", text.encode(), "zip")
    tracemalloc.start()
    n = sum(1 for _ in files.records(str(tmp_path / "big.fastq.zip")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 1_500_000 < (tmp_path / "big.fastq.zip").stat().st_size


def test_invalid_samples_go_by_the_reader_s_names(spark, tmp_path):
    for n in (1, 2):
        put(tmp_path / "A", f"A_L001_R{n}_001.fq", b"@a\nA\n+\nI\n", "gzip")
    put(tmp_path / "B", "B_L001_R1_001.fasta", b">a\nA\n", "plain")
    (tmp_path / "C").mkdir()
    (tmp_path / "C/notes_fastq.txt").write_text("x")
    name = lambda found: [d.rsplit("/", 1)[-1] for d in found]
    assert [name(x) for x in files.skip_invalid(spark, str(tmp_path))] == [["A"], ["B", "C"]]
    assert [name(x) for x in files.skip_invalid(spark, str(tmp_path), paired=False)] == [["A", "B"], ["C"]]


READS = "sample string, s1 string, q1 string, s2 string, q2 string"


def reads_of(spark, seed, n=300):
    draw = random.Random(seed)
    seq = lambda: "".join(draw.choice("AC") for _ in range(draw.choice((3, 4, 5)))) if draw.random() < 0.95 else None
    qual = lambda s: None if s is None or draw.random() < 0.1 else "".join(draw.choice("I!") if draw.random() < 0.2 else "I" for _ in s)
    rows = []
    for _ in range(n):
        a, b = seq(), seq()
        rows.append((draw.choice("XYZ"), a, qual(a), b, qual(b)))
    return spark.createDataFrame(rows, READS)


@pytest.mark.parametrize("cfg", [PrepConfig(read_len=4), PrepConfig(read_len=4, dest_paired=False), PrepConfig(read_len=4, paired=False)], ids=["pairs", "stacked", "single"])
def test_one_tally_gives_counts_and_uniques(spark, cfg):
    reads = reads_of(spark, 1)
    tallied = qc.tally(reads, cfg)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(qc.tally_counts(tallied, cfg)) == rows(qc.counts(reads, cfg))
    assert rows(qc.tally_uniques(tallied)) == rows(qc.unique_reads(qc.good_reads(reads, cfg)))


def test_batches_add_up_and_a_file_joins_once(spark, tmp_path):
    cfg, store = PrepConfig(read_len=4), additive.UniqueStore(spark, str(tmp_path / "store"))
    one, two = reads_of(spark, 1), reads_of(spark, 2)
    want = sorted(map(tuple, qc.unique_reads(qc.good_reads(one.unionByName(two), cfg)).collect()))
    with pytest.raises(ValueError, match="nothing"):
        store.tally()
    store.add(["a", "b"], one, cfg)
    for again in (["b"], ["c", "a"], ["d", "d"]):
        with pytest.raises(ValueError, match="already merged"):
            store.add(again, two, cfg)
    with pytest.raises(ValueError, match="other settings"):
        store.add(["c"], two, PrepConfig(read_len=3))
    # a writer that fails before the manifest leaves nothing that counts
    qc.tally(two, cfg).write.parquet(str(tmp_path / "store/counts/failed"))
    (tmp_path / "store/manifest/v1").mkdir()
    store.add(["c"], two, cfg)
    assert store.missing(["a", "c", "x"]) == ["x"]
    assert sorted(map(tuple, qc.tally_uniques(store.tally()).collect())) == want
    store.compact()
    assert sorted(map(tuple, qc.tally_uniques(store.tally()).collect())) == want and store.missing(["a", "b", "c"]) == []
    assert store.manifest().select("batch").distinct().count() == 1


def test_what_an_earlier_run_left_goes(spark, tmp_path):
    results, stages = str(tmp_path / "res"), str(tmp_path / "res_stages")
    for name in ("SPECIES_res", "GROUPS_res", "GroupSizes_SPECIES_res", "ReadCountStats_res", "SPECIES_other", "notes"):
        (tmp_path / name).write_text("x")
    (tmp_path / "res_stages/group_fasta").mkdir(parents=True)
    sinks.clear(spark, results, stages)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["SPECIES_other", "notes"]


def test_group_fasta_content(spark, tmp_path):
    members = spark.createDataFrame([("S", 1, 1), ("S", 1, 2), ("S", 3, 3)], "sample string, group_id long, bact_id long")
    catalog = spark.createDataFrame([(1, [1.5, 2.0], "ACGT"), (2, [3.0], "GG"), (3, [], "T")], "bact_id long, headers array<double>, sequence string")
    sinks.write_group_fasta(members, catalog, str(tmp_path / "f"))
    got = {(r["sample"], r["group"].split("_")[0]): r["text"] for r in spark.read.text(str(tmp_path / "f")).groupBy("sample", "group").agg(F.concat_ws("|", F.sort_array(F.collect_list("value"))).alias("text")).collect()}
    assert got == {("S", "group1"): ">1.500000 2.000000|>3.000000|ACGT|GG", ("S", "group3"): ">|T"}


def test_answers_without_headers_are_an_error(spark):
    top = spark.createDataFrame([("A", 1, ["D"], 0.25, 7), ("A", 2, ["D"], 0.75, 7)], "sample string, group_id long, path array<string>, freq double, reads long")
    sources = spark.createDataFrame([("A", 1, [1.0, 1.5]), ("A", 2, [2.0, 3.0])], "sample string, group_id long, headers array<double>")
    assert abs(report.mean_sources(top, sources, strict=True).first()["mean_sources"] - 1.75) < 1e-9
    for t, s in ((top.where("group_id = 1"), sources), (top, sources.where("group_id = 1"))):
        with pytest.raises(Exception, match="numbers of answers and headers differ"):
            report.mean_sources(t, s, strict=True).collect()
        assert report.mean_sources(t, s).count() == 1


def test_five_digits(spark):
    top = spark.createDataFrame([("A", 1, ["D"], 0.123456789, 7), ("A", 2, ["D"], 0.5, 7)], "sample string, group_id long, path array<string>, freq double, reads long")
    freq = lambda cfg: report.taxa(top, cfg).first()["freq"]
    assert abs(freq(report.ReportConfig()) - 0.623456789) < 1e-12 and abs(freq(report.ReportConfig(five_digits=True)) - 0.62346) < 1e-12


def test_stats_append_replace_and_refuse(spark, capsys):
    values = lambda *rows: spark.createDataFrame(rows, "sample string, region int, u long, n long")
    table = stats.ReadStats.empty(spark, 2).add("loaded", values(("A", 0, 1, 10)), None, "n").add("loaded", values(("A", 0, 1, 99)), None, "n")
    table = table.add("mapped", values(("A", 1, 4, 5), ("A", 2, 6, 7)), "u", "n", "region").add("mapped", values(("A", 2, 8, 9)), "u", "n", "region")
    got = sorted((r.metric, r.region or 0, r.n_unique or 0, r.n_reads) for r in table.rows.collect())
    assert got == [("loaded", 0, 0, 10), ("loaded", 0, 0, 99), ("mapped", 1, 4, 5), ("mapped", 2, 8, 9)]
    assert table.get("A", "loaded") == 10
    for sample, metric in (("A", "mapped"), ("A", "none"), ("B", "loaded")):
        with pytest.raises(KeyError):
            table.get(sample, metric)
    for region in (3, 0, None):
        with pytest.raises(Exception, match="no such region"):
            table.add("mapped", values(("A", region, 1, 1)), "u", "n", "region").rows.collect()
    table.show()
    assert "mapped" in capsys.readouterr().out


def test_regions_are_pruned_and_taxonomy_defaults(spark, tmp_path):
    """Only the regions asked for are read; without a taxonomy every bacterium is its own species."""
    ref = spark.createDataFrame([(1, r, "ACGT", True) for r in (1, 2, 3)], "bact_id long, region int, kmer string, is_perfect_match boolean")
    reference.write_reference(ref, str(tmp_path / "ref"))
    some = reference.read_reference(spark, str(tmp_path / "ref"), [1, 3])
    assert sorted(r.region for r in some.collect()) == [1, 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "region" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    catalog = spark.createDataFrame([(1, [1.0], "A"), (2, [2.0], "C")], "bact_id long, headers array<double>, sequence string")
    taxa, known = reference.read_taxonomy(spark, str(tmp_path), catalog)
    assert not known and sorted(r.bact_id for r in taxa.collect()) == [1, 2]
