"""Read files: discovery, names, pairs, and a batch data source for FASTQ and FASTA."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READS_SCHEMA = "sample string, pair_key string, record_no long, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string"
#: Records in an Arrow batch.
BLOCK = 20_000
KINDS = re.compile(r"\.(fastq|fq|fasta|fa)(\.gz|\.zip)?$", re.I)


def sample_name(file_name: str) -> str:
    """The name before ``_L0…``, if that token is followed at once by the first ``_R``; else empty."""
    if file_name.count("_L0") > 1:
        raise ValueError(f"several lanes in one name: {file_name}")
    at, r = file_name.find("_L0"), file_name.find("_R")
    return file_name[:at] if at >= 0 and r > at and "_" not in file_name[at + 1 : r] else ""


def sample_name_column(name: Column) -> Column:
    lanes = (F.char_length(name) - F.char_length(F.replace(name, F.lit("_L0"), F.lit("")))) / 3
    found = F.regexp_extract(name, r"^((?:(?!_R|_L0).)*)_L0[^_]*_R", 1)
    return F.when(lanes > 1, F.raise_error(F.concat(F.lit("several lanes in one name: "), name)).cast("string")).otherwise(found)


def mate_name(name: Column) -> Column:
    return F.replace(name, F.lit("_R1_"), F.lit("_R2_"))


def flat_names(files: DataFrame) -> DataFrame:
    """Files of a flat directory (``dir, name``) under samples instead of copies: third reads stand for second ones.

    Files without a sample are left out; where both are there the third reads win.
    """
    named = files.withColumn("sample", sample_name_column(F.col("name"))).where("sample <> ''")
    named = named.withColumn("as_name", F.replace("name", F.lit("_R3"), F.lit("_R2")))
    best = named.groupBy("dir", "sample", "as_name").agg(F.max_by("name", F.col("name").contains("_R3").cast("int")).alias("name"))
    return best.select("dir", "sample", "name", "as_name")


def valid_samples(files: DataFrame) -> DataFrame:
    """``dir, n_files, valid``: a sample needs a number of read files that is even and not 0."""
    n = F.count_if(F.col("name").contains("fastq"))
    return files.groupBy("dir").agg(n.cast("long").alias("n_files")).withColumn("valid", (F.col("n_files") > 0) & (F.col("n_files") % 2 == 0))


def pair_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """``dir, r1, r2`` by name; a first read without its partner is an error when read, or null if not ``strict``."""
    first = files.where(F.col("name").contains("_R1_")).select("dir", F.col("name").alias("r1"), mate_name(F.col("name")).alias("want"))
    second = files.select("dir", F.col("name").alias("want"), F.col("name").alias("r2"))
    out = first.join(second, ["dir", "want"], "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no second reads for "), F.col("r1"))).cast("string")
        out = out.withColumn("r2", F.coalesce("r2", missing))
    return out.select("dir", "r1", "r2")


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def sized_files(path: str) -> list[tuple[str, str, int]]:
    """``(directory, name, size)`` of all files below a path of any store Arrow knows."""
    from pyarrow import fs

    store, base = _fs(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((x.path.rsplit("/", 1)[0], x.base_name, x.size) for x in found if x.is_file)


def list_files(path: str) -> list[tuple[str, str]]:
    """``(directory, name)`` of all files below a path."""
    return [(d, n) for d, n, _ in sized_files(path)]


def open_text(path: str) -> Iterator[str]:
    """Lines of a plain, gzipped or zipped file, streamed: no file is held whole. Inputs are never changed."""
    store, at = _fs(path)
    kind = path.lower()
    with store.open_input_file(at) if kind.endswith(".zip") else store.open_input_stream(at, compression=None) as raw:
        if kind.endswith(".gz"):
            raw = gzip.GzipFile(fileobj=raw)
        elif kind.endswith(".zip"):
            held = zipfile.ZipFile(raw)
            raw = held.open(held.namelist()[0])
        yield from (x.rstrip("\r\n") for x in io.TextIOWrapper(raw, encoding="ascii", errors="replace"))


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    lines = iter(lines)
    for head in lines:
        if not head:
            continue
        seq, plus, qual = next(lines, None), next(lines, None), next(lines, None)
        if not head.startswith("@") or qual is None or not plus.startswith("+") or len(qual) != len(seq):
            raise ValueError(f"damaged record {head!r}")
        yield head[1:], seq, qual


def fasta_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    head, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts), None
            head, parts = line[1:], []
        elif line:
            parts.append(line)
    if head is not None:
        yield head, "".join(parts), None


def records(path: str) -> Iterator[tuple[str, str, str | None]]:
    kind = KINDS.search(path)
    return (fasta_records if kind and kind[1].lower() in ("fasta", "fa") else fastq_records)(open_text(path))


class ReadPairs(InputPartition):
    def __init__(self, sample: str, r1: str, r2: str | None, size1: int, size2: int | None) -> None:
        self.sample, self.r1, self.r2, self.size1, self.size2 = sample, r1, r2, size1, size2


def read_pairs(path: str, paired: bool = True, flat: bool = False, skip=()) -> list[ReadPairs]:
    """Read files below ``path`` by sample, mates together, with their sizes."""
    sizes = {(d, n): size for d, n, size in sized_files(path) if KINDS.search(n) and d not in skip}
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    out = []
    for (d, n), size in sizes.items():
        sample = sample_name(n) if flat else (sample_name(n) or d.rsplit("/", 1)[-1])
        if not sample:
            continue
        if not paired:
            out.append(ReadPairs(sample, f"{scheme}{d}/{n}", None, size, None))
        elif "_R1_" in n:
            third, second = n.replace("_R1_", "_R3_"), n.replace("_R1_", "_R2_")
            mate = third if flat and (d, third) in sizes else second
            if (d, mate) not in sizes:
                raise ValueError(f"no second reads for {n}")
            out.append(ReadPairs(sample, f"{scheme}{d}/{n}", f"{scheme}{d}/{mate}", size, sizes[d, mate]))
    return out


class ReadsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.paired = options.get("paired", "true").lower() == "true"
        self.flat = options.get("flat", "false").lower() == "true"
        self.skip = set(json.loads(options.get("skip", "[]")))

    def partitions(self):
        return read_pairs(self.path, self.paired, self.flat, self.skip)

    def read(self, part):
        from itertools import zip_longest

        if part is None:
            return
        mates = records(part.r2) if part.r2 else None
        rows, names = [], READS_SCHEMA.replace(",", "").split()[::2]
        kinds = [pa.int64() if n == "record_no" else pa.string() for n in names]

        def batch():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        key = part.r1.rsplit("/", 1)[-1]
        for i, (a, b) in enumerate(zip_longest(records(part.r1), mates) if mates else ((x, (None,) * 3) for x in records(part.r1))):
            if a is None or b is None:
                raise ValueError(f"{part.r1} and {part.r2} differ in their number of records")
            rows.append((part.sample, key, i, *a, *b))
            if len(rows) == BLOCK:
                yield batch()
                rows = []
        if rows:
            yield batch()


class ReadsDataSource(DataSource):
    """``spark.read.format("reads")``: one task per pair of files, mates joined by position without a shuffle.

    Options: ``paired`` (true), ``flat`` (false: a directory per sample), ``skip``
    (a JSON list of directories, as ``skip_invalid`` gives them).
    """

    @classmethod
    def name(cls):
        return "reads"

    def schema(self):
        return READS_SCHEMA

    def reader(self, schema):
        return ReadsReader(self.options)


def read_files(spark: SparkSession, path: str, paired: bool = True, flat: bool = False, skip: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ReadsDataSource)
    reader = spark.read.format("reads").option("paired", str(paired).lower()).option("flat", str(flat).lower())
    return reader.option("skip", json.dumps(skip or [])).load(path)


def skip_invalid(spark: SparkSession, path: str, paired: bool = True) -> tuple[list[str], list[str]]:
    """Sample directories below ``path`` that can be used, and those that can't.

    A directory needs read files of a kind that the reader takes; for pairs an
    even number of them, and a second read file for each first one.
    """
    files = list_files(path)
    reads: dict[str, set[str]] = {d: set() for d, _ in files}
    for d, n in files:
        if KINDS.search(n):
            reads[d].add(n)
    usable = lambda names: len(names) % 2 == 0 and all(n.replace("_R1_", "_R2_") in names for n in names if "_R1_" in n)
    good = [d for d, names in reads.items() if names and (not paired or usable(names))]
    return sorted(good), sorted(set(reads) - set(good))
