"""Writers: stages, FASTA and text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.hashing import members_hash
from strandloom.operators.ordinal import ordinals
from strandloom.operators.report import line
from strandloom.plans.staging import _store
from strandloom.sources.files import _fs

#: Bytes copied at once.
PIECE = 1 << 22


def clear(spark, results: str, stages: str) -> None:
    """Delete what an earlier run left under the same name: stages, also those this run does not write, and reports.

    Reports are told by the names they get; other files of the folder stay.
    """
    reports = [report_path(results, n, k) for n in ("species", "groups") for k in ("", "GroupSizes_")] + [stats_path(results)]
    for path in (stages, *reports):
        at, fs = _store(spark, path)
        if fs.exists(at):
            fs.delete(at, True)


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage by sample and region and read it back; what an earlier run left there goes.

    Rows of a sample and region come together first, so there are few files, and a
    large sample is split.
    """
    keys = [c for c in ("sample", "region") if c in df.columns]
    writer = (df.hint("rebalance", *keys) if keys else df).write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(uni: DataFrame) -> DataFrame:
    """Reads of each sample numbered from 1 in sorted order, padded to the width of their number."""
    rows = ordinals(uni, ["sample"], ["r1", "r2"], "i")
    width = rows.groupBy("sample").agg(F.length(F.max("i").cast("string")).alias("width"))
    return rows.join(width, "sample").withColumn("header", F.lpad(F.col("i").cast("string"), F.col("width"), F.lit("0"))).select(*uni.columns, "header")


def _join_files(path: str, files: DataFrame) -> None:
    """Make each file ``to`` below ``path`` of its ``parts``, one after another; a task streams a file's bytes, as a file has one writer."""

    def run(frames):
        for frame in frames:
            for to, parts in zip(frame["to"], frame["parts"], strict=True):
                store, at = _fs(path)
                to, parts = f"{at}/{to}", [f"{at}/{p}" for p in parts]
                # a task that is run again finds what an earlier one has finished
                if not store.get_file_info(to).is_file:
                    store.create_dir(to.rsplit("/", 1)[0])
                    whole = f"{at}/_writing/{uuid.uuid4().hex}"
                    with store.open_output_stream(whole) as out:
                        for p in parts:
                            with store.open_input_stream(p, compression=None) as part:
                                while data := part.read(PIECE):
                                    out.write(data)
                    store.move(whole, to)
                for p in parts:
                    if store.get_file_info(p).is_file:
                        store.delete_file(p)
            yield frame[["to"]]

    files.mapInPandas(run, "to string").write.format("noop").mode("overwrite").save()


def write_named_text(rows: DataFrame, path: str, by: list[str], name) -> None:
    """``value`` of each ``by`` as one text file, named by ``name(*by)`` below ``path``; its rows must be in order within tasks and from task to task."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy(*by).text(f"{path}/_writing")
    at, fs = _store(spark, f"{path}/_writing/{'/'.join(f'{c}=*' for c in by)}/part-*")
    parts: dict[str, list] = {}
    for found in fs.globStatus(at) or []:
        *folders, file = found.getPath().toString().split("/")[-len(by) - 1 :]
        task, piece = int(file.split("-")[1]), int(file.rsplit(".c", 1)[1].split(".")[0])
        parts.setdefault(name(*(x.split("=", 1)[1] for x in folders)), []).append((task, piece, "/".join(("_writing", *folders, file))))
    rows = [(to, [p for _, _, p in sorted(of)]) for to, of in parts.items()]
    _join_files(path, spark.createDataFrame(rows, "to string, parts array<string>").repartition(max(1, len(rows))))
    fs.delete(_store(spark, f"{path}/_writing")[0], True)


def fasta(header, seq):
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def write_unique_fasta(uni: DataFrame, path: str) -> None:
    """Both mates of each unique read, in folders ``mate=1`` and ``mate=2`` of each sample."""
    mates = F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("r1").alias("seq")), F.struct(F.lit(2).alias("mate"), F.col("r2").alias("seq"))))
    rows = numbered(uni).select("sample", "header", mates.alias("m")).where("m.seq <> ''")
    rows.select("sample", F.col("m.mate").alias("mate"), fasta(F.col("header"), F.col("m.seq")).alias("value")).write.mode("overwrite").partitionBy("sample", "mate").text(path)


def write_group_fasta(members: DataFrame, catalog: DataFrame, path: str) -> None:
    """All sequences of each group, in a folder by sample, group number and digest of its members."""
    digest = members.groupBy("sample", "group_id").agg(members_hash(F.collect_list("bact_id")).alias("hash"))
    rows = members.join(catalog, "bact_id").join(digest, ["sample", "group_id"])
    name = F.concat(F.lit("group"), F.col("group_id"), F.lit("_"), F.col("hash")).alias("group")
    value = fasta(F.array_join(F.transform("headers", lambda h: F.format_string("%.6f", h)), " "), F.col("sequence"))
    rows.select("sample", name, value.alias("value")).write.mode("overwrite").partitionBy("sample", "group").text(path)


def write_table(rows: list[list], path: str, delimiter: str = "\t") -> None:
    """A small table as text, written by the driver to any store Arrow knows."""
    store, at = _fs(path)
    with store.open_output_stream(at) as out:
        out.write("".join(line(r, delimiter) + "\n" for r in rows).encode())


def report_path(results: str, level: str, kind: str = "") -> str:
    """``dir/name`` to ``dir/<kind><LEVEL>_name``."""
    head, _, tail = results.rpartition("/")
    return f"{head}/{kind}{level.upper()}_{tail}" if head else f"{kind}{level.upper()}_{tail}"


def stats_path(results: str) -> str:
    return report_path(results, "", "ReadCountStats")
