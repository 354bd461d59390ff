"""Large read files in parts: one pass indexes records, the second reads both mates by record number.

A plain or block-gzipped FASTQ file is cut into ranges of bytes.  A task scans a
range and says, for each of the four lines of a record that the range may begin
in, how many records begin there and in which line it ends; blank lines between
records, which are none, make that more than a count.  Put one after another for
a file, the ranges give every record its number.  Then a range of the first
file and the range of the second file that holds its first record make a task.

A line belongs to the range with the line feed before it, so a range is read
without a look at what precedes it.  Members of block-gzip say how long they
are, so a range of such a file begins at its first member.

Files that can't be cut (other gzip, zip, FASTA) are read by one task, streamed
and never held whole.

Lines are counted and records are split by blocks of bytes, not one by one, and
a task takes many ranges where they are short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.staging import stage
from strandloom.sources.files import BLOCK, KINDS, READS_SCHEMA, _fs, fastq_records, read_pairs, records

#: Bytes of a range, and bytes read at once; those after a range, of which little may be wanted, are read by pieces that grow from TAIL.
RANGE_BYTES = 64 << 20
PIECE = 1 << 20
TAIL = 1 << 12
#: A member of block-gzip is no longer than this.
MEMBER = 1 << 16
PARTS = "pair long, mate int, path string, part long, low long, high long"
RANGES = "pair long, r1 string, low1 long, high1 long, state1 int, r2 string, low2 long, high2 long, state2 int, skip2 long, first long, n long"


def member_size(head: bytes) -> int | None:
    """The size of the block-gzip member that begins with ``head``; none if it is something else."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 6 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def first_member(file, low: int, size: int) -> int:
    """Where the first member at or after ``low`` begins; ``size`` if there is none.

    Bytes that only look like a member's head are not followed by members.
    """
    file.seek(low)
    window = file.read(min(MEMBER + 64, size - low))
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        here = low + at
        for _ in range(3):
            file.seek(here)
            n = member_size(file.read(64))
            if n is None:
                break
            here += n
            if here >= size:
                break
        if n is not None and here <= size:
            return low + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def pieces(path: str, low: int, high: int) -> Iterator[tuple[bytes, bool]]:
    """The bytes from a range on, up to the file's end, and whether they are the range's own."""
    store, at = _fs(path)
    with store.open_input_file(at) as file:
        size = file.size()
        if path.lower().endswith(".gz"):
            here = first_member(file, low, size) if low else 0
            while here < size:
                file.seek(here)
                n = member_size(file.read(64))
                if n is None:
                    raise ValueError(f"damaged block at {here} of {path}")
                file.seek(here)
                yield zlib.decompressobj(31).decompress(file.read(n)), here < high
                here += n
            return
        file.seek(low)
        here, tail = low, TAIL
        while data := file.read(min(PIECE, high - here) if here < high else tail):
            yield data, here < high
            if here >= high:
                tail = min(2 * tail, PIECE)
            here += len(data)


def line_blocks(parts: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[tuple[bytes, bool]]:
    """Blocks of whole lines from a range on, and whether these belong to it; but for the ``first`` range, the line it begins in does not."""
    rest, own_rest, skip = [], True, not first
    for data, own in parts:
        at = 0
        if skip or own != own_rest:
            at = data.find(b"\n") + 1
            if not at:
                rest.append(data)
                continue
            if not skip:
                yield b"".join((*rest, data[:at])), own_rest
            rest, own_rest, skip = [], own, False
        end = data.rfind(b"\n") + 1
        if end > at:
            yield b"".join((*rest, data[at:end])), own
            rest, at = [], end
        rest.append(data[at:])
    if not skip and any(rest):
        yield b"".join(rest), own_rest


def count_lines(block: bytes) -> tuple[int, list[int]]:
    """The number of lines of a block, and the numbers of the empty ones."""
    codes = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(codes == 10)
    if not block.endswith(b"\n"):
        ends = np.append(ends, len(block))
    begins = np.append(0, ends[:-1] + 1)
    # a line of feeds and returns alone is empty
    maybe = np.flatnonzero((begins == ends) | (codes[np.minimum(begins, len(block) - 1)] == 13))
    return len(ends), [int(i) for i in maybe if not block[begins[i] : ends[i]].rstrip(b"\r")]


def passage(n: int, blanks: list[int], state: int) -> tuple[int, int]:
    """Records begun in ``n`` lines, those numbered ``blanks`` empty, entered at line ``state`` of a record; and the line after them."""
    begun, at = 0, 0
    for b in (*blanks, n):
        run = b - at
        begun += max(0, run - -state % 4 + 3) // 4
        state = (state + run) % 4
        if b < n and state:
            state = (state + 1) % 4  # an empty sequence; between records a blank line is none
        at = b + 1
    return begun, state


def cut(path: str) -> bool:
    """Whether a file can be cut: plain FASTQ, or block-gzipped."""
    kind = KINDS.search(path)
    if not kind or kind[1].lower() not in ("fastq", "fq"):
        return False
    if not kind[2]:
        return True
    if kind[2].lower() != ".gz":
        return False
    store, at = _fs(path)
    with store.open_input_file(at) as file:
        return member_size(file.read(64)) is not None


def index(parts: DataFrame) -> DataFrame:
    """Of each range ``begun`` and ``left``, by the state it is entered in; no rows for files that can't be cut."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if not cut(r.path):
                    continue
                n, blanks = 0, []
                for block, own in line_blocks(pieces(r.path, r.low, r.high), r.low == 0):
                    if not own:
                        break
                    more, empty = count_lines(block)
                    blanks += [n + i for i in empty]
                    n += more
                by = [passage(n, blanks, s) for s in range(4)]
                out.append((*r, [b for b, _ in by], [s for _, s in by]))
            yield pd.DataFrame(out, columns=[*frame.columns, "begun", "left"])

    return parts.mapInPandas(run, f"{PARTS}, begun array<long>, left array<int>")


def ranges(indexed: DataFrame) -> DataFrame:
    """Tasks of the second pass, from the ranges of both mates; a pair's ranges are few."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mates = []
        for mate in (1, 2):
            own = frame[frame["mate"] == mate].sort_values("part")
            state, number, rows = 0, 0, []
            for r in own.itertuples(index=False):
                rows.append((r.path, r.low, r.high, state, number, int(r.begun[state])))
                number, state = number + int(r.begun[state]), int(r.left[state])
            mates.append((rows, number))
        (ones, n_one), (twos, n_two) = mates
        if twos and n_one != n_two:
            raise ValueError(f"{ones[0][0]} and {twos[0][0]} differ in their number of records")
        firsts = np.array([r[4] for r in twos], np.int64)
        out = []
        for path, low, high, state, number, n in ones:
            if n:
                row = (frame["pair"].iloc[0], path, low, high, state)
                if twos:
                    p, a, b, s, f, _ = twos[np.searchsorted(firsts, number, side="right") - 1]
                    out.append((*row, p, a, b, s, number - f, number, n))
                else:
                    out.append((*row, None, None, None, None, None, number, n))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RANGES.split(", ")]).astype({"low2": "Int64", "high2": "Int64", "state2": "Int32", "skip2": "Int64"})

    return indexed.groupBy("pair").applyInPandas(run, RANGES)


def split_lines(block: bytes) -> pa.Array:
    """The lines of a block as an array of strings."""
    if not block.isascii():
        block = block.decode("ascii", "replace").encode()
    lines = pc.split_pattern(pa.array([block.removesuffix(b"\n")], pa.string()), "\n").values
    return pc.ascii_rtrim(lines, "\r") if b"\r" in block else lines


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, names=["h", "s", "q"])


def records_of(lines: pa.Array, last: bool) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Records of lines that begin between two records, and the lines of one not ended; all must end if these are the ``last``."""
    n = len(lines) // 4 * 4
    h, s, plus, q = (lines.take(np.arange(k, n, 4)) for k in range(4))
    if pc.all(pc.and_(pc.and_(pc.starts_with(h, "@"), pc.starts_with(plus, "+")), pc.equal(pc.binary_length(s), pc.binary_length(q))), min_count=0).as_py() and (n == len(lines) or not last):
        yield pa.RecordBatch.from_arrays([pc.utf8_slice_codeunits(h, 1), s, q], names=["h", "s", "q"]), lines.slice(n)
        return
    # blank lines between records, or a damaged one, which is an error after those before it
    held, at, rows = lines.to_pylist(), 0, []
    while at < len(held) and (last or not held[at] or at + 4 <= len(held)):
        if held[at]:
            try:
                rows += fastq_records(held[at : at + 4])
            except ValueError:
                yield _columns(rows), lines.slice(0, 0)
                raise
        at += 4 if held[at] else 1
    yield _columns(rows), lines.slice(min(at, len(held)))


def records_from(path: str, low: int, high: int, state: int) -> Iterator[pa.RecordBatch]:
    """Records that begin in a range, entered at line ``state`` of one, and all after it, by blocks."""
    drop, rest = -state % 4, pa.array([], pa.string())
    for block, _ in line_blocks(pieces(path, low, high), low == 0):
        lines = split_lines(block)
        gone = min(drop, len(lines))
        drop -= gone
        for found, rest in records_of(pa.concat_arrays([rest, lines.slice(gone)]), False):
            yield found
    for found, _ in records_of(rest, True):
        yield found


def some(blocks: Iterator[pa.RecordBatch], skip: int, n: int) -> Iterator[pa.RecordBatch]:
    """``n`` rows after the first ``skip``."""
    for block in blocks:
        part = block.slice(min(skip, block.num_rows), n)
        skip -= min(skip, block.num_rows)
        n -= part.num_rows
        yield part
        if not n:
            return


def side_by_side(ones: Iterator[pa.RecordBatch], twos: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, pa.RecordBatch | None]]:
    """Blocks of as many rows of both; none for the one that ends first."""
    a = b = None
    while True:
        a = a if a is not None else next((x for x in ones if x.num_rows), None)
        b = b if b is not None else next((x for x in twos if x.num_rows), None)
        if a is None or b is None:
            if a is not None or b is not None:
                yield a, b
            return
        n = min(a.num_rows, b.num_rows)
        yield a.slice(0, n), b.slice(0, n)
        a, b = (x.slice(n) if x.num_rows > n else None for x in (a, b))


def _read(tasks: DataFrame) -> DataFrame:
    """Reads of rows ``sample`` and those of ``RANGES``; a row without ``n`` is a whole pair of files."""
    names = READS_SCHEMA.replace(",", "").split()[::2]

    def mate(r: dict, k: int) -> Iterator[pa.RecordBatch]:
        if r["n"] is None:
            return (_columns(rows) for rows in batched(records(r[f"r{k}"]), BLOCK))
        found = records_from(r[f"r{k}"], r[f"low{k}"], r[f"high{k}"], r[f"state{k}"])
        return some(found, r["skip2"] if k == 2 else 0, r["n"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key, i = r["r1"].rsplit("/", 1)[-1], r["first"] or 0
                none = lambda a: pa.RecordBatch.from_arrays([pa.nulls(a.num_rows, pa.string())] * 3, names=a.schema.names)
                pairs = ((a, none(a)) for a in mate(r, 1)) if r["r2"] is None else side_by_side(mate(r, 1), mate(r, 2))
                for a, b in pairs:
                    if a is None or b is None:
                        raise ValueError(f"{r['r1']} and {r['r2']} differ in their number of records")
                    n = a.num_rows
                    same = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (r["sample"], key)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(i, i + n)), *a.columns, *b.columns], names=names)
                    i += n

    return tasks.mapInArrow(run, READS_SCHEMA)


def read_files(
    spark: SparkSession, path: str, paired: bool = True, flat: bool = False, skip: list[str] | None = None, range_bytes: int = RANGE_BYTES, only: list[str] | None = None
) -> DataFrame:
    """What ``files.read_files`` gives, with files of more than ``range_bytes`` read by several tasks; ``only`` names first files."""
    found = read_pairs(path, paired, flat, skip or [])
    if only is not None:
        wanted = set(only)
        found = [p for p in found if p.r1 in wanted]
    rows = [(i, p.sample, p.r1, p.r2, p.size1, p.size2) for i, p in enumerate(found)]
    pairs = spark.createDataFrame(rows, "pair long, sample string, r1 string, r2 string, size1 long, size2 long")
    large = pairs.where((F.col("size1") > range_bytes) & (F.col("size2").isNull() | (F.col("size2") > 0)))
    mate = lambda k: F.struct(F.lit(k).alias("mate"), F.col(f"r{k}").alias("path"), F.col(f"size{k}").alias("size"))
    mates = large.select("pair", F.inline(F.array(mate(1), mate(2))))
    parts = mates.where("path is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))))
    low = F.col("part") * range_bytes
    parts = parts.select("pair", "mate", "path", "part", low.alias("low"), F.least(low + range_bytes, "size").alias("high"))
    # a small table that stands for much work is not to be packed into few tasks: one for each range, or for RANGE_BYTES of short ones
    few, many = 4 * spark.sparkContext.defaultParallelism, max(1, RANGE_BYTES // range_bytes)
    n_tasks = lambda n: max(1, min(n, few), -(-n // many))
    n_parts = sum(-(-x // range_bytes) for _, _, _, _, a, b in rows if a > range_bytes for x in (a, b or 0))
    indexed = stage(index(parts.repartition(n_tasks(n_parts))), "reads-index")
    n_mates = indexed.groupBy("pair").agg(F.count_distinct("mate").alias("n")).join(pairs, "pair").where(F.col("n") == F.when(F.col("r2").isNull(), 1).otherwise(2)).select("pair")
    tasks = ranges(indexed.join(n_mates, "pair", "left_semi")).join(pairs.select("pair", "sample"), "pair")
    whole = pairs.join(tasks.select("pair").distinct(), "pair", "left_anti")
    null = lambda c, k: F.lit(None).cast(k).alias(c)
    plan = [(x.split()[0], x.split()[1]) for x in RANGES.split(", ")]
    whole = whole.select("sample", *(F.col(c) if c in ("pair", "r1", "r2") else null(c, k) for c, k in plan))
    tasks = stage(tasks.select("sample", *(c for c, _ in plan)).unionByName(whole), "reads-tasks")
    n_whole, n_ranges = tasks.agg(F.count_if(F.col("n").isNull()), F.count("n")).first()
    return _read(tasks.repartition(n_whole + n_tasks(n_ranges)))
