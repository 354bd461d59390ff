"""The mixture solve: of one system in arrays, and across tasks for samples too large for one.

Across tasks, a sample's rows are dealt to blocks of bounded size.  A block is one row of
packed arrays: its columns, and its entries by place in them.  An update gives
each block the frequencies of its columns, makes expected rows and partial
factors within the block, and sums the factors by column.  Blocks are bucketed as
updates join them, so only frequencies and factors are shuffled, never entries.  The frequencies are
written after each update, which ends their lineage; samples that met the
tolerance leave, and once half are gone their blocks do too.  At a pruning step
columns below ``zero`` are taken out of the blocks for good, with the rows that
they empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import EPS, AlgoConfig
from strandloom.plans.staging import own_path, stage, stage_bucketed, unstage

#: Entries of a block, about; a row is never split.
BLOCK_ENTRIES = 100_000
PACKED = "sample string, block int, cols array<long>, row binary, col binary, a binary, y binary"


def _packed_arrays(cols, row, col, a, y) -> dict:
    return {"cols": cols, "row": row.astype("<i4").tobytes(), "col": col.astype("<i4").tobytes(), "a": a.astype("<f8").tobytes(), "y": y.astype("<f8").tobytes()}


def with_rows(sys: DataFrame) -> DataFrame:
    """The system with a number for each row of a sample."""
    return sys if "row" in sys.columns else sys.withColumn("row", F.xxhash64("region", "seq"))


def pack_blocks(sys: DataFrame, block_entries: int | None = BLOCK_ENTRIES) -> DataFrame:
    """``sample, block, cols, row, col, a, y``: the system as blocks of whole rows; without ``block_entries``, one block a sample."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        cols, col = np.unique(frame["col"].to_numpy(), return_inverse=True)
        row, rows = pd.factorize(frame["row"])
        y = np.zeros(len(rows))
        y[row] = frame["y"]
        order = np.lexsort((col, row))
        arrays = _packed_arrays(cols.tolist(), row[order], col[order], frame["a"].to_numpy()[order], y)
        return pd.DataFrame([{"sample": frame["sample"].iloc[0], "block": frame["block"].iloc[0], **arrays}])

    rows = with_rows(sys).select("sample", "row", "col", "a", "y")
    if block_entries is None:
        return rows.withColumn("block", F.lit(0)).groupBy("sample", "block").applyInPandas(pack, PACKED)
    size = rows.groupBy("sample").agg(F.ceil(F.count("*") / block_entries).cast("int").alias("blocks"))
    dealt = rows.join(size, "sample").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    return dealt.groupBy("sample", "block").applyInPandas(pack, PACKED)


def _arrays(batch, i: int):
    of = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    return of("row", "<i4"), of("col", "<i4"), of("a", "<f8"), of("y", "<f8")


def block_factors(row, col, a, y, x) -> np.ndarray:
    """What the rows of a block add to the factor of each of its columns."""
    theta = np.bincount(row, a * x[col], len(y))
    return np.bincount(col, a * (y / (theta + EPS))[row], len(x))


def compact(row, col, a, y, alive: np.ndarray):
    """A block without columns that are not ``alive`` and rows they empty, numbered anew; and which columns stay."""
    stay = alive[col]
    row, col, a = row[stay], col[stay], a[stay]
    rows, row = np.unique(row, return_inverse=True)
    return row, (np.cumsum(alive) - 1)[col], a, y[rows]


def em_solve(row: np.ndarray, col: np.ndarray, a: np.ndarray, y: np.ndarray, cfg: AlgoConfig, x: np.ndarray | None = None):
    """Mixture by expectation-maximisation on a sparse system; ``y`` per row.

    Stops when the update moves less than ``tol`` in sum, measured before the
    update, which still takes effect.  A pruning step takes columns below ``zero``
    out of the arrays, with the rows that they empty, and numbers the rest anew.
    Returns frequencies, 0 for columns taken out, and iterations.
    """
    n = int(col.max()) + 1
    if x is None:
        x = np.bincount(col, a * y[row], n)
        x = x / x.sum()
    steps, alive = 0, np.arange(n)
    for steps in range(1, cfg.num_iter + 1):
        factor = block_factors(row, col, a, y, x)
        error = float(np.abs(1 - factor) @ x)
        x = x * factor
        if error < cfg.tol:
            break
        if cfg.prune_every and steps % cfg.prune_every == 0 and (x < cfg.zero).any():
            stay = x >= cfg.zero
            row, col, a, y = compact(row, col, a, y, stay)
            x, alive = x[stay], alive[stay]
    out = np.zeros(n)
    out[alive] = np.where(x > cfg.zero, x, 0)
    return out / out.sum(), steps


def _routes(packed: DataFrame) -> DataFrame:
    """Which blocks a column's frequency goes to, and to which place."""
    return packed.select("sample", "block", F.posexplode("cols").alias("place", "col"))


def _with_x(packed: DataFrame, routes: DataFrame, x: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with the frequencies ``xs`` of their columns, in order; with ``left``, null for columns that are gone."""
    at = routes.join(x.select("sample", "col", "x"), ["sample", "col"], how)
    xs = at.groupBy("sample", "block").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return packed.join(xs.select("sample", "block", F.col("xs.x").alias("xs")), ["sample", "block"])


def _factors(packed: DataFrame, routes: DataFrame, x: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cols = batch.column("cols")[i].values
                f = block_factors(*_arrays(batch, i), batch.column("xs")[i].values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("sample")[i].as_py()] * len(f), pa.string()), cols, pa.array(f)], names=["sample", "col", "f"])

    return _with_x(packed, routes, x).mapInArrow(run, "sample string, col long, f double").groupBy("sample", "col").agg(F.sum("f").alias("f"))


def _compacted(packed: DataFrame, routes: DataFrame, x: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                alive = np.asarray(batch.column("xs")[i].values.is_valid())
                if alive.any():
                    cols = batch.column("cols")[i].values.to_numpy()[alive]
                    out.append({"sample": batch.column("sample")[i].as_py(), "block": batch.column("block")[i].as_py(), **_packed_arrays(cols.tolist(), *compact(*_arrays(batch, i), alive))})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("sample", pa.string()), ("block", pa.int32()), ("cols", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("row", "col", "a", "y"))]))

    return _with_x(packed, routes, x, "left").mapInArrow(run, PACKED)


def _laid_out(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks by sample and block, and their routes by sample and column, as updates join them."""
    packed = stage_bucketed(packed, "mixture-blocks", "sample", "block")
    return packed, stage_bucketed(_routes(packed), "mixture-routes", "sample", "col")


def scaled(x: DataFrame) -> DataFrame:
    """``sample, col, x`` scaled to sum 1; sums combine before the shuffle, where a window would gather a sample."""
    total = x.groupBy("sample").agg(F.sum("x").alias("t"))
    return x.join(total, "sample").withColumn("x", F.col("x") / F.col("t")).drop("t")


def solve_blocks(sys: DataFrame, cfg: AlgoConfig, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``sample, col, x, iterations``: what a task per sample gives, with each sample spread over tasks."""
    spark = sys.sparkSession
    done = own_path(spark, "mixture-done")
    schema = "sample string, col long, x double, iterations int"
    packed, routes = _laid_out(pack_blocks(sys, block_entries))
    x = stage(scaled(sys.groupBy("sample", "col").agg(F.sum(F.col("a") * F.col("y")).alias("x"))), "mixture-x")
    spark.createDataFrame([], schema).write.parquet(done)
    steps, active = 0, x.select("sample").distinct().count()
    held = active
    while active and steps < cfg.num_iter:
        steps += 1
        moved = x.join(_factors(packed, routes, x), ["sample", "col"])
        # written after each update: used twice in the next one, it would double the plan every time
        state = stage(moved.select("sample", "col", (F.col("x") * F.col("f")).alias("x"), (F.abs(1 - F.col("f")) * F.col("x")).alias("e")), "mixture-x")
        unstage(x)
        x = state
        errors = x.groupBy("sample").agg(F.sum("e").alias("error"))
        last, prune = steps == cfg.num_iter, bool(cfg.prune_every) and steps % cfg.prune_every == 0
        ending = last or errors.agg(F.min("error")).first()[0] < cfg.tol
        if not ending and not prune:
            continue
        rest = x
        if ending:
            ended = stage(errors.where((F.col("error") < cfg.tol) | F.lit(last)).select("sample"), "mixture-ended")
            x.join(ended, "sample", "left_semi").select("sample", "col", "x", F.lit(steps).alias("iterations")).write.mode("append").parquet(done)
            rest = x.join(ended, "sample", "left_anti")
        rest = stage(rest.where(F.col("x") >= cfg.zero) if prune else rest, "mixture-x")
        unstage(x)
        x = rest
        active = x.select("sample").distinct().count()
        if active and (prune or 2 * active <= held):
            smaller = _laid_out(_compacted(packed, routes, x) if prune else packed.join(x.select("sample").distinct(), "sample", "left_semi"))
            unstage(packed, routes)
            (packed, routes), held = smaller, active
    unstage(packed, routes, x)
    found = spark.read.schema(schema).parquet(done)
    kept = found.where(F.col("x") > cfg.zero)
    # as from a task per sample, cut columns have a frequency of 0
    out = sys.select("sample", "col").distinct().join(scaled(kept.select("sample", "col", "x")), ["sample", "col"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return out.join(found.groupBy("sample").agg(F.max("iterations").alias("iterations")), "sample").select("sample", "col", "x", "iterations")


def likelihood_without(sys: DataFrame, x: DataFrame, cfg: AlgoConfig, per_task: int = 16) -> DataFrame:
    """``sample, col, loglik``: how well the reads are explained once a column is taken out.

    Each solve begins with the frequencies ``x`` of the others, scaled.  A task
    has one sample's system and some of its columns to take out, ``per_task`` about,
    so a sample's solves are spread over tasks.  Rows that only that column
    explains count with the smallest expectation there is.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cols = batch.column("cols")[i].values.to_numpy()
                row, col, a, y = _arrays(batch, i)
                start = batch.column("xs")[i].values.to_numpy(zero_copy_only=False)
                gone = batch.column("gone")[i].as_py()
                found = [_without(np.searchsorted(cols, g), row, col, a, y, start, cfg) for g in gone]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("sample")[i].as_py()] * len(gone), pa.string()), pa.array(gone, pa.int64()), pa.array(found, pa.float64())], names=["sample", "col", "loglik"])

    packed = stage(pack_blocks(sys, None), "ablation-blocks")
    routes = _routes(packed)
    n = routes.groupBy("sample").agg(F.ceil(F.count("*") / per_task).alias("parts"))
    parts = routes.join(n, "sample").withColumn("part", F.pmod(F.xxhash64("col"), F.col("parts"))).groupBy("sample", "part").agg(F.sort_array(F.collect_list("col")).alias("gone"))
    tasks = stage(parts, "ablation-parts")
    work = _with_x(packed, routes, x).join(tasks, "sample")
    return work.repartition(max(1, tasks.count()), "sample", "part").mapInArrow(run, "sample string, col long, loglik double")


def _without(gone: int, row, col, a, y, start, cfg: AlgoConfig) -> float:
    alive = np.arange(len(start)) != gone
    lost = np.delete(y, np.unique(row[alive[col]])).sum()
    if not alive.any():
        return float(lost * np.log(EPS))
    row, col, a, y = compact(row, col, a, y, alive)
    start = start[alive]
    x, _ = em_solve(row, col, a, y, cfg, start / start.sum() if start.sum() > 0 else None)
    theta = np.bincount(row, a * x[col], len(y))
    return float(y @ np.log(theta + EPS) + lost * np.log(EPS))
