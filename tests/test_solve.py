"""The solve across tasks, compaction, ablation, containment and the growing reference against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import EPS, AlgoConfig
from strandloom.operators import match, mixture, refdb, solve

SYSTEM = "sample string, region int, seq string, col long, a double, y double"


def dense_systems(seed=3, samples=4):
    """Random sparse systems ``a, y``, every column and row with an entry."""
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(samples):
        m, n = 40 + 10 * k, 6 + 3 * k
        a = rng.random((m, n)) * (rng.random((m, n)) < 0.3) + np.eye(m, n)
        a[a.sum(axis=1) == 0, 0] = 0.5
        y = rng.random(m) ** 4
        out[f"S{k}"] = (a, y / y.sum())
    return out


def frame_of(spark, systems):
    rows = [(s, i % 3, f"r{i}", j * 10, float(a[i, j]), float(y[i])) for s, (a, y) in systems.items() for i, j in np.argwhere(a).tolist()]
    return spark.createDataFrame(rows, SYSTEM)


def dense_em(a, y, cfg, x=None):
    """The solve on a whole matrix; pruning deletes columns, and rows that have no entry left."""
    cols = np.arange(a.shape[1])
    x = a.T @ y / (a.T @ y).sum() if x is None else x
    for step in range(1, cfg.num_iter + 1):
        factor = a.T @ (y / (a @ x + EPS))
        error = np.abs(1 - factor) @ x
        x = x * factor
        if error < cfg.tol:
            break
        if cfg.prune_every and step % cfg.prune_every == 0:
            stay = x >= cfg.zero
            a, x, cols = a[:, stay], x[stay], cols[stay]
            rows = (a > 0).any(axis=1)
            a, y = a[rows], y[rows]
    x = np.where(x > cfg.zero, x, 0)
    return dict(zip(cols.tolist(), (x / x.sum()).tolist(), strict=True)), step


CONFIGS = [AlgoConfig(num_iter=7, tol=2e-2), AlgoConfig(num_iter=10, prune_every=4, zero=0.02, tol=1e-3)]


@pytest.mark.parametrize("cfg", CONFIGS, ids=["not all in time", "pruned"])
def test_blocks_equal_tasks_and_dense(spark, cfg):
    systems = dense_systems(samples=3)
    sys = frame_of(spark, systems).repartition(4).cache()
    blocks = {(r["sample"], r.col): (r.x, r.iterations) for r in mixture.solve_blocks(sys, cfg, block_entries=60).collect()}
    tasks = {(r["sample"], r.col): (r.x, r.iterations) for r in solve.em_tasks(sys, cfg).collect()}
    assert blocks.keys() == tasks.keys()
    for s, (a, y) in systems.items():
        want, steps = dense_em(a, y, cfg)
        for j in range(a.shape[1]):
            x, n = blocks[s, j * 10]
            assert abs(x - want.get(j, 0)) < 1e-9 and abs(tasks[s, j * 10][0] - want.get(j, 0)) < 1e-9 and n == tasks[s, j * 10][1] == steps
    if cfg.prune_every:
        assert sum(x == 0 for x, _ in blocks.values()) > 2


def test_large_samples_are_spread_and_small_ones_not(spark, monkeypatch):
    systems = dense_systems(samples=3)
    sys = frame_of(spark, systems)
    entries = {s: int((a > 0).sum()) for s, (a, _) in systems.items()}
    above = sorted(entries.values())[0]
    spread = {}
    blocks = mixture.solve_blocks
    monkeypatch.setattr(solve, "solve_blocks", lambda df, cfg: spread.update({r["sample"]: 1 for r in df.select("sample").distinct().collect()}) or blocks(df, cfg))
    cfg = AlgoConfig(tol=5e-2)
    mixed = {(r["sample"], r.col): r.x for r in solve.em(sys, AlgoConfig(tol=5e-2, distribute_above=above)).collect()}
    plain = {(r["sample"], r.col): r.x for r in solve.em(sys, cfg).collect()}
    assert set(spread) == {s for s, n in entries.items() if n > above} and len(spread) == 2
    assert mixed.keys() == plain.keys() and max(abs(mixed[k] - plain[k]) for k in plain) < 1e-9


def test_an_update_shuffles_no_entries(spark):
    sys = frame_of(spark, dense_systems(samples=2))
    packed, routes = mixture._laid_out(mixture.pack_blocks(sys, 30))
    x = mixture.stage(solve.em_init(sys), "x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixture._factors(packed, routes, x)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    # frequencies to routes, frequencies to blocks, factors to columns
    assert len(moved) == 3 and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2


def test_nothing_to_solve(spark):
    none = spark.createDataFrame([], SYSTEM)
    assert mixture.solve_blocks(none, AlgoConfig()).count() == 0 and solve.em(none, AlgoConfig(distribute_above=0)).count() == 0


def test_rows_that_columns_emptied_leave():
    row, col, a, y = np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2]), np.ones(4), np.array([0.1, 0.2, 0.7])
    row, col, a, y = mixture.compact(row, col, a, y, np.array([True, False, True]))
    assert row.tolist() == [0, 1] and col.tolist() == [0, 1] and y.tolist() == [0.1, 0.7]


def test_likelihood_without_a_column(spark):
    systems = dense_systems(samples=2)
    systems["alone"] = (np.array([[1.0], [0.5]]), np.array([0.25, 0.75]))
    # the second column alone explains the second row
    systems["lost"] = (np.array([[1.0, 0.2], [0.0, 1.0]]), np.array([0.5, 0.5]))
    sys, cfg = frame_of(spark, systems), AlgoConfig(tol=1e-6)
    x = solve.em(sys, cfg)
    got = {(r["sample"], r.col): r.loglik for r in mixture.likelihood_without(sys, x, cfg, per_task=2).collect()}
    assert len(got) == sum(a.shape[1] for a, _ in systems.values())
    for s, (a, y) in systems.items():
        warm, _ = dense_em(a, y, cfg)
        for j in range(a.shape[1]):
            rest = np.delete(np.arange(a.shape[1]), j)
            theta = np.zeros(len(y))
            if len(rest):
                start = np.array([warm.get(k, 0) for k in rest])
                found, _ = dense_em(a[:, rest], y, cfg, start / start.sum())
                theta = a[:, rest] @ np.array([found[k] for k in range(len(rest))])
            assert abs(got[s, j * 10] - y @ np.log(theta + EPS)) < 1e-6


def plain_included(sets):
    return {i for i, a in sets.items() if any(a < b for b in sets.values())}


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_is_brute_force(spark, seed):
    """Also where one row is in all columns, columns repeat, and rows are few."""
    draw = random.Random(seed)
    sets = {("S", c): frozenset(["all", *(f"r{draw.randrange(12)}" for _ in range(draw.randrange(7)))]) for c in range(60)}
    sets |= {("T", c): frozenset(f"r{draw.randrange(200)}" for _ in range(1 + draw.randrange(60))) for c in range(30)}
    sets |= {("T", 100 + c): frozenset(sorted(sets["T", c])[::2]) for c in range(30)}
    rows = [(s, 1, r, c) for (s, c), own in sets.items() for r in own]
    got = {(r["sample"], r.col) for r in solve.included(spark.createDataFrame(rows, "sample string, region int, seq string, col long")).collect()}
    assert got == {k for s in "ST" for k in plain_included({k: v for k, v in sets.items() if k[0] == s})}


def test_containment_compares_few_pairs(spark):
    """With a row in every one of 300 columns, and every column else apart, only the column of that row alone meets the others."""
    rows = [("S", c, r) for c in range(300) for r in (0, *range(c * 5 + 1, c * 5 + 1 + c % 5))]
    own = spark.createDataFrame(rows, "sample string, set long, row long")
    sets = own.groupBy("sample", "set").agg(F.count("*").alias("nnz"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod("row", F.lit(61))).cast("int"))).alias("s0"))
    # equal sets were taken out before
    sets = sets.where("nnz > 1 or set = 0")
    own = own.join(sets.select("sample", "set"), ["sample", "set"], "left_semi")
    n = sets.count()
    assert n == 241 and solve.containment_pairs(own, sets).count() == n - 1


def test_reference_grows_until_none_joins(spark):
    """A chain of reads, each one mismatch further away; a round goes as far as the limit from what has joined."""
    base = "ACGTACGTAC"
    step = lambda k: base[:k].translate(str.maketrans("ACGT", "CGTA")) + base[k:]
    seqs = [(step(k), 9) for k in (2, 3, 4, 5)] + [("G" * 10, 50), (base, 7), (base[:9] + "G", 1)]
    reads = spark.createDataFrame([("S", 1, s, n) for s, n in seqs], "sample string, region int, seq string, n long")
    known = spark.createDataFrame([(1, base, 1), (1, "C" * 10, 2)], "region int, kmer string, kmer_id int")
    of = spark.createDataFrame([(7, 1, 1), (8, 1, 1), (9, 1, 2)], "bact_id long, region int, kmer_id int")
    for rounds, joined in ((1, (2,)), (2, (2, 3, 4)), (9, (2, 3, 4, 5))):
        k, o = refdb.augment(reads, known, of, AlgoConfig(), 10, least=2, limit=2, rounds=rounds)
        new = {r.kmer: r.kmer_id for r in k.where("kmer_id > 2").collect()}
        assert set(new) == {step(j) for j in joined} and sorted(new.values()) == list(range(3, 3 + len(new)))
        assert {(r.kmer_id, r.bact_id) for r in o.where("kmer_id > 2").collect()} == {(i, b) for i in new.values() for b in (7, 8)}
        assert {r.kmer: r.kmer_id for r in k.where("kmer_id <= 2").collect()} == {base: 1, "C" * 10: 2}


def test_a_laid_out_reference_is_not_shuffled(spark, tmp_path):
    draw = random.Random(9)
    seq = lambda: "".join(draw.choice("AC") for _ in range(12))
    reads = spark.createDataFrame([("S", 1 + i % 2, seq(), 3) for i in range(200)], "sample string, region int, seq string, n long").distinct()
    known = spark.createDataFrame([(1 + i % 2, s, i) for i, s in enumerate(sorted({seq() for _ in range(80)}))], "region int, kmer string, kmer_id int")
    of = spark.createDataFrame([(100 + i, 1 + i % 2, i) for i in range(80)], "bact_id long, region int, kmer_id int")
    cfg = AlgoConfig()
    laid = match.Catalogue.write(known, of, "laid", str(tmp_path / "laid"), cfg, 12, 8)
    rows = lambda df: sorted(map(tuple, df.select("sample", "region", "seq", "kmer_id", "d").collect()))
    assert rows(laid.matches(reads)) == rows(match.matches(reads, known, cfg, 12))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame(laid.matches(reads).collect(), "region int, sample string, seq string, n long, kmer string, kmer_id int, d int")
        for df in (laid.matches(reads), found.join(laid.of, ["region", "kmer_id"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 1
            # one for the reads, and one for the distinct of the test's own reads
            assert plan.count("Exchange hashpartitioning") == 1 + ("HashAggregate" in plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="classes"):
        match.Catalogue.read(spark, "laid", AlgoConfig(n_mm_cut=1), 12)
