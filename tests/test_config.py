"""Settings, names and the command line."""

import logging

import pytest
from pyspark.sql import functions as F

from strandloom import __main__ as command
from strandloom.config import AlgoConfig, PrepConfig, db_paths, get_config
from strandloom.operators import regions
from strandloom.plans import profile
from strandloom.sources import reference, sinks


def test_derived_settings():
    assert get_config("126").prep.read_len == 126 and get_config(100, pe=0.01).algo.pe == 0.01
    assert PrepConfig(read_len=10**6).read_len == PrepConfig(read_len=10**9).read_len < 1000
    assert not PrepConfig(read_len=5, paired=False).dest_paired and PrepConfig(read_len=5).dest_paired
    assert (AlgoConfig().halves, AlgoConfig(read_type="SE").halves, AlgoConfig().const_len, AlgoConfig(read_type="SE").const_len) == (1, 2, False, True)
    with pytest.raises(ValueError):
        PrepConfig(read_len=0)


def test_database_and_report_names():
    paths = db_paths("/db/", "Silva", 90)
    assert set(paths) == {"catalog", "headers", "regions", "taxonomy"} and paths["taxonomy"] == "/db/taxonomy_db"
    assert paths["headers"] == paths["catalog"] + "_headers" and paths["regions"].startswith("/db/Silva_unique_up_to_") and paths["regions"].endswith("_RL90")
    assert reference.read_len_of(paths["regions"]) == 90 and reference.read_len_of("x") is None
    assert sinks.report_path("a/b", "species") == "a/SPECIES_b" and sinks.report_path("b", "groups", "GroupSizes_") == "GroupSizes_GROUPS_b"
    assert sinks.stats_path("a/b") == "a/ReadCountStats_b"


def test_catalogs_with_and_without_sequences(spark, tmp_path):
    """A table of headers alone is read where there is one and sequences are not asked for."""
    paths = db_paths(str(tmp_path), "x")
    spark.createDataFrame([(1, [1.0], "ACGT")], reference.CATALOG_SCHEMA).write.parquet(paths["catalog"])
    assert reference.read_catalog(spark, str(tmp_path), "x").columns == ["bact_id", "headers"]
    spark.createDataFrame([(1, [2.0])], "bact_id long, headers array<double>").write.parquet(paths["headers"])
    assert reference.read_catalog(spark, str(tmp_path), "x").first().headers == [2.0]
    assert tuple(reference.read_catalog(spark, str(tmp_path), "x", True).first()) == (1, [1.0], "ACGT")


def test_samples_without_reads_have_zeros(spark):
    found = spark.createDataFrame([("A", 1, "x", 5), ("A", 1, "y", 2)], "sample string, region int, seq string, n long")
    got = {(r["sample"], r.region): (r.n_unique, r.n_reads) for r in regions.totals(found, spark.createDataFrame([("A",), ("B",)], "sample string"), (1, 2)).collect()}
    assert got == {("A", 1): (2, 7), ("A", 2): (0, 0), ("B", 1): (0, 0), ("B", 2): (0, 0)}


def test_missing_folders_end_a_run(spark, tmp_path, caplog):
    with caplog.at_level(logging.ERROR, "strandloom"):
        assert profile.run(spark, str(tmp_path), str(tmp_path), "x", str(tmp_path / "none" / "res")) == {}
    assert "no such folder" in caplog.text


def test_command_line(spark, monkeypatch, capsys):
    seen = []
    monkeypatch.setattr(command, "run", lambda _, *a, **kw: seen.append((a, kw)) or {"species": "p"})
    command.main(["in", "db", "name", "out/res", "126", "1", "--flat", "--store", "s"])
    command.main(["in", "db", "name", "out/res"])
    assert seen[0] == (("in", "db", "name", "out/res", 126, True), {"flat": True, "store": "s"})
    assert seen[1] == (("in", "db", "name", "out/res", 100, False), {"flat": False, "store": None})
    assert capsys.readouterr().out == "species p\n" * 2


def test_regions_expand_to_all_asked_for(spark):
    none = spark.createDataFrame([], "sample string, region int, seq string, n long")
    assert regions.totals(none).count() == 0
    assert regions.totals(none, spark.createDataFrame([("A",)], "sample string")).agg(F.sum("n_reads"), F.count("*")).first()[:] == (0, 5)
