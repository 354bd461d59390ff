"""Tables that look small by their files, and classes of bacteria that are matched as one."""

import pytest
from pyspark.sql import functions as F

from strandloom.config import AlgoConfig
from strandloom.operators import match, refdb, report, solve, taxonomy
from strandloom.plans import catalog, fixture
from strandloom.plans.staging import stage

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ref(spark):
    return stage(fixture.tables(spark, DATA)["ref"], "ref")


def test_no_table_of_bacteria_is_sent_to_the_driver(spark, ref):
    """Their files are far below the limit for that, as values repeat; their rows need not be."""
    known = stage(refdb.kmers(ref), "known")
    assert "BroadcastHashJoin" not in plan(refdb.bact_kmers(ref, known))
    assert "BroadcastHashJoin" not in plan(refdb.classes(ref))
    lik = stage(spark.createDataFrame([("S", 1, "A", 1, 5, 0, 0.5, 1)], "sample string, region int, seq string, bact_id long, n long, d int, p double, len int"), "lik")
    assert "BroadcastHashJoin [bact_id" not in plan(solve.present_everywhere(lik, ref, refdb.amplified(ref), AlgoConfig()))
    members = spark.range(1).select(F.lit("S").alias("sample"), F.lit(1).alias("group_id"), F.lit(1).cast("long").alias("bact_id"))
    part = stage(fixture.tables(spark, DATA)["taxonomy"], "taxonomy")
    assert "BroadcastHashJoin" not in plan(taxonomy.levels(members, part))
    assert "BroadcastHashJoin" not in plan(report.group_sources(members, part.select("bact_id", F.array(F.lit(1.0)).alias("headers"))))


def test_least_members_stand_for_their_class(spark, ref):
    reads = stage(ref.where("kmer is not null").select(F.lit("S").alias("sample"), "region", F.col("kmer").alias("seq")).distinct().withColumn("n", F.lit(3).cast("long")), "reads")
    known, of = refdb.kmers(ref), stage(refdb.classes(ref), "classes")
    least = stage(refdb.least_members(ref, of), "least")
    assert least.select("bact_id").distinct().count() == of.select("class_id").distinct().count() < of.count()
    cols = ["sample", "region", "seq", "bact_id", "n", "d", "len"]
    rows = lambda df: sorted((*r[:-1], round(r[-1], 12)) for r in df.select(*cols, "p").collect())
    found = match.matches(reads, known, AlgoConfig(), catalog.MAX_LEN)
    lik = stage(match.likelihoods(found, refdb.bact_kmers(least, known), AlgoConfig()), "lik")
    assert rows(refdb.each_member(lik, of)) == rows(match.likelihoods(found, refdb.bact_kmers(ref, known), AlgoConfig()))


def test_members_of_a_large_class_are_dealt_to_many_tasks(spark):
    of = stage(spark.range(4000).select(F.col("id").alias("bact_id"), F.lit(0).cast("long").alias("class_id")), "classes")
    rows = spark.createDataFrame([(0, "x"), (0, "y")], "bact_id long, v string")
    out = refdb.each_member(rows, of)
    assert out.count() == 8000 and out.distinct().count() == 8000
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_the_fixture_lays_out_one_bacterium_a_class(spark):
    fx = catalog.Fixture(spark, DATA)
    assert fx.least.select("bact_id").distinct().count() == 60 < fx.ref.select("bact_id").distinct().count()
    assert catalog._laid_out(fx).of.select("bact_id").distinct().count() == 60
