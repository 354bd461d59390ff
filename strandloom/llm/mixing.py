"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Every source gets a share of all words in proportion to its weight, at most
``max_epochs`` times its own size; what a clamped source can't take is reshared
among the others by weight until none is above its limit.  With sources sorted
by limit over weight the level at which the rest settles follows from running
sums, so no iteration is needed.

A source's target is ``whole`` repetitions of it and a fraction.  The fraction
is the start of the source's documents in a seeded order (md5 of seed and id):
a document belongs to it if its middle word does, so the words taken differ
from the target by half a document at most.  The end of that start is found in
two steps: running sums over hash buckets, then over the documents of one
bucket.  No task orders a whole source.

Defined results: null source is a source of its own, last in order; null or
empty text has size 0 and takes nothing; rows with equal ids are taken or left
together; an empty table gives no rows; columns other than those named are
carried only by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import WORD, stage, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def order_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))))


def fill(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals(source, source_size)`` with ``weight`` and ``target``.

    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    i = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), i.cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    )
    level = weighed.withColumn("_level", level)
    held = F.col("_level") * F.col("weight") <= F.col("cap")
    settled = F.min(F.when(held, F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("l")))).over(every)
    return level.withColumn("_settled", settled["l"]).select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("_settled") * F.col("weight"), F.col("cap").cast("double")).alias("target"),
    )


def plan(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: ``source_size, target, whole, last_key``.

    ``sizes`` has ``source, key, size``.  A row is taken ``whole`` times, and
    once more if its key is at most ``last_key``.
    """
    bucket = F.substring("key", 1, 3)
    buckets = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    buckets = stage(buckets, "mix-buckets")
    goal = fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.least(F.floor(ratio), F.lit(max_epochs)).cast("int"))
    goal = stage(goal.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b, g = buckets.alias("b"), goal.alias("g")
    edge = (
        b.withColumn("start", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
        .join(g, F.col("b.source").eqNullSafe(F.col("g.source")))
        .where((F.col("start") <= F.col("extra")) & (F.col("extra") < F.col("start") + F.col("n")))
        .select(F.col("b.source").alias("source"), "bucket", "start", "extra")
    )
    edge = stage(edge, "mix-edge").alias("e")
    s = sizes.withColumn("bucket", bucket).groupBy("source", "bucket", "key").agg(F.sum("size").alias("size")).alias("s")
    in_edge = s.join(
        edge, F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.bucket") == F.col("e.bucket"))
    ).select(F.col("s.source").alias("source"), "key", "size", "start", "extra")
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        in_edge.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        .where(F.col("at") + F.col("size") / 2 <= F.col("extra"))
        .groupBy("source")
        .agg(F.max("key").alias("in_bucket"))
        .alias("l")
    )
    e = edge.select("source", "bucket").alias("e")
    return stage(
        g.join(e, F.col("g.source").eqNullSafe(F.col("e.source")), "left")
        .join(last, F.col("g.source").eqNullSafe(F.col("l.source")), "left")
        .select(
            F.col("g.source").alias("source"),
            "source_size",
            "target",
            "whole",
            # a bare bucket name sorts before all keys in it, after all keys of the buckets before
            F.coalesce("in_bucket", "bucket").alias("last_key"),
        ),
        "mix-plan",
    )


def repetitions() -> Column:
    return F.col("whole") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col),
        F.col(source_col).alias("source"),
        order_key(F.col(id_col), seed).alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def mix_counts(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken, repetitions``."""
    rows = stage(_sizes(docs, id_col, text_col, source_col, seed), "mix-sizes").alias("s")
    p = plan(rows, weights, max_epochs).alias("p")
    # the plan is a written table of one row per source: Spark knows its size and broadcasts it only if small
    return rows.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        id_col,
        "size",
        "source_size",
        "target",
        (F.col("size") * repetitions()).cast("long").alias("taken"),
        repetitions().alias("repetitions"),
    )


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Documents without a word take no place in the mix and are left out.
    """
    rows = stage(_sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    p = plan(rows, weights, max_epochs).select(F.col("source").alias("_source"), "whole", "last_key")
    keyed = docs.select(F.struct("*").alias("_row")).withColumn("key", order_key(F.col(f"_row.{id_col}"), seed))
    keyed = keyed.where(F.coalesce(F.col(f"_row.{text_col}"), F.lit("")).rlike(WORD))
    return (
        keyed.join(p, F.col(f"_row.{source_col}").eqNullSafe(F.col("_source")))
        .select("_row", F.explode(F.array_repeat(F.lit(0), repetitions())))
        .select("_row.*")
    )


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("repetitions")


OP2_SQL = rf"""
WITH s AS (
  SELECT doc_id, source, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS key,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
l AS (SELECT *, cap::DOUBLE / weight AS lim,
        (sum(source_size) OVER () - COALESCE(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - COALESCE(sum(weight) OVER o, 0))::DOUBLE AS lev
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least((SELECT lev FROM l WHERE lev * weight <= cap ORDER BY lim, source NULLS LAST LIMIT 1) * weight, cap::DOUBLE) AS target FROM l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM g),
r AS (SELECT s.*, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS extra,
        COALESCE(sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN pos + size / 2.0 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
