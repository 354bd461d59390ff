"""Helpers shared by the operators: shared storage, staging and components."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, and the white space between words, as every contract here has them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and driver and
    executors are one process; on a cluster a missing folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs only tasks after this point.  The files go when the
    driver ends, or with ``unstage``.  ``free`` is for large stages: their shuffle
    files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # hashes and ids, most of what is staged, would fill dictionaries for nothing
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}).parquet(path)
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    if free:
        # Spark deletes shuffle files once nothing refers to their plan, and finds out when the driver collects
        # garbage; listeners hold a plan a moment longer
        for wait in (0.3, 0):
            spark.sparkContext._jvm.System.gc()
            time.sleep(wait)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in staged:
        at, fs = _path(df.sparkSession, df.staged_at)
        fs.delete(at, True)


def row_marks(id_col: str, text_col: str) -> list[Column]:
    """``r1, r2``: 128 bits that find a row again where ids are null or repeat; equal id and text, equal marks."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("r1"), F.xxhash64(F.lit("row"), F.col(text_col), F.col(id_col)).alias("r2")]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, root)``.

    ``root`` is the smallest id of the component.  Alternates large-star and
    small-star steps until no edge changes.  Each is one shuffle by node: a row
    becomes one row, so equal edges need no shuffle of their own and go at the
    end.  The rows of a hub are sorted, and spilled, in one task.  Ids without an
    edge are not returned.
    """
    lowest = F.min("v").over(Window.partitionBy("u"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    old = mark = None
    for _ in range(rounds):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = both.withColumn("m", F.least("u", lowest)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", lowest).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small, "edges")
        if old:
            unstage(old)
        old = edges
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("root")), F.struct(F.col("v").alias("id"), F.col("v").alias("root"))))
    found = stage(edges.select(ids.alias("x")).select("x.*").distinct(), "roots", free=True)
    unstage(edges)
    return found


def settle(members: DataFrame, info: list[str], may, verify, more=None, may_more=None, rounds: int = 4, twos: DataFrame | None = None, hubs: int = 0) -> DataFrame:
    """Groups of like nodes as ``id, root``, from buckets of candidates; nodes without a link are not returned.

    ``members`` has ``key, node, leader, c``, the columns ``info`` and, with the
    prefix ``lead_``, those of the leader: a row for each node of a bucket of
    several, its leader included.  Buckets of two may come as ``twos`` instead, once
    for each pair: ``node, leader`` and the same columns.  ``may(p, q)`` is a bound on the columns with
    prefixes ``p`` and ``q`` that every like pair meets; ``verify(pairs)`` adds
    ``linked`` to ``a, b``.  ``more(nodes)`` gives further columns of those nodes
    for ``may_more``, a tighter bound, which may also name the one bucket where a pair counts.

    Nodes are compared with their bucket's leader first.  Then, for at most
    ``rounds`` times and while it pays, those in another group than it are compared
    with a leader of their own.  Where some still are, the bucket's nodes are, at
    most ``hubs`` times, compared with one of the first leader's group and one of the largest other.  Last, what is still in another group than the
    first leader is compared with all of the bucket that is not in its own
    group.  So every pair of a bucket is compared, found unlike by a bound, or in
    one group already: no bucket emits all its pairs, and no link that could
    join two groups is lost.
    """
    pair = lambda df, x, y: df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    members = stage(members, "settle-members")
    first = members.where(F.col("node") != F.col("leader")).where(may("", "lead_")).select("node", "leader")
    if twos is not None:
        first = first.unionByName(twos.where(may("", "lead_")).select("node", "leader"))
    first = stage(pair(first, "node", "leader"), "settle-first")
    seen = stage(verify(first), "settle-found")
    done = [members, seen]
    unstage(first)
    roots = components(seen.where("linked").select("a", "b"))

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        found = roots.select(F.col("id").alias(node), F.col("root").alias(root))
        return df.drop(root).join(found, node, "left").withColumn(root, F.coalesce(root, node))

    def merged(links: DataFrame) -> DataFrame:
        found = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b")))
        unstage(roots)
        return found

    def unsettled(df: DataFrame) -> DataFrame:
        return rooted(rooted(df, "node", "root"), "leader", "lead_root")

    wide = members.where("c > 2").drop(*(f"lead_{c}" for c in info))
    rest = stage(unsettled(wide).where("root <> lead_root").select("key", "node", *info, "root"), "settle-rest")
    left = rest.count()
    for _ in range(rounds):
        if not left:
            break
        heads = rest.groupBy("key").agg(F.min(F.struct("node", "root", *info)).alias("h"))
        heads = heads.select("key", F.col("h.node").alias("leader"), F.col("h.root").alias("lead_root"), *(F.col(f"h.{c}").alias(f"lead_{c}") for c in info))
        led = stage(rest.join(heads, "key").where("root <> lead_root"), "settle-led")
        new = pair(led.where(may("", "lead_")), "node", "leader").join(seen.select("a", "b"), ["a", "b"], "left_anti")
        found = stage(verify(new), "settle-found")
        done.append(found)
        links = found.where("linked")
        n = links.count()
        seen = seen.unionByName(found)
        if n:
            roots = merged(links)
        unstage(rest)
        rest = stage(unsettled(led).where("root <> lead_root").select("key", "node", *info, "root"), "settle-rest")
        unstage(led)
        before, left = left, rest.count()
        if n * 20 < before:
            break
    unstage(rest)
    kept = wide = stage(unsettled(wide), "settle-wide")
    keys = wide.where("root <> lead_root").select("key").distinct()
    wide = wide.join(keys, "key", "left_semi")
    # nodes that are like most of a group, but not its leader, would all be links of the last join
    for _ in range(hubs):
        # of a group the least by its columns: short texts are like more of the others
        held = wide.withColumn("own", F.col("root") == F.col("lead_root")).groupBy("key", "root", "own").agg(F.count("*").alias("n"), F.min(F.struct(*info, "node")).alias("h"))
        heads = held.groupBy("key", "own").agg(F.min_by(F.struct("h", "root"), F.struct(-F.col("n"), "h")).alias("of"))
        heads = heads.select("key", F.col("of.h.node").alias("leader"), F.col("of.root").alias("lead_root"), *(F.col(f"of.h.{c}").alias(f"lead_{c}") for c in info))
        led = wide.drop("leader", "lead_root").join(heads, "key").where("root <> lead_root")
        new = pair(led.where(may("", "lead_")), "node", "leader").join(seen.select("a", "b"), ["a", "b"], "left_anti")
        first = stage(new, "settle-first")
        found = stage(verify(first), "settle-found")
        done.append(found)
        unstage(first)
        seen, links = seen.unionByName(found), found.where("linked")
        n = links.count()
        if not n:
            break
        roots, old = merged(links), kept
        kept = wide = stage(unsettled(wide), "settle-wide")
        unstage(old)
        wide = wide.join(wide.where("root <> lead_root").select("key").distinct(), "key", "left_semi")
        if n * 20 < wide.select("node").distinct().count():
            break
    if more is not None:
        extra = stage(more(wide.select("node").distinct()), "settle-more")
        info = [*info, *(c for c in extra.columns if c != "node")]
        wide, old = stage(wide.join(extra, "node"), "settle-wide"), kept
        kept = wide
        unstage(old, extra)
    apart = wide.where("root <> lead_root").select("key", *(F.col(c).alias(f"f_{c}") for c in ("node", "root", *info)))
    # each pair comes from one side only
    one_side = (F.col("root") == F.col("lead_root")) | (F.col("f_node") > F.col("node"))
    last = wide.join(apart, "key").where((F.col("f_root") != F.col("root")) & one_side & may("", "f_") & (may_more or may)("", "f_"))
    last = pair(last, "node", "f_node").join(seen.select("a", "b"), ["a", "b"], "left_anti")
    last = stage(last, "settle-last", free=True)
    unstage(*done, kept)
    return merged(verify(last).where("linked"))
