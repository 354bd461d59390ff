"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together.  Groups sorted by size enter the bin with
the tightest remaining capacity that still holds them; open bins live in a
balanced tree keyed by remaining capacity.  The capacity is the least one for
which the wanted number of shards suffices.

The driver packs runs: a size, and how many groups have it.  Groups of one size are
alike, and the tightest bin stays the tightest while it takes them, so a run
fills bin after bin and gives what packing its groups one by one would.  Sizes that
differ add up, so ``n`` bytes hold at most ``sqrt(2 n)`` of them: 2e5 at 30 GB,
1.4e7 at 100 TB, whatever the number of groups.  A group finds its bin by its
number among those of its size; no task gathers the groups of a size.

Defined results: a null text counts as empty; null ids are kept; repeated rows
share a group; an empty table gives no rows; input columns beyond those named
are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.llm.common import stage

#: Rows per block in which slots, and groups of a size, are numbered.
BLOCK_ROWS = 20_000


@dataclass
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """AVL tree of open bins, keyed by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _h(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        tilt = self._h(n.left) - self._h(n.right)
        if tilt > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            n = self._turn(n, "left", "right")
        elif tilt < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            n = self._turn(n, "right", "left")
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        return n

    def _turn(self, n: _Node, up: str, down: str) -> _Node:
        top = getattr(n, up)
        setattr(n, up, getattr(top, down))
        setattr(top, down, n)
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        top.height = 1 + max(self._h(top.left), self._h(top.right))
        return top

    def add(self, key: tuple[int, int]) -> None:
        def go(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = go(n.left)
            else:
                n.right = go(n.right)
            return self._fix(n)

        self.root = go(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def go(n, key):
            if key < n.key:
                n.left = go(n.left, key)
            elif key > n.key:
                n.right = go(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = go(n.right, least.key)
            return self._fix(n)

        self.root = go(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least key whose remaining capacity is at least ``size``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each run, a size and how many items have it, in falling order of size: bins and how many items each takes.

    None where an item exceeds the capacity or more than ``most`` bins are needed.
    """
    tree, out, bins = CapacityTree(), [], 0
    for size, count in runs:
        own = []
        while count:
            at = tree.tightest(size)
            if at is None:
                if size > capacity or bins == most:
                    return None
                at = (capacity, bins)
                bins += 1
            else:
                tree.remove(at)
            n = min(count, at[0] // size)
            tree.add((at[0] - n * size, at[1]))
            own.append((at[1], n))
            count -= n
        out.append(own)
    return out


def least_capacity(runs: list[tuple[int, int]], shards: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """The least capacity, and the packing, for which best-fit-decreasing needs at most ``shards`` bins.

    Steps up from the least conceivable capacity until one suffices, then halves
    the last step.
    """
    if not runs:
        return 0, []
    low = high = max(runs[0][0], -(-sum(s * n for s, n in runs) // shards))
    found, step = best_fit_decreasing(runs, low, shards), max(1, low // 1_000_000)
    while found is None:
        low, high = high + 1, high + step
        step *= 2
        found = best_fit_decreasing(runs, high, shards)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(runs, mid, shards)
        if tried is None:
            low = mid + 1
        else:
            high, found = mid, tried
    return high, found


def numbered(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Adds ``number``, gapless from 0 among rows equal in ``by``.

    Rows are dealt to blocks; each block numbers its own rows and starts where
    the blocks before it end, so no task holds all rows of a value.
    """
    rows = stage(rows.withColumn("_n", F.monotonically_increasing_id()), "shard-numbered")
    blocks = max(1, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)))
    counts = rows.groupBy(by, "_block").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select(by, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")), "shard-starts")
    own = F.row_number().over(Window.partitionBy(by, "_block").orderBy("_n")) - 1
    return rows.withColumn("_i", own).join(starts, [by, "_block"]).withColumn(number, (F.col("_start") + F.col("_i")).cast("long")).drop("_n", "_block", "_start", "_i")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes.

    Returns ``id_col, size, text_crc32, shard, slot``: ``size`` is the UTF-8
    length plus 1, ``slot`` counts from 0 without gaps within a shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_g1"),
            F.xxhash64(F.lit("strandloom"), text).alias("_g2"),
        ),
        "shard-rows",
    )
    groups = numbered(rows.groupBy("_g1", "_g2").agg(F.sum("size").alias("_gs")), "_gs", "_rank")
    runs = sorted(((r["_gs"], r["c"]) for r in groups.groupBy("_gs").agg(F.count("*").alias("c")).collect()), reverse=True)
    _, placed = least_capacity(runs, shards)
    cuts = []
    for (size, _), own in zip(runs, placed, strict=True):
        ends, end = [], 0
        for shard, n in own:
            end += n
            ends.append((end, shard))
        cuts.append((size, ends))
    of_size = spark.createDataFrame(cuts, "_gs long, _cuts array<struct<e: long, shard: int>>")
    shard = F.filter("_cuts", lambda c: F.col("_rank") < c["e"])[0]["shard"]
    groups = stage(groups.join(of_size, "_gs").select("_g1", "_g2", shard.alias("shard")), "shard-placed")
    out = numbered(rows.join(groups, ["_g1", "_g2"]).select("_id", "size", "text_crc32", "shard"), "shard", "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op10_shards(spark, sf_dir: str) -> DataFrame:
    from strandloom.llm.common import table

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast(T.IntegerType())).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
