"""Near-duplicate documents by Order MinHash.

Words make k-mers of five, each labelled with its occurrence in the text.  A
sketch takes, under one of ``SKETCHES`` hash orders, the ``PICK`` smallest
labelled k-mers and keeps them in text order, so its chance to agree falls with
edits and with moved passages.  Texts that share a sketch are candidates; they
are linked if a banded alignment of their words finds an edit similarity
(1 - distance / longer length) of at least 0.8.  A class is a connected group.

Texts with equal words, told by 128 bits, are one node from the start.  Buckets of
equal sketches are settled by ``common.settle``: no pair that could join two
groups is left out, none has a cap.

Defined results: a null text counts as empty, and texts without words form one
class; with fewer than five words the whole text is the only k-mer; of each class
one row stays, that of the smallest id (a null id only if no other), then of the
smallest hash of id and text; of rows with that id and text any one stays; an
empty table gives no rows; other columns, whatever their names, are only carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bytehash import Powers, mix, word_hashes
from strandloom.llm.common import row_marks, settle, stage, table, unstage

K = 5
PICK = 3
SKETCHES = 24
#: An edit similarity of at least 1 - 1/PART.
PART = 5
#: Longs of a text's word bits.
BAG = 64
CHUNK = 2_000_000
#: Cells of the bands aligned together, and of their padded texts.
BAND = 60_000
PADDED = 4_000_000


def _chunks(values: list[bytes], limit: int):
    start = n = 0
    for i, v in enumerate(values):
        n += len(v)
        if n >= limit:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(values):
        yield start, len(values)


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of one text with their occurrence numbers."""
    n = len(words)
    if n <= k:
        j = np.arange(1, n + 1, dtype=np.uint64)
        return mix((words * (2 * j + 1)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else words
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = (out + words[j : n - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    if same.any():
        at = np.arange(len(same))
        first = np.maximum.accumulate(np.where(same, 0, at))
        labels = np.empty(len(same), np.uint64)
        labels[order] = (at - first).astype(np.uint64)
        out = out + labels * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def sketch(kmers: np.ndarray, seeds: np.ndarray, pick: int = PICK) -> np.ndarray:
    """One 64-bit value per seed: the ``pick`` smallest k-mers, in text order."""
    if not len(kmers):
        return np.zeros(0, np.uint64)
    if len(kmers) <= pick:
        chosen = np.broadcast_to(kmers, (len(seeds), len(kmers)))
    else:
        ranks = (kmers[None, :] ^ seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(29)
        ranks *= np.uint64(0x94D049BB133111EB)
        at = np.sort(np.argpartition(ranks, pick - 1, axis=1)[:, :pick], axis=1)
        chosen = kmers[at]
    out = seeds.copy()
    for j in range(chosen.shape[1]):
        out = mix(out * np.uint64(31) + chosen[:, j])
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """``id, r1, r2, w1, w2, n_words, marks``.

    ``r1, r2`` is a hash of id and text, ``w1, w2`` one of the words, ``marks`` the sketches.
    """
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))

    def run(batches):
        powers = Powers()
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts, CHUNK):
                hashes, bounds = word_hashes(texts[a:b], powers)
                node, node2, size, marks = [], [], [], []
                for i in range(b - a):
                    w = hashes[bounds[i] : bounds[i + 1]]
                    digest = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
                    node.append(int.from_bytes(digest[:8], "little", signed=True))
                    node2.append(int.from_bytes(digest[8:], "little", signed=True))
                    size.append(len(w))
                    marks.append(sketch(labelled_kmers(w), seeds, pick).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in (0, 2, 3)),
                        pa.array(node, pa.int64()),
                        pa.array(node2, pa.int64()),
                        pa.array(size, pa.int32()),
                        pa.array(marks, pa.list_(pa.int64())),
                    ],
                    names=["id", "r1", "r2", "w1", "w2", "n_words", "marks"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_marks(id_col, text_col)).mapInArrow(
        run, f"id {kind}, r1 long, r2 long, w1 long, w2 long, n_words int, marks array<long>"
    )


def bag_bits(words: np.ndarray) -> np.ndarray:
    """A bit set of the words, each labelled with its occurrence, as ``BAG`` longs.

    A bit that one text has and another lacks stands for a word that the other
    lacks, so the number of such bits is a lower bound of the edit distance.
    """
    at = (labelled_kmers(words, 1) if len(words) else words) % np.uint64(64 * BAG)
    out = np.zeros(BAG, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def bags(texts: DataFrame) -> DataFrame:
    """``node, bag`` of texts."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            raw = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for a, b in _chunks(raw, CHUNK):
                hashes, bounds = word_hashes(raw[a:b], powers)
                made = [bag_bits(hashes[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.list_(pa.int64()))], names=["node", "bag"])

    return texts.select("node", "text").mapInArrow(run, "node long, bag array<long>")


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of one that the other lacks."""
    both = np.concatenate([a, b])
    if not len(both):
        return 0
    sign = np.ones(len(both), np.int64)
    sign[len(a) :] = -1
    order = np.argsort(both)
    both = both[order]
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    more = np.add.reduceat(sign[order], starts)
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], t: int) -> list[int]:
    """Edit distances of pairs aligned in a band of ``t`` diagonals to either side.

    A distance of at most ``t`` is exact; a larger number only says "above t".
    """
    p, width = len(pairs), 2 * t + 1
    rows = [len(a) for a, _ in pairs]
    most = max(rows)
    left = np.zeros((p, most), np.uint64)
    right = np.zeros((p, most + width), np.uint64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        end = min(len(b), most + width - t)
        right[i, t : t + end] = b[:end]
    limits = np.array([len(b) for _, b in pairs])[:, None]
    steps = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 20)
    row = np.where(steps >= t, steps - t, far)[None, :].repeat(p, axis=0).astype(np.int32)
    row[steps[None, :] - t > limits] = far
    out = [far] * p
    done: dict[int, list[int]] = {}
    for i, n in enumerate(rows):
        done.setdefault(n, []).append(i)
    down = np.full((p, width), far, np.int32)
    for r in range(most + 1):
        if r:
            down[:, :-1] = row[:, 1:] + 1
            row = np.minimum(row + (left[:, r - 1 : r] != right[:, r - 1 : r - 1 + width]), down)
            if r <= t:  # column 0 is the border, what lies left of it does not exist
                row[:, : t - r] = far
                row[:, t - r] = r
            row = np.minimum.accumulate(row - steps, axis=1) + steps
        for i in done.get(r, ()):
            j = len(pairs[i][1]) - r + t
            if 0 <= j < width:
                out[i] = int(row[i, j])
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], part: int = PART) -> np.ndarray:
    """Whether the edit similarity of each pair is at least ``1 - 1/part``."""
    verdict = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b) in enumerate(pairs):
        most = max(len(a), len(b)) // part
        if abs(len(a) - len(b)) > most or bag_distance(a, b) > most:
            continue
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        at = int(differ[0]) if len(differ) else n
        a, b, n = a[at:], b[at:], n - at
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        back = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - back], b[: len(b) - back]
        if min(len(a), len(b)) == 0:
            verdict[i] = max(len(a), len(b)) <= most
        else:
            todo.append((i, a, b, most))
    t = 8
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        again, k = [], 0
        while k < len(todo):
            width, end, longest = 2 * t + 1, k, 0
            while end < len(todo):
                # texts are padded to the longest of those aligned together
                longest = max(longest, len(todo[end][1]), len(todo[end][2]))
                if end > k and (end + 1 - k) * max(width * PADDED // BAND, longest + width) > PADDED:
                    break
                end += 1
            for (i, a, b, most), d in zip(todo[k:end], banded([(a, b) for _, a, b, _ in todo[k:end]], t), strict=True):
                if d <= t or t >= most:
                    verdict[i] = d <= min(t, most) if t < most else d <= most
                else:
                    again.append((i, a, b, most))
            k = end
        todo, t = again, t * 4
    return verdict


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, linked`` for ``pairs(a, b)`` of nodes with ``texts(node, text)``."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches):
        powers = Powers()
        for batch in batches:
            left = [t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            right = [t.encode("utf-8", "replace") for t in batch.column(3).to_pylist()]
            for a, b in _chunks([x + y for x, y in zip(left, right, strict=True)], CHUNK):
                ha, ba = word_hashes(left[a:b], powers)
                hb, bb = word_hashes(right[a:b], powers)
                found = similar([(ha[ba[i] : ba[i + 1]], hb[bb[i] : bb[i + 1]]) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found)], names=["a", "b", "linked"]
                )

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _classed(docs: DataFrame, id_col: str, text_col: str, n: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """Per row: ``id, r1, r2, class_id, keep, n_texts``; ``keep`` has the marks of the row that stays of its class."""
    rows = stage(sketches(docs, id_col, text_col, n, pick), "near-sketches")
    nodes = rows.groupBy("w1", "w2").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")).alias("first"), F.first("n_words").alias("n_words"), F.first("marks").alias("marks")
    )
    # numbers of their own: other joins need one column, and two texts can't share one
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", "n_words", F.posexplode("marks").alias("i", "key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1")
    shared = stage(buckets.join(leaders, "key"), "near-buckets")
    heads = shared.where("node = leader").select("key", F.col("n_words").alias("lead_n_words"))
    members = shared.join(heads, "key")
    named = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first.r1", "first.r2")
    texts = docs.select(*row_marks(id_col, text_col), F.coalesce(text_col, F.lit("")).alias("text")).join(named, ["r1", "r2"])
    texts = stage(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")

    def fits(p: str, q: str):
        x, y = f"{p}n_words", f"{q}n_words"
        return F.least(x, y) * PART >= F.greatest(x, y) * (PART - 1)

    def lacks(x: str, y: str):
        differ = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(differ, F.lit(0), lambda acc, d: acc + d)

    def tight(p: str, q: str):
        far = F.floor(F.greatest(f"{p}n_words", f"{q}n_words") / PART)
        # a pair comes up once: in the first bucket it shares
        first_shared = F.array_position(F.zip_with(f"{p}marks", f"{q}marks", lambda x, y: x == y), True) - 1 == F.col("i")
        return first_shared & (lacks(f"{p}bag", f"{q}bag") <= far) & (lacks(f"{q}bag", f"{p}bag") <= far)

    def more(some: DataFrame) -> DataFrame:
        return bags(texts.join(some, "node", "left_semi")).join(nodes.select("node", "marks"), "node")

    roots = settle(members, ["n_words"], fits, lambda pairs: verify(pairs, texts), more, tight)
    unstage(shared, texts)
    of_node = stage(nodes.select("node", "w1", "w2", "first").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    of_root = of_node.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("n_texts"))
    of_node = of_node.join(of_root, "root").select("w1", "w2", F.col("keep.id").alias("class_id"), "keep", "n_texts")
    return rows.select("id", "r1", "r2", "w1", "w2").join(of_node, ["w1", "w2"]).drop("w1", "w2")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """Per row of ``docs``: ``id_col, class_id, n_texts``.

    ``class_id`` is the smallest id of the row's class, ``n_texts`` the number of
    different texts in it.
    """
    return _classed(docs, id_col, text_col, n, pick).select(F.col("id").alias(id_col), "class_id", "n_texts")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    found = _classed(docs, id_col, text_col)
    own = (F.col("r1") == F.col("keep.r1")) & (F.col("r2") == F.col("keep.r2"))
    # rows to take out, and of those that stay the ones that are there several times
    marked = found.groupBy("r1", "r2").agg(F.max(own).alias("stays"), F.count("*").alias("n"))
    marked = stage(marked.where("not stays or n > 1"), "near-drop")
    rows = docs.select(F.struct("*").alias("_row"), *row_marks(id_col, text_col))
    out = rows.join(marked, ["r1", "r2"], "left_anti").select("_row")
    again = marked.where("stays")
    if not again.isEmpty():
        one = rows.join(again.select("r1", "r2"), ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("_row").alias("_row"))
        out = out.unionByName(one.select("_row"))
    return out.select("_row.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
