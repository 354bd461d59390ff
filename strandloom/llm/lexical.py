"""Ranked lexical search as a blocked sparse matrix product.

The scores are the product of two sparse matrices: items by terms, whose entries
say how often an item counts a term, and terms by documents, whose entries are
64-bit integer impacts.  Items come in blocks of bounded size, documents in
blocks of rows.  For an item, the rows of the second matrix that its terms name
are merged into one row of scores (Gustavson's order), in numpy.  Each block of
documents gives every item its best ``k``, a task the best of its blocks, and
rounds of windows the best of all.

A block of items takes one pass over the texts.  The pass keeps each document's
number of terms and how often it has the block's terms; document counts of terms
are summed from that, so statistics cover all documents, and impacts are made
once they are known.  Terms are found by 64-bit hashes and then compared byte by
byte.

Defined results: a text without terms, null or empty, is no document for the
statistics and is never a result; an item without terms has no results; null
ids come last among equal scores; repeated rows are documents each, and items
with equal ids are ranked each; empty tables give no rows; other columns are
ignored.  Document ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.bytehash import BYTE, Powers, mix
from strandloom.llm.common import stage, table, unstage

TOP = 10
#: Bytes of item texts in a block; items are told apart by number, so a block is one broadcast of that order.
BLOCK_BYTES = 8_000_000
#: Documents scored together.
BLOCK_DOCS = 8192
#: Bytes of text hashed together.
CHUNK = 1_000_000

#: Letters and digits, and every byte of characters beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[128:] = True
for _low, _high in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
    INSIDE[ord(_low) : ord(_high) + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
TERM_BYTE = np.where(INSIDE, BYTE, np.uint64(0))


def find_terms(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each term of lower-cased bytes."""
    inside = INSIDE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = powers.get(len(raw))
    sums = np.add.reduceat(TERM_BYTE[raw] * up[: len(raw)], starts)
    return starts, ends - starts, mix(sums * down[starts])


class Vocabulary:
    """The terms of a block of items: numbers by hash, and their bytes to compare."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = len(terms)
        raw = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
        starts, lengths, hashes = find_terms(raw, Powers())
        order = np.argsort(hashes, kind="stable")
        self.raw, self.number, self.hashes = raw, order, hashes[order]
        self.starts, self.lengths = starts[order], lengths[order]
        if len(np.unique(self.hashes)) != self.size:
            raise ValueError("two terms of a block share a hash")

    def look_up(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms found in ``raw`` are in the vocabulary, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(self.size - 1, 0))
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == lengths)) if self.size else np.zeros(0, np.int64)
        at = at[hit]
        size = lengths[hit]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = raw[np.repeat(starts[hit], size) + within] != self.raw[np.repeat(self.starts[at], size) + within]
        if differ.any():
            wrong = np.unique(np.repeat(np.arange(len(hit)), size)[differ])
            hit, at = np.delete(hit, wrong), np.delete(at, wrong)
        return hit, self.number[at]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces that end where no term is cut."""
    at = 0
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and INSIDE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def count_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """From ``id, text``: ``id, n, terms, times``: the number of terms, and how often which of the vocabulary (32-bit arrays)."""

    def run(batches):
        powers = Powers()

        def counted(texts: list[bytes]):
            """Of texts one after another: all terms of each; pairs of text and term with their counts."""
            raw = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
            ends = np.cumsum([len(t) + 1 for t in texts])
            starts, lengths, hashes = find_terms(raw, powers)
            n = np.diff(np.searchsorted(starts, np.append(0, ends)))
            hit, number = vocabulary.look_up(raw, starts, lengths, hashes)
            own = np.searchsorted(ends, starts[hit], side="right")
            pair, times = np.unique(own * max(vocabulary.size, 1) + number, return_counts=True)
            return n, pair // max(vocabulary.size, 1), pair % max(vocabulary.size, 1), times

        def flush(ids, texts):
            if len(texts) == 1 and len(texts[0]) > CHUNK:
                n, sums = 0, np.zeros(vocabulary.size, np.int64)
                for piece in _pieces(texts[0]):
                    m, _, term, times = counted([piece])
                    n += int(m[0])
                    sums[term] += times
                number = np.flatnonzero(sums)
                n, own, term, times = np.array([n]), np.zeros(len(number), np.int64), number, sums[number]
            else:
                n, own, term, times = counted(texts)
            cuts = np.searchsorted(own, np.arange(len(texts) + 1))
            split = lambda x: pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), split(term), split(times)], names=["id", "n", "terms", "times"])

        for batch in batches:
            column, low, at = batch.column(1).cast(pa.binary()), 0, 0
            while at < len(column):
                texts, size = [], 0
                while at < len(column) and (not texts or size + len(column[at].as_py() or b"") <= CHUNK):
                    texts.append(column[at].as_py() or b"")
                    size += len(texts[-1])
                    at += 1
                yield flush(batch.column(0).slice(low, at - low), texts)
                low = at

    return docs.select("id", "text").mapInArrow(run, "id long, n long, terms binary, times binary")


def document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is: tasks sum their own, then sums are added up."""

    def run(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist()), "<i4")
            sums += np.bincount(found, minlength=size)
        term = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(sums[term])], names=["term", "n"])

    sums = counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out


def merge_rows(items: list[np.ndarray], weights: list[np.ndarray], indptr: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[np.ndarray]:
    """Rows of the product: for each item, the rows of its terms merged into one of ``n_docs`` scores.

    The buffer that a row is merged in is used again for the next.
    """
    scores = np.zeros(n_docs, np.int64)
    for terms, times in zip(items, weights, strict=True):
        scores[:] = 0
        for t, m in zip(terms.tolist(), times.tolist(), strict=True):
            a, b = indptr[t], indptr[t + 1]
            if a < b:  # a term's row names a document once
                scores[doc[a:b]] += m * impact[a:b]
        yield scores


def best_of(score: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: high scores first, then small ids, null ids last."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], ~valid[some], -score[some]))[:k]]


def score_blocks(counted: DataFrame, items: list[np.ndarray], weights: list[np.ndarray], term_weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """``item, id, score``: the best ``k`` of each task, ``item`` a number."""
    size = len(term_weight)

    def run(batches):
        best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_DOCS):
                block = batch.slice(low, BLOCK_DOCS)
                valid = np.asarray(block.column(0).is_valid())
                ids = block.column(0).fill_null(0).to_numpy()
                n = block.column(1).to_numpy()
                lists = block.column(2).to_pylist()
                term = np.frombuffer(b"".join(lists), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(block.column(3).to_pylist()), "<i4").astype(np.int64)
                doc = np.repeat(np.arange(len(n)), [len(x) // 4 for x in lists])
                m = 10 + (90 * n * n_docs) // total if total else n
                impact = term_weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                order = np.argsort(term, kind="stable")
                indptr = np.searchsorted(term[order], np.arange(size + 1))
                doc, impact = doc[order], impact[order]
                for i, scores in enumerate(merge_rows(items, weights, indptr, doc, impact, len(n))):
                    held = best[i]
                    least = held[0][-1] if len(held[0]) == k else 1
                    new = np.flatnonzero(scores >= max(least, 1))
                    if len(new):
                        s, d, v = (np.append(x, y) for x, y in zip(held, (scores[new], ids[new], valid[new]), strict=True))
                        top = best_of(s, d, v, k)
                        best[i] = (s[top], d[top], v[top])
        for i, (s, d, v) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i), pa.int64()), pa.array(d, pa.int64(), mask=~v), pa.array(s, pa.int64())], names=["item", "id", "score"])

    return counted.mapInArrow(run, "item long, id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item with their ranks; two rounds, so that no task has what all tasks found for an item."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    part = rows.withColumn("_part", F.spark_partition_id() % 64)
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items ``(id, text)`` in lists of at most so many bytes, or of one item; the driver holds one list."""
    block, size = [], 0
    for r in items.select(item_col, text_col).toLocalIterator():
        raw = (r[1] or "").encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], raw))
        size += len(raw) + 16
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: ``item_col, rank, id_col, score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    item_kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in _item_blocks(items, item_col, item_text, block_bytes):
        numbers: dict[bytes, int] = {}
        lists = []
        for _, raw in block:
            low = LOWER[np.frombuffer(raw + b"\0", np.uint8)]
            starts, lengths, _ = find_terms(low, Powers())
            data = low.tobytes()
            # an item counts a term once, however often it has it
            lists.append(np.array([numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(data[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True))], np.int64))
        vocabulary = Vocabulary(list(numbers))
        counted = stage(count_terms(rows, vocabulary), "lexical-counted")
        sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = document_counts(counted, vocabulary.size)
        weight = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = score_blocks(counted, lists, [np.ones(len(x), np.int64) for x in lists], weight, sums["docs"], sums["total"], k)
        top = stage(ranked(found, k), "lexical-top")
        unstage(counted)
        # as many rows as the block has items
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, `{item_col}` {item_kind}")
        top = top.join(names, "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = top if out is None else out.unionByName(top)
    if out is None:
        out = spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` long, score long")
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = f"""WITH tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS t FROM documents) GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
sums AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM docs),
df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) CROSS JOIN sums),
items AS (SELECT DISTINCT item_id, {_TERMS} AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM items JOIN tf USING (t) JOIN docs USING (doc_id) JOIN df USING (t) CROSS JOIN sums GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}"""
