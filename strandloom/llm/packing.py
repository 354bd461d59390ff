"""Packing documents into sequences by bounded-space online best-fit.

Tokens come from a public byte-level BPE.  A document's ids, then id 0, are cut
into pieces of at most ``max_tokens``; only the first piece may be shorter.
Pieces arrive in the order of a hash.  A task keeps at most ``open_bins`` open
sequences in a bitset keyed by free space; a piece goes to the open sequence
with the least free space that holds it.  If none does, a new one opens, and
the fullest closes first if the limit is reached.

Tasks hold a fixed number of pieces.  What is still open when a task ends is
packed again, each open sequence as one item, so many tasks cost few sequences.
The order within a task is total, so a task that is run again gives the same.

Defined results: a null or empty text is id 0 alone; null ids are kept; repeated
rows are packed each; an empty table gives no rows; columns other than those
named are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stage, table

MAX_TOKENS = 2048
OPEN_BINS = 512
#: Pieces, or open sequences of the first round, in a task.
TASK_ITEMS = 50_000
#: Characters tokenised together.
CHUNK = 2_000_000
CACHE = 300_000


class ByteBpe:
    """Ids of the ``tokenizers`` file, with its parts looked up in a cache.

    Text of printable ASCII and Latin letters, blanks and line feeds is cut
    before blanks and at line feeds, where the pre-tokeniser cuts too, and each
    distinct part is encoded once with the same vocabulary as ranks.  Any other
    text goes to ``tokenizers`` as it is.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\n\x20-\x7e¡-ɏ]|<\\|endoftext\\|>")
        self.runs = re.compile(r"[ \n]{3}|[ \n]{2}\Z")
        self.part = re.compile(r" ?[^ \n]+|[ \n]")
        self.line = self.fast.encode_ordinary("\n")
        self.cache: dict[str, bytes] = {}
        self._seed()

    def _seed(self) -> None:
        self.cache.clear()
        for s in (" ", "\n"):
            self.cache[s] = np.array(self.fast.encode_ordinary(s), "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        ids = np.array(self.fast.encode_ordinary("\n".join(parts)), "<u4")
        ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
        if len(ends) != len(parts):
            raise AssertionError("a part holds a line feed")
        raw, at = ids.tobytes(), 0
        for s, end in zip(parts, ends.tolist(), strict=True):
            self.cache[s] = raw[4 * at : 4 * end]
            at = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = [None] * len(texts)
        parts = []
        for i, t in enumerate(texts):
            if self.other.search(t):
                out[i] = np.array(self.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            elif self.runs.search(t):
                out[i] = np.array(self.fast.encode_ordinary(t), "<u4").tobytes()
            else:
                parts.append((i, self.part.findall(t)))
        new = set()
        for _, p in parts:
            new.update(p)
        new.difference_update(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self._seed()
            new = set().union(*(p for _, p in parts)).difference(self.cache)
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        for i, p in parts:
            out[i] = b"".join(map(get, p))
        return out


def chunks(texts: list, limit: int) -> Iterator[slice]:
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of every document: ``id_col, piece, start, ids`` (little-endian unsigned 32-bit)."""
    import public_tokenizers as P

    json_path, ranks_path, pattern = P.path(f"{tokenizer}.json"), P.path(f"{tokenizer}.tiktoken"), P.PATTERN
    wide = 4 * max_tokens

    def run(batches):
        bpe = ByteBpe(json_path, ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks(texts, CHUNK):
                row, piece, start, ids = [], [], [], []
                for i, raw in enumerate(bpe.encode(texts[part]), part.start):
                    raw += b"\0\0\0\0"
                    at, k = 0, 0
                    end = len(raw) % wide or min(wide, len(raw))
                    while at < len(raw):
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(raw[at:end])
                        at, end, k = end, end + wide, k + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, ids binary").withColumnRenamed("id", id_col)


def best_fit(lengths, capacity: int, open_bins: int):
    """Bin and offset of each length, in the order given, and the bins still open."""
    free_bits, at_free, n_open, bins = 0, {}, 0, 0
    used: list[int] = []
    out_bin, out_offset = [], []
    for n in lengths:
        fits = free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            same = at_free[free]
            b = same.pop()
            if not same:
                free_bits ^= 1 << free
        else:
            if n_open >= open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                same = at_free[fullest]
                same.pop()
                n_open -= 1
                if not same:
                    free_bits ^= 1 << fullest
            b, free = bins, capacity
            bins += 1
            n_open += 1
            used.append(0)
        out_bin.append(b)
        out_offset.append(used[b])
        used[b] += n
        left = free - n
        if left:
            at_free.setdefault(left, []).append(b)
            free_bits |= 1 << left
        else:
            n_open -= 1
    still = [b for free, same in at_free.items() if free_bits >> free & 1 for b in same]
    return out_bin, out_offset, still


def _packed(items: DataFrame, keys: list[str], capacity: int, open_bins: int, task_items: int) -> DataFrame:
    """Adds ``bin, at, still``: the bin, the place in it, whether it is open at its task's end."""
    n = max(1, -(-items.count() // task_items))

    def run(frames):
        frame = pd.concat(list(frames), ignore_index=True)
        if not len(frame):
            return
        b, at, still = best_fit(frame["length"].tolist(), capacity, open_bins)
        b = np.array(b, dtype="int64")
        is_open = np.zeros(int(b.max()) + 1, dtype=bool)
        is_open[still] = True
        yield frame.assign(bin=b + (TaskContext.get().partitionId() << 40), at=np.array(at, dtype="int64"), still=is_open[b])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    order = F.xxhash64(*keys)
    return items.repartition(n, order).sortWithinPartitions(order, *items.columns).mapInPandas(run, f"{schema}, bin long, at long, still boolean")


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, task_items: int = TASK_ITEMS) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces``, whose ``length`` is at most ``max_tokens``.

    Pieces get numbers of their own and are dealt by those, so that null or
    repeated ids can't fill one task.
    """
    pieces = stage(pieces.withColumn("_n", F.monotonically_increasing_id()), "pack-pieces")
    first = stage(_packed(pieces, ["_n"], max_tokens, open_bins, task_items), "pack-first")
    rest = first.where("still").groupBy("bin").agg(F.max(F.col("at") + F.col("length")).alias("length"))
    again = stage(rest, "pack-rest")
    again = stage(_packed(again.withColumnRenamed("bin", "old"), ["old"], max_tokens, open_bins, task_items), "pack-again")
    moved = again.select(F.col("old").alias("bin"), F.col("bin").alias("new"), F.col("at").alias("base"))
    return first.join(moved, "bin", "left").select(
        *(c for c in pieces.columns if c != "_n"),
        # the second round's sequences get numbers above all of the first
        F.coalesce(F.col("new") + F.lit(1 << 62), F.col("bin")).alias("sequence_id"),
        (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = tokenize(docs, id_col, text_col, max_tokens).select(
        id_col,
        "piece",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return pack_pieces(pieces, max_tokens)


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
