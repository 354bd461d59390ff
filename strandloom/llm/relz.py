"""Removal of passages that start in earlier documents, by relative Lempel-Ziv parsing.

A window is ``width`` consecutive words of a document.  Every word covered by a
window whose words also start in a document of smaller id is removed.

Reference blocks are spread over tasks by content.  Each window is filed under
the least hash of its ``gram``-word pieces, so equal windows meet; neighbouring
windows mostly share that piece and travel as one segment.  Keys of one document
alone stop there.  Under every other key the segments, in order of document, are
a reference block: a segment is factored greedily against what smaller ids have
put there, through an index of the block's windows, each factor being the
longest continuation of its seed's earliest occurrence.  Factors of ``width``
words or more are duplicate spans.  Windows across the end of a factor lie in no
factor, so each is looked up by itself: the spans are exact, however the factors
fall.  Then the segment joins the block.

Tasks drop equal segments of larger ids before the shuffle.  The windows of a
key with more than ``hot`` segments are filed singly, under a hash of all their
words, so that a common phrase in ever new surroundings can't fill one task.

Defined results: a null text has no words; texts shorter than ``width`` words
keep them all; a null id counts as smaller than any other; rows that share an id
are one place in the order, so they take nothing from one another; each row
gives a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bytehash import BASE, Powers, mix, word_hashes
from strandloom.llm.common import stage, table, unstage

WIDTH = 13
GRAM = 5
#: Bytes of text hashed together.
CHUNK = 1_000_000
#: Segments of a key above which its windows are filed singly.
HOT = 20_000
#: Bytes of segments a task remembers in order to drop equal ones.
SEEN_BYTES = 32_000_000


def hashed_words(raw: bytes, powers: Powers) -> np.ndarray:
    """Hashes of the words of one text, taken in pieces that end at white space."""
    if len(raw) <= CHUNK:
        return word_hashes([raw], powers)[0]
    out, at = [], 0
    while at < len(raw):
        piece = raw[at : at + CHUNK]
        end = at + max(piece.rfind(c) + 1 for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end == at:  # a word as long as a piece: up to the next white space
            ends = [raw.find(c, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
            end = min((e for e in ends if e >= 0), default=len(raw))
        if at + CHUNK >= len(raw):
            end = len(raw)
        out.append(word_hashes([raw[at:end]], powers)[0])
        at = end
    return np.concatenate(out)


def segments(hashes: np.ndarray, counts: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Of documents' word hashes one after another: document, start, windows, key and whether the key is new to the document."""
    windows = np.maximum(counts - width + 1, 0)
    total = int(windows.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    m = len(hashes) - gram + 1
    value, factor = hashes[:m].copy(), 1
    for j in range(1, gram):
        factor = factor * BASE % (1 << 64)
        value += hashes[j : j + m] * np.uint64(factor)
    value = mix(value)
    least, at, span, wide = value, np.arange(m, dtype=np.int64), 1, width - gram + 1
    while span < wide:
        step = min(span, wide - span)
        ahead = least[step:] < least[:-step]
        at = np.where(ahead, at[step:], at[:-step])
        least = np.where(ahead, least[step:], least[:-step])
        span += step
    own = np.repeat(np.arange(len(counts)), windows)
    place = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    p = (np.cumsum(counts) - counts)[own] + place
    fresh = np.append(True, (at[p[1:]] != at[p[:-1]]) | (own[1:] != own[:-1]))
    starts = np.flatnonzero(fresh)
    own, place, key, n = own[starts], place[starts], least[p[starts]], np.diff(np.append(starts, total))
    order = np.lexsort((key, own))
    new = np.ones(len(order), bool)
    new[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    return own, place, n, key, new


def find_segments(docs: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    """From ``id, text``: ``key, id, start, n, first``: segments of ``n`` windows from word ``start`` on."""

    def run(batches):
        powers = Powers()

        def flush(ids, hashes):
            own, place, n, key, new = segments(np.concatenate(hashes), np.array([len(h) for h in hashes]), width, gram)
            cols = [pa.array(key.view(np.int64)), ids.take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(new)]
            return pa.RecordBatch.from_arrays(cols, names=["key", "id", "start", "n", "first"])

        for batch in batches:
            texts, at, size, held, low = batch.column(1).cast(pa.binary()), 0, 0, [], 0
            while at < len(texts):
                # short texts are hashed together, longer ones on their own
                group = []
                while at < len(texts) and (not group or size < CHUNK):
                    raw = texts[at].as_py() or b""
                    group.append(raw)
                    size += len(raw)
                    at += 1
                if len(group) == 1:
                    held = [hashed_words(group[0], powers)]
                elif any(len(x) > CHUNK for x in group):
                    held = [hashed_words(x, powers) for x in group]
                else:
                    found, bounds = word_hashes(group, powers)
                    held = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield flush(batch.column(0).slice(low, at - low), held)
                size, low = 0, at

    return docs.select("id", "text").mapInArrow(run, f"key long, id {kind}, start int, n int, first boolean")


def _place(i):
    """The place of a row's id in the order; see ``_rows``."""
    return i[:9] if isinstance(i, bytes) else i


class Block:
    """A reference block: the segments of a key so far, and an index of their windows."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.whole: dict[bytes, object] = {}
        self.parts: list[tuple[bytes, list[int]]] = []
        self.index: dict[bytes, tuple] = {}

    def factor(self, data: bytes, offsets: list[int], place) -> list[tuple[int, int]]:
        """Spans of words covered by windows of earlier places; ``data`` is words with a blank after each.

        The parse takes the longest continuation of the earliest occurrence of a seed,
        and passes over a word that starts none.
        """
        width, index, last = self.width, self.index, len(offsets) - 1 - self.width
        spans, i = [], 0
        while i <= last:
            hit = index.get(data[offsets[i] : offsets[i + width]])
            if hit is None or not hit[0] < place:
                i += 1
                continue
            other, at = self.parts[hit[1]]
            j, k = i + width, hit[2] + width
            while j < len(offsets) - 1 and k < len(at) - 1 and data[offsets[j] : offsets[j + 1]] == other[at[k] : at[k + 1]]:
                j, k = j + 1, k + 1
            spans.append((i, j))
            # windows across the factor's end
            for s in range(j - width + 1, min(j - 1, last) + 1):
                hit = index.get(data[offsets[s] : offsets[s + width]])
                if hit is not None and hit[0] < place:
                    spans.append((s, s + width))
            i = j
        return spans

    def take(self, data: bytes, place) -> list[tuple[int, int]]:
        """The segment's duplicate spans; it is part of the block from then on."""
        first = self.whole.get(data)
        if first is not None and first < place:  # one factor
            return [(0, data.count(b" "))]
        offsets = [0]
        for w in data.split():
            offsets.append(offsets[-1] + len(w) + 1)
        spans = self.factor(data, offsets, place)
        if first is None:
            self.whole[data] = place
            for s in range(len(offsets) - self.width):
                self.index.setdefault(data[offsets[s] : offsets[s + self.width]], (place, len(self.parts), s))
            self.parts.append((data, offsets))
        return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _cut(joined: DataFrame, kind: str, width: int) -> DataFrame:
    """From ``id, text, runs``: segments ``key, id, starts, words``, one row for all places where a document has one.

    Rows without words are spans of ``n`` that are known to repeat.
    """

    def run(batches):
        seen: dict[tuple, object] = {}
        held = 0
        for batch in batches:
            ids = batch.schema.field(0).type
            out: list[list] = [[], [], [], [], []]

            def row(*values, out=out):
                for column, v in zip(out, values, strict=True):
                    column.append(v)

            texts, runs = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            bounds, fields = runs.offsets.to_pylist(), [runs.values.field(c).to_pylist() for c in ("key", "start", "n", "hot")]
            for r, (i, raw) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                words = raw.split()
                data = b" ".join(words) + b" "
                offsets = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()
                known, mine, own = [], _place(i), {}
                for key, start, n, hot in zip(*(f[bounds[r] : bounds[r + 1]] for f in fields), strict=True):
                    if hot:
                        single = [(s, data[offsets[s] : offsets[s + width]]) for s in range(start, start + n)]
                        parts = [(int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True), s, b) for s, b in single]
                        long = width
                    else:
                        long = n + width - 1
                        parts = ((key, start, data[offsets[start] : offsets[start + long]]),)
                    for part in parts:
                        k, s, b = part
                        first = seen.get((k, b))
                        if first is not None and first < mine:
                            known.append((s, s + long))
                            continue
                        if first is None:
                            if held > SEEN_BYTES:
                                seen.clear()
                                held = 0
                            seen[k, b] = mine
                            held += len(b) + 200
                        own.setdefault((k, b), []).append(s)
                for (key, b), starts in own.items():
                    row(key, i, starts, 0, b)
                for low, high in _merged(known):
                    row(0, i, [low], high - low, None)
                if len(out[0]) >= 20_000:
                    yield _batch(out, ids)
                    for c in out:
                        c.clear()
            if out[0]:
                yield _batch(out, ids)

    return joined.mapInArrow(run, f"key long, id {kind}, starts array<int>, n int, words binary")


def _batch(out: list[list], ids: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), ids, pa.list_(pa.int32()), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "id", "starts", "n", "words"])


def _parse(met: DataFrame, kind: str, width: int) -> DataFrame:
    """Duplicate spans ``id, low, high``; the rows of a key come together, in order of id."""

    def run(batches):
        block, key = Block(width), None
        for batch in batches:
            out: list[list] = [[], [], []]
            places = batch.column(2)
            bounds, flat = places.offsets.to_pylist(), places.values.to_pylist()
            for r, (k, i, n, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "id", "n", "words")), strict=True)):
                starts = flat[bounds[r] : bounds[r + 1]]
                if words is None:
                    found = [(0, n)]
                else:
                    if k != key:
                        block, key = Block(width), k
                    found = block.take(words, _place(i))
                for low, high in _merged(found):
                    for start in starts:
                        for column, v in zip(out, (i, start + low, start + high), strict=True):
                            column.append(v)
            kinds = (batch.schema.field(1).type, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["id", "low", "high"])

    return met.mapInArrow(run, f"id {kind}, low int, high int")


def _apply(docs: DataFrame, kind: str) -> DataFrame:
    """From ``id, text, spans``: ``id, n_words, n_removed, kept, spans``, the spans merged."""

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                words = (t.as_py() or "").encode().split()
                merged = _merged([(x["low"], x["high"]) for x in s.as_py() or ()])
                at, keep = 0, []
                for low, high in merged:
                    keep += words[at:low]
                    at = high
                keep += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                kept.append(b" ".join(keep).decode())
                spans.append([{"low": a, "high": b} for a, b in merged])
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept", "spans"])

    return docs.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<low: int, high: int>>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``id, text``, one id a row.

    Where ids are null or repeat, ``id`` becomes 17 bytes: those of the id, which
    are its place in the order, and those of a row's number; ``own`` is the id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        return rows, False
    # the sign is turned, so that bytes sort as numbers do; null is least
    turned = F.unhex(F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    order = F.when(F.col("id").isNull(), F.lit(bytes(9))).otherwise(F.concat(F.lit(bytes([1])), turned))
    number = F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return stage(rows.select(F.concat(order, number).alias("id"), F.col("id").alias("own"), "text"), "relz-rows"), True


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: ``id_col, n_words, n_removed, kept`` (words joined by blanks) and ``spans``, the removed runs of words."""
    rows, odd = _rows(docs, id_col, text_col)
    texts, kind = rows.select("id", "text"), rows.schema["id"].dataType.simpleString()
    found = stage(find_segments(texts, kind, width, gram), "relz-found")
    # counts combine before the shuffle, and the join with them can be split: no task gathers a common key
    counts = found.groupBy("key").agg(F.count("*").alias("c"), F.count_if("first").alias("docs")).where("docs > 1").select("key", "c")
    counts = stage(counts, "relz-counts", free=True)
    runs = found.join(counts, "key").select("id", F.struct("start", "n", "key", (F.col("c") > hot).alias("hot")).alias("run"))
    runs = stage(runs, "relz-runs", free=True)
    unstage(found)
    unstage(counts)
    runs = runs.groupBy("id").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    cut = _cut(texts.join(runs, "id").select("id", "text", "runs"), kind, width)
    # what is known to repeat need not meet others of its key
    where = F.when(F.col("words").isNull(), F.xxhash64("id", "starts")).otherwise(F.col("key"))
    met = cut.repartition(where).sortWithinPartitions("key", "id")
    # written, so that the shuffles before are gone when the texts are dealt again
    spans = stage(_parse(met, kind, width), "relz-spans", free=True).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    out = _apply(texts.join(spans, "id", "left").select("id", "text", "spans"), kind)
    if odd:
        out = out.join(rows.select("id", "own"), "id").select(F.col("own").alias("id"), "n_words", "n_removed", "kept", "spans")
    return out.withColumnRenamed("id", id_col)


def op13_passages(spark, sf_dir: str) -> DataFrame:
    out = remove_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_NEXT = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WIDTH))
OP13_SQL = rf"""WITH words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (SELECT doc_id, pos, CASE WHEN pos + {WIDTH} <= n THEN concat_ws(' ', word, {_NEXT}) END AS w, word, n FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows WHERE w IS NOT NULL GROUP BY w),
marked AS (SELECT doc_id, pos, word, coalesce(bool_or(least < doc_id) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM windows LEFT JOIN firsts USING (w)),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN sums USING (doc_id)"""
