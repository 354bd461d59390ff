"""Removal of repeated byte strings by suffix arrays from two-stage sorting.

Every byte covered by a ``width``-byte string that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

To sort suffixes on many machines, each window of ``width`` bytes is filed under
the hash of its least ``GRAM``-byte piece, so equal windows meet.  Neighbouring
windows mostly share that piece and travel as one segment.  Segments whose key
occurs once can hold no repeat and stop there.  The others meet by key.  Equal
segments are told apart by order alone; the distinct ones of several keys form
one text, whose suffixes are sorted in two stages: those smaller than their
successors directly, the others by a scan over the buckets.  Adjacent common
prefixes then show which windows are equal.

Tasks drop equal segments before the shuffle.  The windows of a key with more
than ``HOT`` segments are filed singly, under the hash of all their bytes, so a
common phrase in ever new surroundings can't fill one task.  Long texts are cut
into overlapping parts while segments are formed, and no task holds more than
one batch.

Defined results: a null text counts as empty; texts shorter than ``width`` keep
all bytes; repeated or null ids are put in order by id (null first), then text,
and every row counts as a document; an empty table gives no rows; other columns
are ignored.  Removal is by byte, so what is kept may cut a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bytehash import BYTE, Powers, mix
from strandloom.llm.common import stage, table, unstage

WIDTH = 100
GRAM = 24
#: Bytes hashed together, and bytes of segments sorted together.
CHUNK = 1_000_000
SORT_BYTES = 2_000_000
#: Segments of a key above which its windows are filed singly.
HOT = 50_000
#: Bytes of segments a task remembers in order to drop equal ones.
SEEN_BYTES = 32_000_000


def segments(raw: np.ndarray, lengths: np.ndarray, powers: Powers, width: int = WIDTH, gram: int = GRAM):
    """Of texts one after another in ``raw``: text number, start, window count and key of each segment."""
    offsets = np.cumsum(lengths) - lengths
    n = len(raw) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    up, down = powers.get(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[: len(raw)], out=sums[1:])
    m = len(raw) - gram + 1
    value = mix((sums[gram:] - sums[:m]) * down[:m])
    least, at, span = value, np.arange(m, dtype=np.int32), 1
    wide = width - gram + 1
    while span < wide:
        step = min(span, wide - span)
        ahead = least[step:] < least[:-step]
        at = np.where(ahead, at[step:], at[:-step])
        least = np.where(ahead, least[step:], least[:-step])
        span += step
    counts = np.maximum(lengths - width + 1, 0)
    own = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(own)) - first[own]
    p = offsets[own] + place
    fresh = np.append(True, (at[p[1:]] != at[p[:-1]]) | (own[1:] != own[:-1])) if len(p) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    size = np.diff(np.append(starts, len(p)))
    return own[starts], place[starts], size, least[p[starts]]


def find_segments(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """``key, id, start, n``: segments of ``n`` windows from byte ``start`` on."""

    def run(batches):
        powers = Powers()

        def flush(parts):
            raw = np.frombuffer(b"".join(b for _, _, b in parts), np.uint8)
            own, place, n, key = segments(raw, np.array([len(b) for _, _, b in parts]), powers, width, gram)
            base = np.array([b for _, b, _ in parts], np.int64)
            ids = pa.array([i for i, _, _ in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), ids.take(pa.array(own)), pa.array(place + base[own]), pa.array(n.astype(np.int32))], names=["key", "id", "start", "n"]
            )

        for batch in batches:
            parts, size = [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                for at in range(0, max(len(raw) - width + 1, 0), CHUNK):
                    part = raw[at : at + CHUNK + width - 1]
                    parts.append((i, at, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"key long, id {kind}, start long, n int")


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # up: smaller than its successor; within a run of one byte that is settled where the run ends
    change = np.append(text[1:] != text[:-1], True)
    at = np.arange(n)
    end = np.minimum.accumulate(np.where(change, at, n)[::-1])[::-1]
    following = np.append(text, 0).astype(np.int16)[end + 1]
    following[end == n - 1] = -1
    up = text < following
    order = _direct(text, np.flatnonzero(up), depth)
    sizes = np.bincount(text, minlength=256)
    own = text[order]
    up_from = np.searchsorted(own, np.arange(257))
    begins = np.cumsum(sizes) - sizes
    out = np.full(n, -1, np.int64)
    filled = begins.copy()

    def place(found: np.ndarray) -> None:
        """Suffixes before the sorted ones ``found`` that are larger than them, into their buckets."""
        before = found[found > 0] - 1
        before = before[~up[before]]
        key = text[before]
        rank = np.argsort(key, kind="stable")
        key, before = key[rank], before[rank]
        for c in np.unique(key):
            part = before[np.searchsorted(key, c) : np.searchsorted(key, c, side="right")]
            out[filled[c] : filled[c] + len(part)] = part
            filled[c] += len(part)

    # the end of the text is smaller than every suffix
    place(np.array([n]))
    for c in np.flatnonzero(sizes):
        done = begins[c]
        while done < filled[c]:  # what a bucket's scan adds to the bucket itself is scanned next
            wave = out[done : filled[c]]
            done = filled[c]
            place(wave)
        smaller = order[up_from[c] : up_from[c + 1]]
        out[done : done + len(smaller)] = smaller
        place(smaller)
    return out


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the text."""
    padded = np.append(text, np.zeros(depth + 16, np.uint8)).astype(np.uint64)
    words = padded.copy()
    for j in (1, 2, 4):
        words = (words[:-j] << np.uint64(8 * j)) | words[j:]
    return words


def _direct(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first bytes, eight at a time, the ties alone each time."""
    words = _words(text, depth)
    group = np.zeros(len(suffixes), np.int64)
    tied = np.arange(len(suffixes))
    out = suffixes.copy()
    for d in range(0, depth if len(tied) else 0, 8):
        value = words[out[tied] + d]
        rank = np.lexsort((value, group[tied]))
        moved, value, own = out[tied][rank], value[rank], group[tied][rank]
        out[tied] = moved
        fresh = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        single = fresh & np.append(fresh[1:], True)
        tied = tied[~single]
        if not len(tied):
            break
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before, at most ``depth``; 0 for the first."""
    words = _words(text, depth)
    out = np.full(len(order), depth, np.int64)
    out[:1] = 0
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        x = words[order[live] + d] ^ words[order[live - 1] + d]
        differ = x != 0
        lead = 7 - (np.log2(x[differ].astype(np.float64)) // 8).astype(np.int64)
        # a float may round up to the next power of two, so the byte is checked
        lead = np.where((x[differ] >> (np.uint64(56) - (lead * 8).astype(np.uint64))) == 0, lead + 1, lead)
        out[live[differ]] = np.minimum(d + lead, depth)
        live = live[~differ]
    # nothing is common beyond the end of the text
    left = len(text) - order
    return np.minimum(out, np.minimum(left, np.append(0, left[:-1])))


def repeated_windows(parts: list[tuple[bytes, int]], width: int = WIDTH) -> list[np.ndarray]:
    """For segments in document order, each with its window count: the windows that occur earlier."""
    text = np.frombuffer(b"\0".join(b for b, _ in parts) + b"\0", np.uint8)
    order = suffix_array(text, width)
    same = common_prefixes(text, order, width) >= width
    windows = np.zeros(len(text), bool)
    starts, at = [], 0
    for b, n in parts:
        starts.append(at)
        windows[at : at + n] = True
        at += len(b) + 1
    group = np.cumsum(~same)
    inside = windows[order]
    order, group = order[inside], group[inside]
    first = np.full(int(group.max()) + 1 if len(group) else 0, len(text))
    np.minimum.at(first, group, order)
    repeated = np.zeros(len(text), bool)
    repeated[order[order != first[group]]] = True
    return [np.flatnonzero(repeated[s : s + n]) for s, (_, n) in zip(starts, parts, strict=True)]


def _spans(start: int, windows: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows, as spans of the document."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > width)
    lows, highs = windows[np.append(0, cut + 1)], windows[np.append(cut, len(windows) - 1)]
    return [(start + int(a), start + int(b) + width) for a, b in zip(lows, highs, strict=True)]


def _cut_segments(joined: DataFrame, kind: str, width: int) -> DataFrame:
    """From ``id, text, runs``: segments with their bytes, and spans already known to repeat.

    A row has ``bytes``, or is a span from ``start`` of ``n`` windows.
    """

    def run(batches):
        powers, seen, held = Powers(), {}, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]

            def add(key, i, start, n, data):
                nonlocal held
                known = seen.get((key, data))
                if known is None:
                    if held > SEEN_BYTES:
                        seen.clear()
                        held = 0
                    seen[key, data] = (i, start)
                    held += len(data) + 150
                if known is not None and known < (i, start):
                    spans.append((start, n))
                else:
                    row(key, i, start, n, data)

            def row(*values):
                for column, v in zip(out, values, strict=True):
                    column.append(v)

            def flush():
                """What is known to repeat of a document, its segments run together again."""
                spans.sort()
                low = high = None
                for start, n in spans:
                    if low is not None and start <= high:
                        high = max(high, start + n)
                        continue
                    if low is not None:
                        row(0, own, low, high - low, None)
                    low, high = start, start + n
                if low is not None:
                    row(0, own, low, high - low, None)
                spans.clear()

            own, spans = None, []

            for i, t, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not runs.is_valid:
                    continue
                flush()
                own = i
                raw = (t.as_py() or "").encode("utf-8", "replace")
                for r in runs.as_py():
                    key, start, n = r["key"], r["start"], r["n"]
                    data = raw[start : start + n + width - 1]
                    if not r["hot"]:
                        add(key, i, start, n, data)
                        continue
                    up, down = powers.get(len(data))
                    sums = np.append(np.uint64(0), np.cumsum(BYTE[np.frombuffer(data, np.uint8)] * up[: len(data)]))
                    keys = mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(1)).view(np.int64)
                    for j, k in enumerate(keys.tolist()):
                        add(k, i, start + j, 1, data[j : j + width])
                if len(out[0]) >= 20_000:
                    yield _batch(out, ids=batch.schema.field(0).type)
                    out = [[], [], [], [], []]
            flush()
            if out[0]:
                yield _batch(out, ids=batch.schema.field(0).type)

    return joined.mapInArrow(run, f"key long, id {kind}, start long, n int, bytes binary")


def _batch(out: list[list], ids: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), ids, pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "id", "start", "n", "bytes"])


def _find_repeats(cut: DataFrame, kind: str, width: int) -> DataFrame:
    """Spans ``id, low, high`` that repeat; the rows of a key come together, in document order."""

    def run(batches):
        ids_kind = None
        out: list[list] = [[], [], []]
        distinct: dict[bytes, tuple] = {}
        pending: list[tuple] = []
        size, key = 0, None

        def close():
            """Distinct segments of a key go to the sorting, if there are several."""
            nonlocal size
            if len(distinct) > 1:
                pending.extend((i, s, n, b) for b, (i, s, n) in distinct.items())
                size += sum(map(len, distinct))
            distinct.clear()

        def sort():
            nonlocal size
            found = repeated_windows([(b, n) for _, _, n, b in pending], width)
            for (i, s, _, _), w in zip(pending, found, strict=True):
                for a, b in _spans(s, w, width):
                    add(i, a, b)
            pending.clear()
            size = 0

        def add(i, low, high):
            for column, v in zip(out, (i, low, high), strict=True):
                column.append(v)

        def batch_out():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], ids_kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["id", "low", "high"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            ids_kind = batch.schema.field(1).type
            for k, i, s, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key = k
                    if size >= SORT_BYTES:
                        sort()
                if b is None or b in distinct:
                    add(i, s, s + n + width - 1)
                else:
                    distinct[b] = (i, s, n)
            if len(out[0]) >= 20_000:
                yield batch_out()
        close()
        if pending:
            sort()
        if out[0]:
            yield batch_out()

    return cut.mapInArrow(run, f"id {kind}, low long, high long")


def _apply(docs: DataFrame, kind: str) -> DataFrame:
    """From ``id, text, spans``: the kept bytes and the maximal removed spans."""

    def run(batches):
        for batch in batches:
            n_bytes, kept, spans = [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                merged: list[list[int]] = []
                for x in sorted(s.as_py() or (), key=lambda x: x["low"]):
                    if merged and x["low"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["high"])
                    else:
                        merged.append([x["low"], x["high"]])
                at, keep = 0, []
                for low, high in merged:
                    keep.append(raw[at:low])
                    at = high
                keep.append(raw[at:])
                n_bytes.append(len(raw))
                kept.append(b"".join(keep))
                spans.append([{"low": a, "high": b} for a, b in merged])
            span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["id", "n_bytes", "kept", "spans"]
            )

    return docs.mapInArrow(run, f"id {kind}, n_bytes long, kept binary, spans array<struct<low: long, high: long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: ``id_col, n_bytes, kept`` (binary) and ``spans``, the maximal removed spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if odd:  # rows get numbers in order of id and text
        rows = stage(rows.orderBy(F.col("id").asc_nulls_first(), "text").select(F.col("id").alias("own"), F.monotonically_increasing_id().alias("id"), "text"), "suffix-rows")
    kind = rows.schema["id"].dataType.simpleString()
    found = find_segments(rows, "id", "text", width, gram)
    found = stage(found, "suffix-found")
    # counts combine before the shuffle, and the join with them can be split: no task gathers a common key
    counts = stage(found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "suffix-counts", free=True)
    again = found.join(counts, "key")
    runs = again.select("id", F.struct("key", "start", "n", (F.col("c") > hot).alias("hot")).alias("run"))
    runs = stage(runs, "suffix-runs", free=True)
    unstage(found)
    unstage(counts)
    runs = runs.groupBy("id").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    texts = rows.select("id", "text")
    cut = _cut_segments(texts.join(runs, "id").select("id", "text", "runs"), kind, width)
    # rows without bytes are known to repeat and need not meet others of their key
    where = F.when(F.col("bytes").isNull(), F.xxhash64("id", "start")).otherwise(F.col("key"))
    met = cut.repartition(where).sortWithinPartitions("key", "id", "start")
    # written, so that the shuffles before are gone when the texts are dealt again
    spans = stage(_find_repeats(met, kind, width), "suffix-spans", free=True).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    out = _apply(texts.join(spans, "id", "left").select("id", "text", "spans"), kind)
    if odd:
        out = out.join(rows.select("id", "own"), "id").select(F.col("own").alias(id_col), "n_bytes", "kept", "spans")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
