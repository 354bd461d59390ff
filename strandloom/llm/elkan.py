"""Vector codes by Elkan's form of Lloyd's iteration, in integers.

Components become integers, and vectors are cut into equal parts.  Each part
position has a codebook of entries; rounds assign every part to the nearest entry
and move each entry to the mean of its parts, rounded down.

Between rounds a row keeps, for each part, an upper bound of the distance to its
entry and one lower bound for each entry.  When entries move, the bounds are
shifted by how far.  An entry is passed over if its lower bound, or half its
distance from the part's own entry, is strictly above the upper bound, so a tie
is never passed over; what is left is compared by exact integer distances, ties
to the lower index.  Bounds are rounded outwards, so pruning can't change a code.

Rows with their bounds are written to the shared folder after each round.  Only
codebooks and sums by part and entry, whose number does not depend on the rows,
go to the driver and back.

Defined results: rows whose vector is null, or holds a null, a NaN or an
infinity, are dropped.  The vector with the smallest id (null ids last, then by
components) sets the length; rows of another length keep null codes and errors
and bear on nothing.  Ids may repeat.  With fewer vectors than entries, there
are as many entries as vectors.  An empty table gives no rows; other columns
are ignored.  Components beyond ``LARGEST`` after scaling are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stage, table, unstage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Squares of differences of such numbers, summed over a part, fit 64 bits.
LARGEST = 1 << 26
#: Rows worked on together; their bounds take some megabytes.
BLOCK = 1024


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, v``: rows with a vector of finite components, as integers."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.when(F.abs(x) * SCALE > LARGEST, F.raise_error(F.lit("component too large")).cast("long")).otherwise(F.floor(x.cast("double") * SCALE))
    rows = vectors.where(v.isNotNull()).where(~F.exists(v, bad))
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, whole).alias("v"))


def _integers(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right length, one below another, and which rows they are."""
    sizes = np.diff(column.offsets.to_numpy())
    right = np.flatnonzero(sizes == dim)
    flat = column.values.to_numpy(zero_copy_only=False)
    return flat[column.offsets.to_numpy()[right][:, None] + np.arange(dim)], right


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows from entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def below(d: np.ndarray) -> np.ndarray:
    """The upper halves of 32-bit floats that are not above ``d``; what is cut off rounds down."""
    return (np.nextafter(d.astype(np.float32), np.float32(0)).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def from_halves(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint32) << np.uint32(16)).view(np.float32)


def above(d: np.ndarray) -> np.ndarray:
    """32-bit floats that are not below ``d``."""
    return np.nextafter(d.astype(np.float32), np.float32(np.inf))


def first_assign(x: np.ndarray, entries: np.ndarray):
    """Codes, upper and lower bounds of parts that have none yet."""
    d = squares(x, entries)
    code = d.argmin(axis=1)  # the first of equals
    root = np.sqrt(d.astype(np.float64))
    return code, above(root[np.arange(len(x)), code]), below(root)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Codes and bounds after entries have moved by ``moved`` at most, and how many distances that took."""
    u = above(upper.astype(np.float64) + moved[code])
    low = np.maximum(from_halves(lower).astype(np.float64) - moved[None, :], 0)
    apart = np.sqrt(squares(entries, entries).astype(np.float64)) * (0.5 - 1e-9)
    np.fill_diagonal(apart, np.inf)  # a part's own entry is not up for comparison
    near = apart.min(axis=1)
    open_ = np.flatnonzero(u >= near[code])
    reach = (u[open_, None] >= low[open_]) & (u[open_, None] >= apart[code[open_]])
    some = reach.any(axis=1)
    open_ = open_[some]
    # the bound to the own entry becomes the distance itself, then fewer are within reach
    own = ((x[open_] - entries[code[open_]]) ** 2).sum(axis=1)
    own_root = np.sqrt(own.astype(np.float64))
    u[open_] = above(own_root)
    low[open_, code[open_]] = own_root
    reach = reach[some] & (u[open_, None] >= low[open_]) & (u[open_, None] >= apart[code[open_]])
    r, j = np.nonzero(reach)
    d = ((x[open_[r]] - entries[j]) ** 2).sum(axis=1)
    low[open_[r], j] = np.sqrt(d.astype(np.float64))
    best = own.copy()
    np.minimum.at(best, r, d)
    new = np.where(own == best, code[open_], len(entries))
    tie = d == best[r]
    np.minimum.at(new, r[tie], j[tie])
    code = code.copy()
    code[open_] = new
    u[open_] = above(np.sqrt(best.astype(np.float64)))
    return code, u, below(low), len(open_) + len(r)


def _state(batch, dim: int, parts: int, n_entries: int):
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, parts, dim // parts).astype(np.int64)
    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
    upper = np.frombuffer(b"".join(batch.column("upper").to_pylist()), "<f4").reshape(-1, parts)
    lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<u2").reshape(-1, parts, n_entries)
    return x, code, upper, lower


def _bytes(a: np.ndarray, kind: str) -> pa.Array:
    raw = np.ascontiguousarray(a.astype(kind))
    return pa.array([row.tobytes() for row in raw], pa.binary())


def _start(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The first assignment: ``id, label, x, code, upper, lower, looked``; rows of another length have null state."""
    parts, n_entries, width = books.shape
    dim = parts * width

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, right = _integers(part.column(2), dim)
                x = x.reshape(-1, parts, width)
                found = [first_assign(x[:, p], books[p]) for p in range(parts)]
                back = np.full(part.num_rows, -1)
                back[right] = np.arange(len(right))
                take = pa.array(back, mask=back < 0)
                code, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                cols = [_bytes(a, kind).take(take) for a, kind in ((x, "<i4"), (code, "u1"), (upper, "<f4"), (lower, "<u2"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *cols, pa.array(np.where(back < 0, 0, parts * n_entries), pa.int64())], names=["id", "label", "x", "code", "upper", "lower", "looked"]
                )

    return rows.select("id", "label", "v").mapInArrow(run, _schema(rows))


def _schema(rows: DataFrame) -> str:
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return f"id {kind('id')}, label {kind('label')}, x binary, code binary, upper binary, lower binary, looked long"


def _again(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The next assignment, from the bounds of the last."""
    parts, n_entries, width = books.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                right = np.flatnonzero(np.asarray(part.column("x").is_valid()))
                some = part.take(pa.array(right))
                x, code, upper, lower = _state(some, parts * width, parts, n_entries)
                found = [assign(x[:, p], books[p], moved[p], code[:, p].astype(np.int64), upper[:, p], lower[:, p]) for p in range(parts)]
                back = np.full(part.num_rows, -1)
                back[right] = np.arange(len(right))
                take = pa.array(back, mask=back < 0)
                code, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                cols = [_bytes(a, kind).take(take) for a, kind in ((code, "u1"), (upper, "<f4"), (lower, "<u2"))]
                looked = np.zeros(part.num_rows, np.int64)
                looked[:1] = sum(f[3] for f in found)  # of the block
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "x")), *cols, pa.array(looked)], names=["id", "label", "x", "code", "upper", "lower", "looked"])

    return state.mapInArrow(run, _schema(state))


def _move(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the mean of their parts, rounded down, and bounds of how far each moved."""
    parts, n_entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
        for batch in batches:
            some = batch.filter(batch.column(0).is_valid())
            x = np.frombuffer(b"".join(some.column(0).to_pylist()), "<i4").reshape(-1, parts, width).astype(np.int64)
            code = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=n_entries)
        p, e = np.nonzero(counts)
        cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "s"])

    found = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, s array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[k]) for k in range(width))).alias("s"))
    out = books.copy()
    for r in found.collect():  # at most a row for each entry of a codebook
        out[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    far = np.sqrt(((out - books) ** 2).sum(axis=2).astype(np.float64))
    return out, np.where(far > 0, np.nextafter(far, np.inf), 0)


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error``: two hex digits a part, and the squared distances summed."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            valid = np.asarray(batch.column(2).is_valid())
            some = batch.filter(pa.array(valid))
            x = np.frombuffer(b"".join(some.column(2).to_pylist()), "<i4").reshape(-1, parts, width).astype(np.int64)
            code = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(-1, parts)
            error = np.zeros(batch.num_rows, np.int64)
            error[valid] = ((x - books[np.arange(parts)[None, :], code]) ** 2).sum(axis=(1, 2))
            text = [None if c is None else c.hex() for c in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, mask=~valid)], names=["id", "label", "code", "error"])

    kind = lambda c: state.schema[c].dataType.simpleString()
    return state.select("id", "label", "x", "code").mapInArrow(run, f"id {kind('id')}, label {kind('label')}, code string, error long")


def fit_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """From ``id, label, v``: codes and errors, the final codebooks and how many distances each assignment took."""
    least = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v")
    dim = least.limit(1).select(F.size("v")).first()
    if dim is None:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), []
    dim = dim[0]
    if dim == 0 or dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    first = np.array([r[0] for r in least.where(F.size("v") == dim).limit(entries).collect()], np.int64)
    books = first.reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    state = stage(_start(rows, books), "codes-0")
    looked = []
    for k in range(rounds):
        books, moved = _move(state, books)
        new = stage(_again(state, books, moved), f"codes-{k + 1}")
        unstage(state)
        state = new
        looked.append(state.agg(F.sum("looked")).first()[0])
    return _coded(state, books), books, looked


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of each vector kept."""
    coded, books, _ = fit_codes(kept(vectors, id_col, vector_col, label_col), parts, entries, rounds)
    coded = stage(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # sums combine before the shuffle; a label with many rows is split by the join
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _nearest(k: int) -> str:
    return f"""a{k} AS (SELECT vec_id, part, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS best
  FROM x JOIN c{k} USING (part) GROUP BY vec_id, part)"""


def _moved(k: int) -> str:
    return f"""c{k + 1} AS (SELECT part, entry, coalesce(any_value(s), any_value(c)) AS c FROM c{k} LEFT JOIN
  (SELECT part, entry, list(q ORDER BY pos) AS s FROM (SELECT part, best.e AS entry, pos, floor(sum(v[pos])::DOUBLE / count(*))::BIGINT AS q
    FROM a{k} CROSS JOIN (SELECT unnest(range(1, 1 + width)) AS pos FROM w) GROUP BY ALL) GROUP BY ALL) USING (part, entry) GROUP BY part, entry)"""


OP11_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
w AS (SELECT any_value(len(v)) // {PARTS} AS width FROM v),
x AS (SELECT vec_id, part, v[part * width + 1 : (part + 1) * width] AS v FROM v CROSS JOIN w CROSS JOIN (SELECT unnest(range({PARTS})) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
c0 AS (SELECT part, entry, v AS c FROM x JOIN first USING (vec_id)),
{_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c2),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (vec_id) CROSS JOIN books"""
