"""Media columns: MPEG transport streams.

``to_stream`` stores bytes as a transport stream: a program association table,
a program map table, and one elementary stream of packetised units, each with a
presentation timestamp and a random-access point with a clock reference.
``read_stream`` parses any stream of that kind again: it follows the tables,
whose sections may go over several packets, checks their checksums and all
continuity counters, leaves out packets sent twice, reassembles the elementary
packets and lists timestamps, clock references and random-access points, those
that a unit begins at with its time.

Defined results: null media give null columns; a null text is an empty payload;
damaged streams raise no error but are counted in ``errors``; repeated rows give
equal values; an empty table gives no rows; other columns are ignored.  A value
is handled in memory by itself; batches are cut by bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import table

PACKET = 188
BODY = PACKET - 4
SYNC = 0x47
PMT_PID = 0x1000
ES_PID = 0x100
#: Private data in packetised elementary streams.
STREAM_TYPE = 0x06
STREAM_ID = 0xBD
PROGRAM = 1
#: Payload bytes of a unit, and ticks of the 90 kHz clock from one to the next.
UNIT = 12_288
TICKS = 3600
#: Bytes of values in an Arrow batch.
BATCH_BYTES = 8_000_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))
)


def _timestamp(pts: int) -> bytes:
    return bytes(
        (0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE))
    )


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts = k * TICKS & 0x1FFFFFFFF
        unit = payload[at : at + UNIT]
        data = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(unit) + 8, 0x80, 0x80, 5) + _timestamp(pts) + unit
        clock = struct.pack(">Q", (pts << 15) | (0x3F << 9))[2:]
        i, first = 0, True
        while i < len(data):
            field = b"\x50" + clock if first else b""
            room = BODY - (1 + len(field) if field else 0)
            left = len(data) - i
            if left < room:  # the last packet is filled up in the adaptation field
                gap = room - left
                if field:
                    field += b"\xff" * gap
                else:
                    field = b"\0" + b"\xff" * (gap - 2) if gap > 1 else b""
                    room = left
                    field = bytes((len(field),)) + field
                    out.append(struct.pack(">BHB", SYNC, ES_PID, 0x30 | counter) + field + data[i:])
                    counter = counter + 1 & 15
                    break
                room = left
            out.append(
                struct.pack(">BHB", SYNC, (0x4000 if first else 0) | ES_PID, (0x30 if field else 0x10) | counter)
                + (bytes((len(field),)) + field if field else b"")
                + data[i : i + room]
            )
            counter = counter + 1 & 15
            i, first = i + room, False
    return b"".join(out)


def _bodies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one stream's packets: those that carry a body, where it begins, where the count breaks, and errors.

    A packet may be sent twice, with the same counter and body; the copy is left
    out.  A break of the count is an error, unless the packet announces it.
    """
    flags, field = rows[:, 3], (rows[:, 3] & 0x20) > 0
    size = 4 + np.where(field, 1 + rows[:, 4].astype(np.int32), 0)
    carries = np.flatnonzero((flags & 0x10) > 0)
    size, counters = size[carries], (flags & 15).astype(np.int32)[carries]
    if not len(carries):
        return carries, size, np.zeros(0, bool), 0
    body = np.where(np.arange(PACKET) >= size[:, None], rows[carries], 0)
    step = np.append(1, (counters[1:] - counters[:-1]) % 16)
    same = np.append(False, (size[1:] == size[:-1]) & (body[1:] == body[:-1]).all(axis=1)) & (step == 0)
    # one copy is allowed, a copy of a copy is not
    errors = int((same[1:] & same[:-1]).sum())
    announced = field[carries] & (size > 5) & ((rows[carries, 5] & 0x80) > 0)
    broken = ~same & (step != 1) & ~announced
    keep = ~same
    return carries[keep], size[keep], broken[keep], errors + int(broken.sum())


def _sections(rows: np.ndarray) -> tuple[list[bytes], int]:
    """The sections of a table's packets, without their checksums, and errors; a section may go over several packets."""
    own, at, broken, errors = _bodies(rows)
    found, held, is_open = [], b"", False

    def take() -> None:
        nonlocal held, is_open, errors
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                return
            if crc32_mpeg(held[:size]):
                errors += 1
            else:
                found.append(held[: size - 4])
            held = held[size:]
        if held[:1] == b"\xff" or not held:  # what follows the last section is filled up
            held, is_open = b"", False

    for i, a, gap in zip(own.tolist(), at.tolist(), broken.tolist(), strict=True):
        body = rows[i, a:].tobytes()
        if gap:
            held, is_open = b"", False
        if rows[i, 1] & 0x40:
            pointer = body[0] if body else 0
            if pointer >= max(len(body), 1):
                errors, held, is_open = errors + 1, b"", False
                continue
            if is_open:
                held += body[1 : 1 + pointer]
                take()
                errors += bool(held)
            held, is_open = body[1 + pointer :], True
        elif is_open:
            held += body
        else:  # in the middle of a section whose start is not there
            errors += 1
            continue
        take()
    return found, errors + bool(held)


def _pts(unit: bytes) -> int | None:
    if not unit[7] & 0x80 or len(unit) < 14:
        return None
    p = unit[9:14]
    return (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1


def demux(media: bytes) -> dict:
    """Payload, timestamps, random-access points, clock references and errors of a stream.

    ``random_access`` holds the packet numbers whose adaptation field marks one,
    ``points`` those that a unit begins at, with its timestamp.  Bytes before the
    first unit, as in a stream cut off at its start, are an error and ``lost``.
    """
    errors = int(len(media) % PACKET > 0)
    rows = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    # a receiver may mark a packet as damaged
    good = (rows[:, 0] == SYNC) & ((rows[:, 1] & 0x80) == 0)
    errors += int((~good).sum())
    head = rows[:, 1:4].astype(np.int32)
    pids = (head[:, 0] & 0x1F) << 8 | head[:, 1]
    programs, streams = {}, {}
    sections, wrong = _sections(rows[good & (pids == 0)])
    errors += wrong
    for section in sections:
        for j in range(8, len(section) - 3, 4):
            number, pid = struct.unpack_from(">HH", section, j)
            if number and section[0] == 0:
                programs[number] = pid & 0x1FFF
    for pid in sorted(set(programs.values())):
        sections, wrong = _sections(rows[good & (pids == pid)])
        errors += wrong
        for section in sections:
            if section[0] != 2 or len(section) < 12:
                continue
            j = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while j + 5 <= len(section):
                kind, es, info = struct.unpack_from(">BHH", section, j)
                streams[es & 0x1FFF] = kind
                j += 5 + (info & 0x0FFF)
    payload, stamps, access, points, clocks, units, lost = [], [], [], [], [], 0, 0
    for pid in sorted(streams):
        own = np.flatnonzero(good & (pids == pid))
        adaptation = ((head[own, 2] & 0x20) > 0) & (rows[own, 4] > 0)
        marked = own[adaptation & ((rows[own, 5] & 0x40) > 0)]
        access += marked.tolist()
        for i in own[adaptation & ((rows[own, 5] & 0x10) > 0) & (rows[own, 4] > 6)].tolist():
            clock = int.from_bytes(rows[i, 6:12].tobytes())
            clocks.append((clock >> 15) * 300 + (clock & 0x1FF))
        kept, size, _, wrong = _bodies(rows[own])
        errors += wrong
        own = own[kept]
        body = rows[own]
        stream = body[np.arange(PACKET) >= size[:, None]].tobytes()
        ends = np.cumsum(np.maximum(PACKET - size, 0))
        begins = (head[own, 0] & 0x40) > 0
        starts = (ends - np.maximum(PACKET - size, 0))[begins].tolist() + [len(stream)]
        if starts[0]:
            errors += 1
            lost += starts[0]
        is_marked = set(marked.tolist())
        for i, a, b in zip(own[begins].tolist(), starts[:-1], starts[1:], strict=True):
            unit = stream[a:b]
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                errors += 1
                continue
            units += 1
            declared = unit[4] << 8 | unit[5]
            if declared and declared + 6 != len(unit):
                errors += 1
            pts = _pts(unit)
            if pts is not None:
                stamps.append(pts)
            if i in is_marked:
                points.append({"packet": i, "pts": pts})
            payload.append(unit[9 + unit[8] :])
    return {
        "payload": b"".join(payload),
        "packets": len(rows),
        "units": units,
        "streams": [f"{p}:{k}" for p, k in sorted(streams.items())],
        "timestamps": stamps,
        "random_access": access,
        "points": points,
        "clocks": clocks,
        "lost": lost,
        "errors": errors,
    }


PARTS = pa.struct(
    [
        ("payload", pa.binary()),
        ("packets", pa.int64()),
        ("units", pa.int64()),
        ("streams", pa.list_(pa.string())),
        ("timestamps", pa.list_(pa.int64())),
        ("random_access", pa.list_(pa.int64())),
        ("points", pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))),
        ("clocks", pa.list_(pa.int64())),
        ("lost", pa.int64()),
        ("errors", pa.int64()),
    ]
)
PARTS_SQL = "struct<payload: binary, packets: long, units: long, streams: array<string>, timestamps: array<long>, random_access: array<long>, points: array<struct<packet: long, pts: long>>, clocks: array<long>, lost: long, errors: long>"


def _mapped(df: DataFrame, id_col: str, value_col: str, out: str, kind: pa.DataType, kind_sql: str, step) -> DataFrame:
    id_kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, values, start, made, n = batch.column(0), batch.column(1), 0, [], 0
            for i, v in enumerate(values):
                v = v.as_py()
                made.append(None if v is None else step(v))
                n += len(v or b"")
                if n >= BATCH_BYTES or i == len(values) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(made)), pa.array(made, kind)], names=["id", "value"])
                    start, made, n = i + 1, [], 0

    out_df = df.select(id_col, value_col).mapInArrow(run, f"id {id_kind}, value {kind_sql}")
    return out_df.select(F.col("id").alias(id_col), F.col("value").alias(out))


def to_stream(df: DataFrame, id_col: str, payload_col: str, media_col: str = "media") -> DataFrame:
    """``id_col`` and the payload column as transport streams."""
    return _mapped(df, id_col, payload_col, media_col, pa.binary(), "binary", mux)


def read_stream(df: DataFrame, id_col: str, media_col: str = "media", out: str = "parts") -> DataFrame:
    """``id_col``, the stream's size and digest, and a struct of what it holds."""

    def step(media: bytes) -> dict:
        import hashlib

        return demux(media) | {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}

    kind = pa.struct([*PARTS, ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
    return _mapped(df, id_col, media_col, out, kind, PARTS_SQL[:-1] + ", media_bytes: long, media_sha256: string>", step)


def op5_media(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    pad = F.greatest(F.ceil(size / 192), F.lit(1)).cast("int") * 192 - size
    docs = table(spark, sf_dir, "documents")
    # the id carries the unpadded size through both steps
    rows = docs.select(
        F.struct("doc_id", size.cast("long").alias("n_bytes")).alias("key"),
        F.concat(text, F.repeat(F.lit(" "), pad).cast("binary")).alias("payload"),
    )
    read = read_stream(to_stream(rows, "key", "payload"), "key")
    p = F.col("parts")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("streams="), F.array_join(p["streams"], ",")),
        F.concat(F.lit("packets="), p["packets"]),
        F.concat(F.lit("units="), p["units"]),
        F.concat(F.lit("random_access="), F.size(p["random_access"])),
        F.concat(F.lit("last_pts="), F.coalesce(F.array_max(p["timestamps"]), F.lit(-1))),
        F.concat(F.lit("errors="), p["errors"]),
    )
    return read.select(
        "key.doc_id",
        "key.n_bytes",
        F.octet_length(p["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(p["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(p["payload"], -16, 16)).alias("tail_crc32"),
        p["media_bytes"].alias("media_bytes"),
        p["media_sha256"].alias("media_sha256"),
        feature.alias("feature"),
        p["random_access"].alias("random_access"),
        p["timestamps"].alias("timestamps"),
    )
