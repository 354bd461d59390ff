"""Transport streams as others write them: packets sent twice, cut starts, long tables, announced breaks."""

import random
import struct

from strandloom.llm import media

P = media.PACKET


def packets(stream):
    return [stream[i : i + P] for i in range(0, len(stream), P)]


def some(n=40_000, seed=1):
    raw = random.Random(seed).randbytes(n)
    return raw, packets(media.mux(raw))


def test_packets_sent_twice_count_once():
    raw, found = some()
    twice = media.demux(b"".join(p + p for p in found))
    assert twice["payload"] == raw and twice["errors"] == 0 and twice["units"] == media.demux(b"".join(found))["units"]
    assert media.demux(b"".join(p * 3 if i == 7 else p for i, p in enumerate(found)))["errors"] == 1
    # the same counter with another body is no copy
    other = bytearray(found[9])
    other[100] ^= 1
    got = media.demux(b"".join([*found[:10], bytes(other), *found[10:]]))
    assert got["errors"] > 0


def test_a_copy_may_have_another_clock():
    raw, found = some(5000)
    start = next(i for i, p in enumerate(found) if i > 1 and p[1] & 0x40)
    copy = bytearray(found[start])
    copy[9] ^= 0x55
    got = media.demux(b"".join([*found[: start + 1], bytes(copy), *found[start + 1 :]]))
    assert got["payload"] == raw and got["errors"] == 0 and len(got["clocks"]) == 2


def test_a_cut_start_is_an_error_and_told():
    raw, found = some()
    got = media.demux(b"".join([*found[:2], *found[5:]]))
    assert got["errors"] == 1 and got["lost"] > 0 and got["payload"] == raw[media.UNIT :]
    whole = media.demux(b"".join(found))
    assert whole["lost"] == 0 and whole["errors"] == 0


def spread(pid, section, before=b""):
    """A section over as many packets as it takes, after the end of another one."""
    data, out, k = bytes([len(before)]) + before + section, [], 0
    while data:
        out.append((struct.pack(">BHB", media.SYNC, (0x4000 if k == 0 else 0) | pid, 0x10 | k) + data[: P - 4]).ljust(P, b"\xff"))
        data, k = data[P - 4 :], k + 1
    return out


def test_tables_over_several_packets():
    raw, found = some(3000)
    tag = bytes((0x52, 250)) + bytes(250)
    info = tag * 2
    program = struct.pack(">HH", 0xE000 | media.ES_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", media.STREAM_TYPE, 0xE000 | media.ES_PID, 0xF000)
    table = spread(media.PMT_PID, media._section(2, media.PROGRAM, program))
    assert len(table) == 3
    got = media.demux(b"".join([found[0], *table, *found[2:]]))
    assert got["payload"] == raw and got["errors"] == 0 and got["streams"] == ["256:6"]
    # a packet of the table is missing: no streams, and said
    got = media.demux(b"".join([found[0], table[0], table[2], *found[2:]]))
    assert got["payload"] == b"" and got["errors"] > 0
    # copies of its packets do no harm
    got = media.demux(b"".join([found[0], *(p + p for p in table), *found[2:]]))
    assert got["payload"] == raw and got["errors"] == 0


def test_two_sections_in_a_packet():
    raw, found = some(3000)
    one = media._section(0, 1, struct.pack(">HH", 0, 0xE000 | 0x20))
    two = media._section(0, 1, struct.pack(">HH", media.PROGRAM, 0xE000 | media.PMT_PID))
    got = media.demux(b"".join([*spread(0, one + two), *found[1:]]))
    assert got["payload"] == raw and got["errors"] == 0
    broken = bytearray(spread(0, one + two)[0])
    broken[8] ^= 1
    assert media.demux(b"".join([bytes(broken), *found[1:]]))["errors"] == 1


def test_times_clocks_and_points_align():
    _, found = some(5 * media.UNIT)
    got = media.demux(b"".join(found))
    assert [x["pts"] for x in got["points"]] == got["timestamps"] == [k * media.TICKS for k in range(5)]
    assert [x["packet"] for x in got["points"]] == got["random_access"] and got["clocks"] == [300 * t for t in got["timestamps"]]
    # a unit that is no random-access point keeps its time and is no point
    start = got["random_access"][2]
    plain = bytearray(found[start])
    plain[5] &= ~0x40
    less = media.demux(b"".join([*found[:start], bytes(plain), *found[start + 1 :]]))
    assert len(less["timestamps"]) == 5 and [x["pts"] for x in less["points"]] == [0, 3600, 10800, 14400] and less["errors"] == 0


def test_announced_breaks_and_marked_damage():
    _, found = some(3 * media.UNIT)
    got = media.demux(b"".join(found))
    start = got["random_access"][1]
    jump = bytearray(found[start])
    jump[5] |= 0x80
    cut = [*found[: start - 1], bytes(jump), *found[start + 1 :]]
    # the unit before is short, which is one error; the break itself is none
    assert media.demux(b"".join(cut))["errors"] == 1
    cut[start - 1] = found[start]
    assert media.demux(b"".join(cut))["errors"] == 2
    marked = bytearray(found[5])
    marked[1] |= 0x80
    assert media.demux(b"".join([*found[:5], bytes(marked), *found[6:]]))["errors"] >= 2


def test_junk_is_counted_not_raised():
    draw = random.Random(3)
    for n in (0, 1, 187, 188, 189, 3760):
        media.demux(draw.randbytes(n))
    for _ in range(300):
        _, found = some(2500, draw.randrange(9))
        stream = bytearray(b"".join(found))
        for _ in range(draw.randrange(1, 30)):
            stream[draw.randrange(len(stream))] = draw.randrange(256)
        media.demux(bytes(stream[draw.randrange(300) :]))
