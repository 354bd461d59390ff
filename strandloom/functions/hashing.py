"""Structural hashes of nested values, and digests of columns."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = {"md5": "md5", "sha-1": "sha1", "sha-256": "sha256", "sha-384": "sha384", "sha-512": "sha512"}
FORMATS = ("hex", "HEX", "double", "uint8", "base64")
INPUTS = ("array", "file", "bin", "ascii")
CLASSES = {
    np.dtype(k): v
    for k, v in (("f8", "double"), ("f4", "single"), ("i1", "int8"), ("u1", "uint8"), ("i2", "int16"), ("u2", "uint16"),
                 ("i4", "int32"), ("u4", "uint32"), ("i8", "int64"), ("u8", "uint64"), ("?", "logical"))
}


def _head(kind: str, shape: tuple[int, ...]) -> bytes:
    return kind.encode() + struct.pack(f"<{1 + len(shape)}d", len(shape), *shape)


def canonical(value) -> bytes:
    """The bytes that stand for a value: class, number of dimensions, sizes, data.

    Text is a row of 16-bit characters, a dict a struct with its fields in
    order of name, a list a row of cells, numbers are doubles.
    """
    if isinstance(value, str):
        return _head("char", (1 if value else 0, len(value))) + value.encode("utf-16-le")
    if isinstance(value, dict):
        return _head("struct", (1, 1)) + b"".join(k.encode() + canonical(value[k]) for k in sorted(value))
    if isinstance(value, (list, tuple)):
        return _head("cell", (1 if value else 0, len(value))) + b"".join(map(canonical, value))
    x = np.asarray(value)
    if x.dtype not in CLASSES:
        x = x.astype(np.float64)
    if x.ndim < 2:
        x = x.reshape((0, 0) if x.size == 0 else (1, x.size))
    return _head(CLASSES[x.dtype], x.shape) + x.astype(x.dtype.newbyteorder("<")).tobytes(order="F")


def _raw(value) -> bytes:
    if isinstance(value, str):
        return value.encode("utf-16-le")
    x = np.asarray(value)
    if np.iscomplexobj(x):
        return x.real.tobytes(order="F") + x.imag.tobytes(order="F")
    return x.tobytes(order="F")


def datahash(value, method: str = "md5", fmt: str = "hex", kind: str = "array"):
    """Digest of a value, of the bytes of an array or a text, or of a file."""
    if method.lower() not in (*METHODS, "md2"):
        raise ValueError(f"unknown method {method!r}")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if kind == "array":
        data = canonical(value)
    elif kind == "bin":
        data = _raw(value)
    elif kind == "ascii":
        if not isinstance(value, str):
            raise ValueError("ascii input must be text")
        data = value.encode("latin-1")
    elif kind == "file":
        with open(value, "rb") as f:
            if method.lower() == "md2":
                return formatted(md2(f.read()), fmt)
            digest = hashlib.new(METHODS[method.lower()])
            while part := f.read(1_000_000):
                digest.update(part)
        return formatted(digest.digest(), fmt)
    else:
        raise ValueError(f"unknown input {kind!r}")
    return formatted(_digest(data, method), fmt)


def _pi_table() -> list[int]:
    """The permutation of bytes that RFC 1319 draws from the digits of pi."""
    # pi by Machin's formula, in whole numbers
    one = 10**800

    def arctan(x: int) -> int:
        total, term, n = 0, one // x, 1
        while term:
            total += term // n if n % 4 == 1 else -(term // n)
            term //= x * x
            n += 2
        return total

    digits = iter(map(int, str(4 * (4 * arctan(5) - arctan(239)))[:780]))

    def draw(n: int) -> int:
        """A number below n from as many digits as it takes, without bias."""
        while True:
            x, y = next(digits), 10
            if n > 10:
                x, y = x * 10 + next(digits), 100
            if n > 100:
                x, y = x * 10 + next(digits), 1000
            if x < n * (y // n):
                return x % n

    table = list(range(256))
    for i in range(2, 257):
        j = draw(i)
        table[j], table[i - 1] = table[i - 1], table[j]
    return table


def md2(data: bytes) -> bytes:
    table = _pi_table()
    data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    check, last = bytearray(16), 0
    for at in range(0, len(data), 16):
        for j in range(16):
            check[j] ^= table[data[at + j] ^ last]
            last = check[j]
    state = bytearray(48)
    for at in range(0, len(data) + 16, 16):
        block = (data + check)[at : at + 16]
        state[16:32] = block
        state[32:48] = bytes(a ^ b for a, b in zip(state[:16], block, strict=True))
        t = 0
        for k in range(18):
            for j in range(48):
                state[j] ^= table[t]
                t = state[j]
            t = (t + k) % 256
    return bytes(state[:16])


def _digest(data: bytes, method: str) -> bytes:
    return md2(data) if method.lower() == "md2" else hashlib.new(METHODS[method.lower()], data).digest()


def formatted(digest: bytes, fmt: str):
    if fmt == "hex":
        return digest.hex()
    if fmt == "HEX":
        return digest.hex().upper()
    if fmt == "base64":  # no padding signs; a digest that fills its last letter gets one more
        return base64.b64encode(digest).decode().rstrip("=") + ("" if len(digest) % 3 else "A")
    return np.frombuffer(digest, np.uint8).astype(np.float64 if fmt == "double" else np.uint8)


def digest_column(data: Column, method: str = "md5", fmt: str = "hex") -> Column:
    """The digest of a binary column, on the JVM."""
    name = method.lower()
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if name == "md5":
        h, n = F.md5(data), 16
    elif name == "sha-1":
        h, n = F.sha1(data), 20
    else:
        bits = int(name[4:])
        h, n = F.sha2(data, bits), bits // 8
    if fmt == "hex":
        return h
    if fmt == "HEX":
        return F.upper(h)
    if fmt == "base64":
        out = F.translate(F.base64(F.unhex(h)), "=\r\n", "")  # it breaks long lines
        return out if n % 3 else F.concat(out, F.lit("A"))
    if fmt in ("double", "uint8"):
        kind = "double" if fmt == "double" else "int"
        places = F.sequence(F.lit(1), F.lit(2 * n), F.lit(2))
        return F.transform(places, lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast(kind))
    raise ValueError(f"unknown format {fmt!r}")


def text_bytes(s: Column) -> Column:
    """Text as 16-bit characters, as ``bin`` input takes it."""
    return F.encode(s, "UTF-16LE")


def members_hash(members: Column) -> Column:
    """Digest of a set of ids."""
    return F.md5(F.array_join(F.sort_array(members), ","))
