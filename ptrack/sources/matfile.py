"""Numeric variables of MAT-files, level 5."""
from __future__ import annotations

import struct
import zlib

import numpy as np

# Data types of the MAT level 5 format.
MI_DTYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MI_MATRIX = 14
MI_COMPRESSED = 15
MX_DOUBLE = 6


def _elements(buf: memoryview, order: str):
    at = 0
    while at + 8 <= len(buf):
        kind, size = struct.unpack_from(order + "II", buf, at)
        if kind >> 16:                       # small element: size and data share 8 bytes
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, buf[at + 4:at + 4 + size]
            at += 8
            continue
        yield kind, buf[at + 8:at + 8 + size]
        at += 8 + size + (0 if kind == MI_COMPRESSED else -size % 8)


def load(path: str) -> dict[str, np.ndarray]:
    """Real numeric arrays by name, column-major flattened to their shape."""
    with open(path, "rb") as f:
        raw = f.read()
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(memoryview(raw)[128:], order):
        if kind == MI_COMPRESSED:
            kind, body = next(_elements(memoryview(zlib.decompress(body)), order))
        if kind != MI_MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4 or parts[3][0] not in MI_DTYPES:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        name = bytes(parts[2][1]).decode("latin1")
        data = np.frombuffer(parts[3][1], order + MI_DTYPES[parts[3][0]])
        if data.size == int(np.prod(shape)):
            out[name] = data.reshape(tuple(shape), order="F")
    return out


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + _pad(body)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as double row vectors."""
    with open(path, "wb") as f:
        f.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM")
        for name, a in arrays.items():
            a = np.asarray(a, "<f8").ravel()
            f.write(_element(MI_MATRIX, _element(6, struct.pack("<II", MX_DOUBLE, 0))
                             + _element(5, struct.pack("<ii", 1, a.size)) + _element(1, name.encode("latin1"))
                             + _element(9, a.tobytes())))
