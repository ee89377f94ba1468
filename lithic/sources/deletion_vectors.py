"""Deletion vectors: positions of deleted rows of one data file, as a blob of a Puffin file."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The marks and sizes of the published formats.
MAGIC = b"\xd1\xd3\x39\x64"
PUFFIN = b"PFA1"
PLAIN, WITH_RUNS = 12346, 12347
ARRAY_MOST, BITMAP_BYTES, OFFSETS_FROM = 4096, 8192, 4


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: str, n: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if self.at + size > len(self.raw):
            raise ValueError("the vector ends early")
        self.at += size
        return np.frombuffer(self.raw, kind, n, self.at - size)


def _bitmap(r: _Reader) -> np.ndarray:
    """The 32-bit values of one Roaring bitmap in the portable layout."""
    cookie = int(r.take("<u4")[0])
    if cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(r.take("u1", (n + 7) // 8), bitorder="little")[:n].astype(bool)
    elif cookie == PLAIN:
        n = int(r.take("<u4")[0])
        runs = np.zeros(n, bool)
    else:
        raise ValueError("not a Roaring bitmap")
    head = r.take("<u2", 2 * n).reshape(n, 2).astype(np.int64)
    if cookie == PLAIN or n >= OFFSETS_FROM:
        r.take("<u4", n)  # containers follow one another, so their offsets aren't needed
    parts = []
    for (key, less), run in zip(head, runs, strict=True):
        if run:
            spans = r.take("<u2", 2 * int(r.take("<u2")[0])).reshape(-1, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in spans]) if len(spans) else np.zeros(0, np.int64)
        elif less < ARRAY_MOST:
            low = r.take("<u2", int(less) + 1).astype(np.int64)
        else:
            low = np.flatnonzero(np.unpackbits(r.take("u1", BITMAP_BYTES), bitorder="little"))
        parts.append(low + (key << 16))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def decode(blob: bytes) -> np.ndarray:
    """Positions, ascending; an error if the length, the mark or the checksum is wrong."""
    if len(blob) < 12 or struct.unpack(">I", blob[:4])[0] != len(blob) - 8 or blob[4:8] != MAGIC:
        raise ValueError("not a deletion vector")
    if zlib.crc32(blob[4:-4]) != struct.unpack(">I", blob[-4:])[0]:
        raise ValueError("the vector's checksum is wrong")
    r = _Reader(blob[8:-4])
    parts = []
    for _ in range(int(r.take("<u8")[0])):
        high = int(r.take("<u4")[0])
        parts.append(_bitmap(r) + (high << 32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def container(low: np.ndarray) -> bytes:
    """Different, ascending values below 65,536 as an array or bitmap container."""
    return low.astype("<u2").tobytes() if len(low) <= ARRAY_MOST else np.packbits(np.isin(np.arange(1 << 16), low), bitorder="little").tobytes()


def assemble(containers: dict[int, tuple[int, bytes]]) -> bytes:
    """The blob of containers, each with its number of values, by the positions' bits above the lowest 16."""
    by_high: dict[int, list[int]] = {}
    for key in sorted(containers):
        by_high.setdefault(key >> 16, []).append(key)
    body = [struct.pack("<Q", len(by_high))]
    for high, keys in by_high.items():
        chunks = [containers[k][1] for k in keys]
        start = 8 + 8 * len(keys)
        offsets = start + np.cumsum([0, *(len(c) for c in chunks[:-1])])
        head = np.array([(k & 0xFFFF, containers[k][0] - 1) for k in keys]).astype("<u2").tobytes()
        body += [struct.pack("<III", high, PLAIN, len(keys)), head, offsets.astype("<u4").tobytes(), *chunks]
    inner = MAGIC + b"".join(body)
    return struct.pack(">I", len(inner)) + inner + struct.pack(">I", zlib.crc32(inner))


def encode(positions: np.ndarray) -> bytes:
    """The blob of different positions, with array and bitmap containers."""
    positions = np.unique(np.asarray(positions, np.int64))
    keys, first = np.unique(positions >> 16, return_index=True)
    groups = np.split(positions & 0xFFFF, first[1:])
    return assemble({int(k): (len(g), container(g)) for k, g in zip(keys, groups, strict=True)} if len(keys) else {})
