"""Reads Avro object container files: enough for table metadata, which is small."""

from __future__ import annotations

import json
import struct
import zlib
from typing import Any


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            if shift > 63:
                raise ValueError("a number is too long")

    def blob(self) -> bytes:
        return self.take(self.long())


def _value(b: _Bytes, kind: Any, named: dict) -> Any:
    if isinstance(kind, list):
        return _value(b, kind[b.long()], named)
    if isinstance(kind, str):
        if kind in named:
            return _value(b, named[kind], named)
        plain = {
            "null": lambda: None, "boolean": lambda: b.take(1) != b"\0", "int": b.long, "long": b.long, "bytes": b.blob, "string": lambda: b.blob().decode(),
            "float": lambda: struct.unpack("<f", b.take(4))[0], "double": lambda: struct.unpack("<d", b.take(8))[0],
        }
        return plain[kind]()
    what = kind["type"]
    if what == "record":
        named[kind["name"]] = kind
        return {f["name"]: _value(b, f["type"], named) for f in kind["fields"]}
    if what == "fixed":
        named[kind["name"]] = kind
        return b.take(kind["size"])
    if what == "enum":
        named[kind["name"]] = kind
        return kind["symbols"][b.long()]
    if what in ("array", "map"):
        out: list = []
        while n := b.long():
            if n < 0:
                n, _ = -n, b.long()
            for _ in range(n):
                out.append(_value(b, kind["items"], named) if what == "array" else (b.blob().decode(), _value(b, kind["values"], named)))
        return out if what == "array" else dict(out)
    return _value(b, what, named)


def read_records(raw: bytes) -> tuple[list[dict], dict[str, bytes]]:
    """The records and the header's metadata; codecs null and deflate."""
    b = _Bytes(raw)
    if b.take(4) != b"Obj\x01":
        raise ValueError("not an Avro container")
    meta = _value(b, {"type": "map", "values": "bytes"}, {})
    sync, kind, codec = b.take(16), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec {codec} is unknown")
    out = []
    while b.at < len(raw):
        n, block = b.long(), b.blob()
        inner = _Bytes(zlib.decompress(block, -15) if codec == "deflate" else block)
        out += [_value(inner, kind, {}) for _ in range(n)]
        if b.take(16) != sync:
            raise ValueError("a block has the wrong marker")
    return out, meta


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _encoded(value: Any, kind: Any) -> bytes:
    """``value`` in a schema without names that refer to one another; of a union, null or its other branch."""
    if isinstance(kind, list):
        at = kind.index("null") if value is None else next(k for k, x in enumerate(kind) if x != "null")
        return _long(at) + _encoded(value, kind[at])
    if isinstance(kind, str):
        if kind in ("bytes", "string"):
            raw = value.encode() if kind == "string" else bytes(value)
            return _long(len(raw)) + raw
        plain = {"null": lambda: b"", "boolean": lambda: bytes([bool(value)]), "int": lambda: _long(value), "long": lambda: _long(value), "float": lambda: struct.pack("<f", value), "double": lambda: struct.pack("<d", value)}
        return plain[kind]()
    if kind["type"] == "record":
        return b"".join(_encoded(value.get(f["name"]), f["type"]) for f in kind["fields"])
    if kind["type"] in ("array", "map"):
        items = [_encoded(x, kind["items"]) for x in value] if kind["type"] == "array" else [_encoded(k, "string") + _encoded(v, kind["values"]) for k, v in value.items()]
        return (_long(len(items)) + b"".join(items) if items else b"") + _long(0)
    return _encoded(value, kind["type"])


def write_records(kind: dict, records: list[dict], meta: dict[str, str] | None = None) -> bytes:
    """An Avro container of one deflated block; it reads back as ``records``."""
    body = b"".join(_encoded(r, kind) for r in records)
    squeeze = zlib.compressobj(wbits=-15)
    block = squeeze.compress(body) + squeeze.flush()
    head = {"avro.schema": json.dumps(kind), "avro.codec": "deflate", **(meta or {})}
    sync = struct.pack("<QQ", zlib.crc32(body), len(body))
    packed = _long(len(records)) + _long(len(block)) + block + sync if records else b""
    return b"Obj\x01" + _encoded({k: v.encode() for k, v in head.items()}, {"type": "map", "values": "bytes"}) + sync + packed
