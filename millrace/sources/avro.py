"""Avro object container files, as far as table manifests need them: a decoder for small metadata files."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.stream = io.BytesIO(data)

    def bytes(self, n: int) -> bytes:
        out = self.stream.read(n)
        if len(out) < n:
            raise EOFError("the Avro file ends early")
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.bytes(1)[0]
            value |= (b & 0x7F) << shift
            if not b & 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def at_end(self) -> bool:
        here = self.stream.tell()
        more = self.stream.read(1)
        self.stream.seek(here)
        return not more


def _value(r: _Reader, schema, names: dict):
    if isinstance(schema, list):
        return _value(r, schema[r.long()], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return _value(r, kind, names)
    if kind in names and kind not in ("record", "enum", "fixed"):
        return _value(r, names[kind], names)
    if kind == "null":
        return None
    if kind == "boolean":
        return r.bytes(1) == b"\x01"
    if kind in ("int", "long"):
        return r.long()
    if kind == "float":
        return struct.unpack("<f", r.bytes(4))[0]
    if kind == "double":
        return struct.unpack("<d", r.bytes(8))[0]
    if kind == "bytes":
        return r.bytes(r.long())
    if kind == "string":
        return r.bytes(r.long()).decode()
    if kind == "fixed":
        names[schema["name"]] = schema
        return r.bytes(schema["size"])
    if kind == "enum":
        names[schema["name"]] = schema
        return schema["symbols"][r.long()]
    if kind == "record":
        names[schema["name"]] = schema
        return {f["name"]: _value(r, f["type"], names) for f in schema["fields"]}
    if kind == "array":
        return [_value(r, schema["items"], names) for _ in _blocks(r)]
    if kind == "map":
        return {r.bytes(r.long()).decode(): _value(r, schema["values"], names) for _ in _blocks(r)}
    raise ValueError(f"unknown Avro type {kind}")


def _blocks(r: _Reader) -> Iterator[int]:
    while n := r.long():
        if n < 0:
            n = -n
            r.long()  # the block's size in bytes
        yield from range(n)


def read_avro(data: bytes) -> list[dict]:
    """The records of a container file (null and deflate codecs)."""
    r = _Reader(data)
    if r.bytes(4) != b"Obj\x01":
        raise ValueError("not an Avro file")
    meta = {r.bytes(r.long()).decode(): r.bytes(r.long()) for _ in _blocks(r)}
    schema, codec, sync = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), r.bytes(16)
    if codec not in ("null", "deflate"):
        raise ValueError(f"unknown Avro codec {codec}")
    out, names = [], {}
    while not r.at_end():
        n, body = r.long(), r.bytes(r.long())
        if r.bytes(16) != sync:
            raise ValueError("an Avro block's marker doesn't match")
        block = _Reader(zlib.decompress(body, -15) if codec == "deflate" else body)
        out += [_value(block, schema, names) for _ in range(n)]
    return out
