"""Survey packets: Avro object containers and schema-framed datums, decoded in Arrow batches.

Spark's Avro package is not always there, so a small decoder turns packets into rows of a declared Spark schema; the
rest of ingest is DataFrame work. A packet that can't be decoded becomes a row with its error, never a failed job.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Items of a block, at most: items of type null take no bytes, so a block's bytes don't bound them.
MOST_ITEMS = 1 << 20


class PacketError(ValueError):
    """Bytes that are no packet of the expected kind."""


class Reader:
    """Avro's primitive encodings, read from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise PacketError("the packet ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            if shift > 63:
                raise PacketError("a number is too long")

    def blob(self) -> bytes:
        return self.take(self.long())


def without_duplicate_fields(schema: Any) -> Any:
    """The schema with second fields of one name renamed ``name__dupN``, so that both can be read."""
    if isinstance(schema, list):
        return [without_duplicate_fields(s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: without_duplicate_fields(v) if k in ("type", "items", "values") else v for k, v in schema.items()}
    if "fields" in schema:
        seen: dict[str, int] = {}
        fields = []
        for f in schema["fields"]:
            n = seen[f["name"]] = seen.get(f["name"], -1) + 1
            fields.append(f | {"type": without_duplicate_fields(f["type"])} | ({"name": f"{f['name']}__dup{n}"} if n else {}))
        out["fields"] = fields
    return out


class Decoder:
    """Decodes datums of one writer schema."""

    def __init__(self, schema: Any):
        self.names: dict[str, Any] = {}
        self.schema = schema
        self._collect(schema, "")

    def _collect(self, s: Any, space: str) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x, space)
        elif isinstance(s, dict):
            space = s.get("namespace", space)
            if "name" in s and s.get("type") in ("record", "enum", "fixed"):
                self.names[s["name"]] = self.names[f"{space}.{s['name']}" if space else s["name"]] = s
            for f in s.get("fields", ()):
                self._collect(f["type"], space)
            for k in ("items", "values"):
                if k in s:
                    self._collect(s[k], space)
            if isinstance(s.get("type"), (dict, list)):
                self._collect(s["type"], space)

    def read(self, r: Reader, s: Any = None) -> Any:
        s = self.schema if s is None else s
        if isinstance(s, list):
            i = r.long()
            if not 0 <= i < len(s):
                raise PacketError("no such branch of a union")
            return self.read(r, s[i])
        kind = s.get("type") if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self.read(r, kind)
        if kind == "null":
            return None
        if kind in ("int", "long"):
            return r.long()
        if kind == "float":
            return struct.unpack("<f", r.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", r.take(8))[0]
        if kind == "boolean":
            return r.take(1) != b"\0"
        if kind == "string":
            return r.blob().decode()
        if kind == "bytes":
            return r.blob()
        if kind == "fixed":
            return r.take(s["size"])
        if kind == "enum":
            return s["symbols"][r.long()]
        if kind == "record":
            return {f["name"]: self.read(r, f["type"]) for f in s["fields"]}
        if kind in ("array", "map"):
            out: Any = [] if kind == "array" else {}
            while n := r.long():
                if n < 0:
                    n = -n
                    r.long()
                if n > MOST_ITEMS:
                    raise PacketError(f"a block of {n} items")
                for _ in range(n):
                    if kind == "array":
                        out.append(self.read(r, s["items"]))
                    else:
                        key = r.blob().decode()
                        out[key] = self.read(r, s["values"])
            return out
        if kind in self.names:
            return self.read(r, self.names[kind])
        raise PacketError(f"unknown type {kind}")


class Containers:
    """Decodes object containers of exactly one record; a schema seen before is not parsed again."""

    def __init__(self, rename_duplicate_fields: bool = False):
        self.rename, self.known = rename_duplicate_fields, {}

    def __call__(self, packet: bytes) -> dict:
        if packet[:4] != b"Obj\x01":
            raise PacketError("no object container")
        r, meta = Reader(packet, 4), {}
        while n := r.long():
            if n < 0:
                n = -n
                r.long()
            for _ in range(n):
                key = r.blob().decode()
                meta[key] = r.blob()
        sync = r.take(16)
        count, block = r.long(), r.blob()
        if count != 1 or r.take(16) != sync or r.at != len(packet):
            raise PacketError("a packet holds one record")
        codec = meta.get("avro.codec", b"null")
        if codec == b"deflate":
            block = zlib.decompress(block, -15)
        elif codec != b"null":
            raise PacketError(f"unknown codec {codec.decode()}")
        text = meta["avro.schema"]
        if text not in self.known:
            schema = json.loads(text)
            self.known[text] = Decoder(without_duplicate_fields(schema) if self.rename else schema)
        return self.known[text].read(Reader(block))


class Framed:
    """Decodes a datum behind a zero byte and a big-endian schema id; schemas are given by id."""

    def __init__(self, schemas: dict[int, Any]):
        self.schemas, self.known = schemas, {}

    def __call__(self, packet: bytes) -> dict:
        if len(packet) < 5 or packet[0] != 0:
            raise PacketError("no framed datum")
        i = int.from_bytes(packet[1:5], "big")
        if i not in self.known:
            if i not in self.schemas:
                raise PacketError(f"unknown schema {i}")
            self.known[i] = Decoder(self.schemas[i])
        return self.known[i].read(Reader(packet, 5))


def schema_version(i: int) -> tuple[int, int]:
    """Major and minor version that a registry's schema id stands for."""
    return i // 100, i % 100


def shaped(value: Any, kind: T.DataType) -> Any:
    """A decoded value as the declared type has it: missing fields are null, others are left out."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: shaped(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        if not -(1 << bits) <= (number := int(value)) < 1 << bits:
            raise PacketError(f"{number} is no {kind.simpleString()}")
        return number
    if isinstance(kind, T.StringType):
        return str(value)
    return value


def decode(packets: DataFrame, schema: T.StructType, how: Containers | Framed, column: str = "value") -> DataFrame:
    """(packet, error, raw) for each row: the packet as a struct of ``schema``, or why it could not be decoded, with its
    bytes as they came. Whatever a packet holds, it makes a row and never fails the job."""
    out = T.StructType([T.StructField("packet", schema), T.StructField("error", T.StringType()), T.StructField("raw", T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, errors, kept = [], [], []
            for raw in frame[column]:
                try:
                    rows.append(shaped(how(bytes(raw)), schema))
                    errors.append(None)
                    kept.append(None)
                except Exception as e:  # noqa: BLE001  anything may be wrong with bytes from outside, and all of it is told
                    rows.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:1000])
                    kept.append(raw)
            yield pd.DataFrame({"packet": pd.Series(rows, dtype=object), "error": pd.Series(errors, dtype=object), "raw": pd.Series(kept, dtype=object)})

    return packets.select(column).mapInPandas(run, out)


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where("error IS NULL").select("packet.*")


def quarantined(decoded: DataFrame) -> DataFrame:
    """Why packets could not be decoded, and their bytes, from which they can be decoded again."""
    return decoded.where("error IS NOT NULL").select("error", "raw")


def schemas_from(files: dict[str, str]) -> dict[int, Any]:
    """Schemas by id from texts by name: "703.avsc" or "alert_v7_3.avsc" is 703. Names defined in other files of the
    same version are put in where they are first used."""
    groups: dict[int, dict[str, Any]] = {}
    for name, text in sorted(files.items()):
        numbers = re.findall(r"\d+", name.rsplit("/", 1)[-1])
        i = int(numbers[-2]) * 100 + int(numbers[-1]) if len(numbers) > 1 else int(numbers[-1])
        schema = json.loads(text)
        space = schema.get("namespace", "")
        groups.setdefault(i, {})[f"{space}.{schema['name']}" if space else schema["name"]] = schema
    out = {}
    for i, named in groups.items():
        used = {n for s in named.values() for n in named if n in re.findall(r'"([^"]+)"', json.dumps({k: v for k, v in s.items() if k not in ("name", "namespace")}))}
        (top,) = [n for n in named if n not in used] or [next(iter(named))]
        out[i] = _filled(named[top], named, {top})
    return out


def _filled(s: Any, named: dict[str, Any], seen: set[str]) -> Any:
    if isinstance(s, str) and s in named and s not in seen:
        seen.add(s)
        return _filled(named[s], named, seen)
    if isinstance(s, list):
        return [_filled(x, named, seen) for x in s]
    if isinstance(s, dict):
        return {k: _filled(v, named, seen) if k in ("type", "items", "values", "fields") else v for k, v in s.items()}
    return s


def avro_schema(kind: T.DataType, name: str = "packet") -> Any:
    """The Avro schema of a Spark type; fields that may be null are unions with null."""
    plain = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if isinstance(kind, T.StructType):
        wrap = lambda f, s: ["null", s] if f.nullable else s
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": wrap(f, avro_schema(f.dataType, f"{name}_{f.name}"))} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        inner = avro_schema(kind.elementType, f"{name}_item")
        return {"type": "array", "items": ["null", inner] if kind.containsNull else inner}
    if isinstance(kind, T.MapType):
        inner = avro_schema(kind.valueType, f"{name}_value")
        return {"type": "map", "values": ["null", inner] if kind.valueContainsNull else inner}
    return plain[type(kind)]


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encoded(value: Any, s: Any) -> bytes:
    """A value as an Avro datum of a schema that ``avro_schema`` made."""
    if isinstance(s, list):
        return _long(0) if value is None else _long(1) + encoded(value, s[1])
    kind = s["type"] if isinstance(s, dict) else s
    if kind == "record":
        return b"".join(encoded(value[f["name"]], f["type"]) for f in s["fields"])
    if kind == "array":
        return (_long(len(value)) + b"".join(encoded(v, s["items"]) for v in value) if len(value) else b"") + _long(0)
    if kind == "map":
        pairs = dict(value).items()  # Arrow gives pairs
        return (_long(len(pairs)) + b"".join(encoded(k, "string") + encoded(v, s["values"]) for k, v in pairs) if pairs else b"") + _long(0)
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("int", "long"):
        return _long(int(value))
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    raw = value.encode() if kind == "string" else bytes(value)
    return _long(len(raw)) + raw


def encode(rows: DataFrame, name: str = "packet", key: str | None = None) -> DataFrame:
    """(key, value): each row as an Avro datum of the schema of the whole table, in Arrow batches."""
    import pyarrow as pa

    schema = avro_schema(rows.schema, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.to_pylist()
            keys = [str(r[key]) if key else None for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([encoded(r, schema) for r in found], pa.binary())], ["key", "value"])

    return rows.mapInArrow(run, "key string, value binary")
