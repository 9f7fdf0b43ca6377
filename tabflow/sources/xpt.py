"""SAS transport files, version 5: 80-byte records, IBM floating point."""

from __future__ import annotations

import math
import struct
import warnings
from collections.abc import Iterator, Sequence
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.errors import runtime
from tabflow.functions.types import NUMERIC
from tabflow.relation import Relation, hidden_name
from tabflow.sources import files
from tabflow.workers import importable

RECORD, MAX_CHAR = 80, 200
#: Fixed values of the format: header records, a fixed time stamp, and the bytes that mark a missing number.
LIBRARY = "HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000  "
MEMBER = "HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140  "
DESCRIPTOR = "HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000  "
NAMESTR = "HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000{:04d}00000000000000000000  "
OBS = "HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000  "
STAMP = "01JAN60:00:00:00"
MISSING = b"." + bytes(7)


def to_ibm(value: float | None) -> bytes:
    """An IEEE double as an 8-byte IBM float (base 16, excess 64)."""
    if value is None or math.isnan(value):
        return MISSING
    if value == 0:
        return bytes(8)
    fraction, two = math.frexp(abs(value))  # value = fraction * 2**two, fraction in [0.5, 1)
    sixteen = -(-two // 4)
    mantissa = round(math.ldexp(fraction, 56 - (4 * sixteen - two)))
    if mantissa >> 56:
        mantissa, sixteen = mantissa >> 4, sixteen + 1
    if not -64 <= sixteen <= 63:
        raise runtime("XPT_RANGE", f"{value} is outside the range of the format")
    sign = 0x80 if value < 0 else 0
    return bytes([sign | (sixteen + 64)]) + mantissa.to_bytes(7, "big")


def from_ibm(data: bytes) -> float | None:
    data = data.ljust(8, b"\0")
    mantissa = int.from_bytes(data[1:8], "big")
    if mantissa == 0:
        return 0.0 if data[0] in (0, 0x80) else None
    value = math.ldexp(mantissa, 4 * ((data[0] & 0x7F) - 64) - 56)
    return -value if data[0] & 0x80 else value


def _pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % RECORD)


def encode(name: str, columns: Sequence[tuple[str, bool, int]], rows: Iterator[Sequence[object]]) -> Iterator[bytes]:
    """A file of one member.  ``columns``: name, whether numeric, length in bytes."""
    yield LIBRARY.encode()
    yield f"{'SAS':<8}{'SAS':<8}{'SASLIB':<8}{'9.4':<8}{'':<8}{'':24}{STAMP}".encode()
    yield f"{STAMP:<80}".encode()
    yield MEMBER.encode()
    yield DESCRIPTOR.encode()
    yield f"{'SAS':<8}{name[:8].upper():<8}{'SASDATA':<8}{'9.4':<8}{'':<8}{'':24}{STAMP}".encode()
    yield f"{STAMP:<16}{'':16}{'':<40}{'':<8}".encode()
    yield NAMESTR.format(len(columns)).encode()
    place, described = 0, b""
    for i, (column, numeric, length) in enumerate(columns, 1):
        described += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 1 if numeric else 2, 0, length, i, column.encode()[:8].ljust(8), b" " * 40, b" " * 8, 0, 0, 0, b"\0\0", b" " * 8, 0, 0, place, bytes(52))
        place += length
    yield _pad(described)
    yield OBS.encode()
    size, held = 0, b""
    for r in rows:
        for v, (_, numeric, length) in zip(r, columns, strict=True):
            held += to_ibm(None if v is None else float(v)) if numeric else ("" if v is None else str(v)).encode().ljust(length)[:length]
        if len(held) >= 1 << 16:
            cut = len(held) - len(held) % RECORD
            yield held[:cut]
            size, held = size + cut, held[cut:]
    yield _pad(held)


def decode(data: bytes) -> tuple[list[tuple[str, bool]], list[tuple]]:
    """The columns (name, whether numeric) and rows of the first member."""
    if not data.startswith(LIBRARY[:48].encode()):
        raise runtime("XPT_FORMAT", "not a version 5 transport file")
    at = data.find(b"HEADER RECORD*******NAMESTR")
    if at < 0:
        raise runtime("XPT_FORMAT", "no variables")
    count = int(data[at + 54 : at + 58])
    size = 136 if data[data.find(b"*MEMBER ") + 60 :][:15].endswith(b"136") else 140
    begin = at + RECORD
    columns = []
    for i in range(count):
        n = data[begin + i * size : begin + (i + 1) * size]
        kind, _, length = struct.unpack(">hhh", n[:6])
        name = n[8:16].decode("latin-1").strip()
        if kind not in (1, 2):
            raise runtime("XPT_UNSUPPORTED", f"variable {name} has the unknown type {kind}")
        if n[16:56].strip(b" \0") or n[56:64].strip(b" \0"):
            warnings.warn(f"the label or format of variable {name} is ignored", stacklevel=2)
        columns.append((name, kind == 1, length, struct.unpack(">l", n[84:88])[0]))
    begin += count * size
    begin += -begin % RECORD
    body = data[begin + RECORD :]
    stop = body.find(b"HEADER RECORD*******MEMBER")
    body = body if stop < 0 else body[:stop]
    width = sum(c[2] for c in columns)
    total = len(body) // width if width else 0
    while total and not body[(total - 1) * width : total * width].strip(b" "):
        total -= 1  # blanks that fill the last record
    rows = []
    for r in range(total):
        row = body[r * width : (r + 1) * width]
        rows.append(tuple(from_ibm(row[p : p + n]) if numeric else (row[p : p + n].decode("utf-8", "replace").rstrip() or None) for _, numeric, n, p in columns))
    while rows and all(v is None for v in rows[-1]):
        rows.pop()
    return [(n, numeric) for n, numeric, _, _ in columns], rows


def read(spark: SparkSession, path: str) -> Relation:
    """A transport file, read by one task (the format can't be split)."""
    importable(spark)
    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.substring("content", 1, 1 << 20).alias("c")).first()
    columns, _ = decode(bytes(head["c"]))
    at = hidden_name("x")
    schema = T.StructType([*[T.StructField(n, T.DoubleType() if numeric else T.StringType()) for n, numeric in columns], T.StructField(at, T.LongType())])

    def rows(it):
        import pandas as pd

        for pdf in it:
            for content in pdf["content"]:
                _, found = decode(bytes(content))
                yield pd.DataFrame([(*r, i) for i, r in enumerate(found)], columns=schema.names)

    return Relation(files.select("content").mapInPandas(rows, schema), tuple(n for n, _ in columns), (at,))


def write(rel: Relation, path: str, name: str = "DATA") -> dict:
    """A transport file in the relation's order; text columns are as wide as their longest value, 200 bytes at most.

    The format keeps 8 bytes of a name; labels are left blank.
    """
    kinds = {c: rel.typed(c).type for c in rel.columns}
    text = [c for c in rel.columns if kinds[c] not in NUMERIC | {"bool"}]
    widths = rel.df.agg(*[F.max(F.octet_length(rel.col(c).cast("string"))).alias(f"w{i}") for i, c in enumerate(text)]).first() if text else []
    lengths = {c: (widths[i] or 8) for i, c in enumerate(text)}
    wide = [c for c in text if lengths[c] > MAX_CHAR]
    if wide:
        raise runtime("XPT_LENGTH_EXCEEDED", f"{wide[0]} has values of more than {MAX_CHAR} bytes")
    columns = [(c, c not in lengths, lengths.get(c, 8)) for c in rel.columns]
    if len({c.encode()[:8] for c in rel.columns}) < len(rel.columns):
        raise runtime("XPT_NAME_COLLISION", "two columns share the 8 bytes that the format keeps of a name")

    def plain() -> Iterator[Sequence[object]]:
        for r in rel.ordered().toLocalIterator():
            yield [float(v) if isinstance(v, Decimal | bool) else v for v in r]

    with files.create(path) as f:
        for part in encode(name, columns, plain()):
            f.write(part)
    return {"path": path, "columns": list(rel.columns)}
