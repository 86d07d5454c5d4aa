"""Protobuf messages as samples: remote write, and OTLP metrics.

Whole messages (``content`` of a binary file scan) are decoded in Arrow batches by a small reader
of the wire format; everything after that is built-in.
"""

from __future__ import annotations

import gzip
import math
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SAMPLES
from ..session import share_code
from .formats import as_samples

STALE_BITS = 0x7FF0000000000002  # the NaN that marks a series as ended


def varint(b: memoryview, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        if c < 128:
            return x, i
        shift += 7


def fields(b: memoryview) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a message; length-delimited values are views."""
    i = 0
    while i < len(b):
        tag, i = varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"bad wire type {kind}")
        yield tag >> 3, kind, v


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def zigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def double(v: memoryview) -> float:
    return struct.unpack("<d", v)[0]


def fixed(v: memoryview) -> int:
    return struct.unpack("<Q", v)[0]


def text(v: memoryview) -> str:
    return bytes(v).decode("utf-8", "replace")


def snappy(data: bytes) -> bytes:
    """The block format: a length, then literals and copies."""
    src = memoryview(data)
    n, i = varint(src, 0)
    out = bytearray()
    while i < len(src):
        tag = src[i]
        i += 1
        if tag & 3 == 0:
            size = tag >> 2
            if size >= 60:
                extra = size - 59
                size, i = int.from_bytes(src[i : i + extra], "little"), i + extra
            out += src[i : i + size + 1]
            i += size + 1
            continue
        if tag & 3 == 1:
            size, offset, i = (tag >> 2 & 7) + 4, tag >> 5 << 8 | src[i], i + 1
        else:
            wide = 2 if tag & 3 == 2 else 4
            size, offset, i = (tag >> 2) + 1, int.from_bytes(src[i : i + wide], "little"), i + wide
        if not 0 < offset <= len(out):
            raise ValueError("bad copy in compressed data")
        start = len(out) - offset
        for j in range(size):  # a copy may overlap what it writes
            out.append(out[start + j])
    if len(out) != n:
        raise ValueError("bad length of compressed data")
    return bytes(out)


def decompress(data: bytes, encoding: str) -> bytes:
    match encoding:
        case "" | "identity" | "none":
            return data
        case "gzip":
            return gzip.decompress(data)
        case "deflate":
            return zlib.decompress(data)
        case "snappy":
            return snappy(data)
        case "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"unknown encoding {encoding!r}")


Row = tuple[str, dict, int, float]


def remote_write_rows(data: bytes) -> Iterator[Row]:
    for f, _, series in fields(memoryview(data)):
        if f != 1:
            continue
        labels: dict[str, str] = {}
        samples = []
        for g, _, v in fields(series):
            parts = dict((n, x) for n, _, x in fields(v)) if g in (1, 2) else {}
            if g == 1:
                labels[text(parts.get(1, b""))] = text(parts.get(2, b""))
            elif g == 2:
                samples.append((signed(parts.get(2, 0)), double(parts[1]) if 1 in parts else 0.0))
        name = labels.pop("__name__", "")
        for ts, v in samples:
            yield name, labels, ts, v


def _any(v: memoryview) -> str:
    for n, _, x in fields(v):
        match n:
            case 1:
                return text(x)
            case 2:
                return "true" if x else "false"
            case 3:
                return str(signed(x))
            case 4:
                return repr(double(x))
    return ""


def _attributes(items: list[memoryview]) -> dict[str, str]:
    out = {}
    for m in items:
        key = value = ""
        for n, _, x in fields(m):
            if n == 1:
                key = text(x)
            elif n == 2:
                value = _any(x)
        out[key] = value
    return out


def _packed(v, kind: int, fmt: str) -> list:
    return [struct.unpack("<" + fmt, v[i : i + 8])[0] for i in range(0, len(v), 8)] if kind == 2 else [struct.unpack("<" + fmt, v)[0]]


def _point(v: memoryview, attribute_field: int) -> dict:
    p: dict = {"attributes": [], "counts": [], "bounds": [], "quantiles": []}
    for n, k, x in fields(v):
        p[n] = (k, x)
        if n == attribute_field:
            p["attributes"].append(x)
    return p


def _number_text(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


STALE = struct.unpack("<d", struct.pack("<Q", STALE_BITS))[0]


def otlp_rows(data: bytes) -> Iterator[Row]:
    """Gauges and sums as they are; histograms as _count, _sum and cumulative _bucket; summaries by quantile."""
    for f, _, rm in fields(memoryview(data)):
        if f != 1:
            continue
        base: dict[str, str] = {}
        scopes = []
        for n, _, x in fields(rm):
            if n == 1:
                base |= _attributes([y for m, _, y in fields(x) if m == 1])
            elif n == 2:
                scopes.append(x)
        for scope in scopes:
            own, metrics = dict(base), []
            for n, _, x in fields(scope):
                if n == 1:
                    for m, _, y in fields(x):
                        if m == 1 and y:
                            own["scope.name"] = text(y)
                        elif m == 2 and y:
                            own["scope.version"] = text(y)
                        elif m == 3:
                            own |= {f"scope.attributes.{k}": v for k, v in _attributes([y]).items()}
                elif n == 2:
                    metrics.append(x)
            for metric in metrics:
                yield from _metric_rows(metric, own)


def _metric_rows(metric: memoryview, own: dict[str, str]) -> Iterator[Row]:
    name = ""
    for n, _, x in fields(metric):
        if n == 1:
            name = text(x)
    for n, _, x in fields(metric):
        if n not in (5, 7, 9, 10, 11):
            continue
        for m, _, raw in fields(x):
            if m != 1:
                continue
            p = _point(raw, {5: 7, 7: 7, 9: 9, 10: 1, 11: 7}[n])
            labels = own | _attributes(p["attributes"])
            ts = fixed(p[3][1]) // 1_000_000 if 3 in p else 0
            gone = bool(p.get({5: 8, 7: 8, 9: 10, 10: 10, 11: 8}[n], (0, 0))[1] & 1)
            value = lambda v, gone=gone: STALE if gone else v
            if n in (5, 7):
                # a point without a value counts as zero
                yield name, labels, ts, value(double(p[4][1]) if 4 in p else float(signed(fixed(p[6][1]))) if 6 in p else 0.0)
                continue
            count = float(fixed(p[4][1])) if 4 in p else 0.0
            if n == 9:
                counts = [c for m2, k, c2 in fields(raw) if m2 == 6 for c in _packed(c2, k, "Q")]
                bounds = [c for m2, k, c2 in fields(raw) if m2 == 7 for c in _packed(c2, k, "d")]
                if len(counts) != len(bounds) + 1:
                    continue
                yield f"{name}_count", labels, ts, value(count)
                if 5 in p:
                    yield f"{name}_sum", labels, ts, value(double(p[5][1]))
                total = 0
                for c, b in zip(counts, [*bounds, math.inf], strict=True):
                    total += c
                    yield f"{name}_bucket", labels | {"le": "+Inf" if b == math.inf else _number_text(b)}, ts, value(float(total))
            elif n == 10:
                yield f"{name}_count", labels, ts, value(count)
                if 5 in p:
                    yield f"{name}_sum", labels, ts, value(double(p[5][1]))
                ratio = 2.0 ** (2.0 ** -zigzag(p[6][1] if 6 in p else 0)) if 6 in p else 2.0
                edge = double(p[14][1]) if 14 in p else 0.0
                if 7 in p and fixed(p[7][1]):
                    yield f"{name}_bucket", labels | {"vmrange": f"{0:.3e}...{edge:.3e}"}, ts, value(float(fixed(p[7][1])))
                if 8 in p:
                    offset, counts = 0, []
                    for m2, k, c2 in fields(p[8][1]):
                        if m2 == 1:
                            offset = zigzag(c2)
                        elif m2 == 2:
                            i = 0
                            while k == 2 and i < len(c2):
                                c, i = varint(c2, i)
                                counts.append(c)
                    for i, c in enumerate(counts):
                        if c:
                            yield f"{name}_bucket", labels | {"vmrange": f"{ratio ** (offset + i):.3e}...{ratio ** (offset + i + 1):.3e}"}, ts, value(float(c))
            else:
                yield f"{name}_count", labels, ts, value(count)
                yield f"{name}_sum", labels, ts, value(double(p[5][1]) if 5 in p else 0.0)
                for m2, _, q in fields(raw):
                    if m2 == 6:
                        d = {k: double(v) for k, _, v in fields(q)}
                        yield name, labels | {"quantile": _number_text(d.get(1, 0.0))}, ts, value(d.get(2, 0.0))


def _decoded(messages: DataFrame, rows, content: str, encoding: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["data"]:
                if data is None:
                    continue
                try:
                    for name, labels, ts, v in rows(decompress(bytes(data), encoding)):
                        stale = struct.unpack("<Q", struct.pack("<d", v))[0] == STALE_BITS
                        out.append((name, labels, ts, None if stale or math.isnan(v) else v, stale))
                except (ValueError, IndexError, struct.error, OSError, zlib.error):
                    continue  # a broken message gives nothing
            yield pd.DataFrame(out, columns=SAMPLES.names)

    share_code(messages.sparkSession)
    return as_samples(messages.select(F.col(content).alias("data")).mapInPandas(run, SAMPLES))


def remote_write(messages: DataFrame, content: str = "content", encoding: str = "snappy") -> DataFrame:
    return _decoded(messages, remote_write_rows, content, encoding)


def otlp(messages: DataFrame, content: str = "content", encoding: str = "") -> DataFrame:
    return _decoded(messages, otlp_rows, content, encoding)
