"""Samples as messages of the two protobuf formats, and text in compressed bodies.

Each task writes its own messages of at most so many samples, in Arrow batches and without a
shuffle.  Defined results: an empty table gives no messages; staleness markers are written as the
marker's NaN; samples without a time are left out; names and labels may be any text.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NAME
from ..session import share_code
from .protobuf import STALE, decompress


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _pair(number: int, key: str, value: bytes) -> bytes:
    return _block(number, _block(1, key.encode()) + _block(2, value))


def remote_write_message(rows: list[tuple[str, dict, int, float]]) -> bytes:
    """Samples as one write request, those of a series together."""
    series: dict[tuple, list[bytes]] = {}
    for name, labels, ts, v in rows:
        key = tuple(sorted(({NAME: name} | labels).items()))
        series.setdefault(key, []).append(_block(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _varint(ts)))
    return b"".join(_block(1, b"".join(_pair(1, k, x.encode()) for k, x in key) + b"".join(samples)) for key, samples in series.items())


def otlp_message(rows: list[tuple[str, dict, int, float]]) -> bytes:
    """Samples as one export request of gauges."""
    metrics = []
    for name, labels, ts, v in rows:
        attributes = b"".join(_pair(7, k, _block(1, x.encode())) for k, x in sorted(labels.items()))
        point = attributes + b"\x19" + struct.pack("<Q", ts * 1_000_000) + b"\x21" + struct.pack("<d", v)
        metrics.append(_block(2, _block(1, name.encode()) + _block(5, _block(1, point))))
    return _block(1, _block(2, b"".join(metrics)))


def compress(data: bytes, encoding: str) -> bytes:
    match encoding:
        case "" | "identity" | "none":
            return data
        case "gzip":
            return gzip.compress(data, mtime=0)
        case "deflate":
            return zlib.compress(data)
        case "snappy" | "zstd":
            raw = pa.compress(data, encoding, asbytes=True)
            return raw
    raise ValueError(f"unknown encoding {encoding!r}")


FORMATS = {"remote_write": (remote_write_message, "snappy"), "otlp": (otlp_message, "gzip")}


def messages(samples: DataFrame, fmt: str, rows_per_message: int = 5000) -> DataFrame:
    """``content``: samples as compressed messages of a format, for sources.protobuf or another system to read."""
    make, encoding = FORMATS[fmt]
    share_code(samples.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [STALE if gone else float("nan") if x is None else x for x, gone in zip(b["value"], b["is_stale"], strict=True)]
            rows = list(zip(b["name"], map(dict, b["labels"]), b["ts_ms"], v, strict=True))
            yield pd.DataFrame({"content": [compress(make(rows[i : i + rows_per_message]), encoding) for i in range(0, len(rows), rows_per_message)]})

    d = samples.where("ts_ms is not null").select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), "ts_ms", "value", F.coalesce("is_stale", F.lit(False)).alias("is_stale"))
    return d.mapInPandas(run, "content binary")


def text_bodies(lines: DataFrame, line: str = "value", encoding: str = "gzip", lines_per_body: int = 10_000) -> DataFrame:
    """``content``: lines as compressed bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs = b["line"].tolist()
            yield pd.DataFrame({"content": [compress("\n".join(xs[i : i + lines_per_body]).encode(), encoding) for i in range(0, len(xs), lines_per_body)]})

    share_code(lines.sparkSession)
    return lines.select(F.col(line).alias("line")).where("line is not null").mapInPandas(run, "content binary")


def text_lines(bodies: DataFrame, content: str = "content", encoding: str = "gzip") -> DataFrame:
    """``value``: the lines of compressed text bodies, for any reader of sources.formats; a broken body gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["data"]:
                try:
                    body = decompress(bytes(data), encoding)
                except (ValueError, IndexError, OSError, EOFError, zlib.error):
                    continue
                yield pd.DataFrame({"value": body.decode("utf-8", "replace").split("\n")})

    share_code(bodies.sparkSession)
    return bodies.select(F.col(content).alias("data")).where("data is not null").mapInPandas(run, "value string")
