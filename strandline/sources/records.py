"""The byte form of log records, and reports of benchmark runs.

A record is op (1 byte), key length (4), value length (4), expiry (8), all
little-endian, then key and value.  Reading stops at the first record that is
cut off.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = struct.Struct("<BIIQ")
_SCHEMA = "path string, offset long, op int, key binary, value binary, exp long"


def encode_record(op: int, key: bytes, value: bytes, exp: int = 0) -> bytes:
    return _HEADER.pack(op, len(key), len(value), exp) + key + value


def decode_records(data: bytes) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """(offset, op, key, value, exp) of each whole record."""
    at = 0
    while at + _HEADER.size <= len(data):
        op, k, v, exp = _HEADER.unpack_from(data, at)
        body = at + _HEADER.size
        if body + k + v > len(data):
            return
        yield at, op, data[body : body + k], data[body + k : body + k + v], exp
        at = body + k + v


def _little_endian(n: Column, size: int) -> Column:
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def encoded(log: DataFrame) -> Column:
    """The byte form of a log's rows; a null value is empty."""
    key, value = F.col("k").cast("binary"), F.coalesce(F.col("v").cast("binary"), F.lit(b""))
    sizes = [_little_endian(F.octet_length(x).cast("long"), 4) for x in (key, value)]
    return F.concat(_little_endian(F.col("op").cast("long"), 1), *sizes, _little_endian(F.col("exp"), 8), key, value)


def decoded(data: DataFrame) -> DataFrame:
    """The records of byte strings (path, content), one row each, with their
    offsets; a path may be any name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(decode_records(data))
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    columns = [[name] * len(part), *map(list, zip(*part))]
                    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")]
                    )

    return data.select("path", "content").mapInArrow(run, _SCHEMA)


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of log files, one row each, with their offsets."""
    return decoded(spark.read.format("binaryFile").load(path))


def read_bench_reports(spark: SparkSession, path: str) -> DataFrame:
    """Results from JSON reports: a list of results, or a report that has them
    under ``results``."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("results").alias("r")).select("r.*") if "results" in df.columns else df
