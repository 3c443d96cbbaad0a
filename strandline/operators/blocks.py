"""Layout of records: offsets, blocks, chunks, extents and shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.sources.log import POINTER_BYTES, RECORD_HEADER

# Fixed values of the table format: a block's bytes and entries, and a chunk's bytes.
BLOCK_BYTES, BLOCK_ENTRIES = 64 << 10, 1000
CHUNK_BYTES = 512 << 20
#: Bytes of an entry in a block beside key (with its 9-byte version) and value.
ENTRY_HEADER = 21
#: The same as a compaction reckons it.
CHUNK_HEADER = 20


def record_bytes() -> Column:
    return (F.lit(RECORD_HEADER) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long")


def offsets(log: DataFrame, batch: Column, size: Column | None = None) -> DataFrame:
    """Each record's place in its write batch: offset and end.

    Batches are written one by one, so the running sum stays within a batch.
    """
    rows = log.withColumns({"batch": batch, "_size": record_bytes() if size is None else size})
    before = W.partitionBy("batch").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0))
    return rows.withColumn("offset", start).withColumn("end", F.col("offset") + F.col("_size")).drop("_size")


def pointers(rows: DataFrame, value: str, extent: Column, order: str) -> DataFrame:
    """``rows`` with a pointer (extent_id, offset, len) for values of over
    POINTER_BYTES bytes, laid out in each extent by ``order``."""
    size = F.octet_length(value).cast("long")
    large = F.when(size > POINTER_BYTES, size).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"_extent": extent.cast("long"), "_large": large})
    before = W.partitionBy("_extent").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_large").over(before), F.lit(0))
    pointer = F.struct(F.col("_extent").alias("extent_id"), start.alias("offset"), F.col("_large").alias("len"))
    # windows may not stand inside a condition on the same row's size
    rows = rows.withColumn("pointer", pointer)
    return rows.withColumn("pointer", F.when(F.col("_large") > 0, F.col("pointer"))).drop("_extent", "_large")


def packed(rows: DataFrame, group: str, order: list[str], size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """``rows`` with block: rows of a group in order fill a block until the
    next would pass ``most_bytes`` or it has ``most_rows``; then a new one
    begins.  Each group (a table) is packed by itself, as it is written.

    Filling is sequential, hence a function of one group's rows; only what it
    needs goes to Python.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[True] + [False] * (len(order) - 1))
        block, held, n, out = 0, 0, 0, []
        for s in pdf[size].tolist():
            if n and (held + s > most_bytes or n >= most_rows):
                block, held, n = block + 1, 0, 0
            held, n = held + s, n + 1
            out.append(block)
        return pdf.assign(block=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", block long"
    return rows.groupBy(group).applyInPandas(fill, schema)


def block_rows(log: DataFrame, table_id: Column) -> DataFrame:
    """Log records as block entries: table_id, k, seq and size."""
    size = F.lit(ENTRY_HEADER + 9) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return log.select(table_id.alias("table_id"), "k", "seq", size.cast("long").alias("size"))


def chunk_rows(log: DataFrame, part: Column) -> DataFrame:
    """Log records as entries of a compaction's chunks: part, k, seq and size."""
    size = F.lit(CHUNK_HEADER + 9) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return log.select(part.alias("part"), "k", "seq", size.cast("long").alias("size"))


def shard_size(length: Column, shards: int) -> Column:
    """Bytes of a data shard; the last one ends in a 4-byte length."""
    per = F.floor((length + (shards + 3)) / shards).cast("long")
    return F.greatest(per, F.lit(4).cast("long"))


def shard_span(offset: Column, length: Column, per_shard: Column) -> tuple[Column, Column]:
    """The first and the last shard that a byte range touches."""
    at = lambda x: F.floor(x / per_shard).cast("long")
    return at(offset), at(offset + length - 1)


def data_shards(value: Column, length: Column, shards: int) -> Column:
    """The data shards of a binary value, zero-filled, the last one ending in
    the value's length (big-endian)."""
    per = shard_size(length, shards)
    trailer = F.unhex(F.lpad(F.hex(length), 8, "0"))
    zeros = F.unhex(F.repeat(F.lit("00"), (per * shards - 4 - length).cast("int")))
    whole = F.concat(value, zeros, trailer)
    return F.array(*[F.substring(whole, (per * i + 1).cast("int"), per.cast("int")) for i in range(shards)])
