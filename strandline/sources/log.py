"""Mutation logs: their shape, builders on the standard tables, and storage.

Columns of a log: k (key, text or binary), seq (long, unique per key), op (PUT
or DELETE), v (as k; null or empty for a delete), exp (expiry in unix seconds,
0 for never).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Operation codes.
PUT, DELETE = 1, 2
#: Just after the last event of the standard tables; never the wall clock.
NOW = 1706659200
EVENT_TTL = 21600
# Fixed values of the record format.
#: A longer value is kept apart, and its record holds a pointer.
POINTER_BYTES = 4096
LOG_COLUMNS = ("k", "seq", "op", "v", "exp")
#: Bytes of a record beside key and value.
RECORD_HEADER = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expiry(now: Column | int, ttl: Column | int) -> Column:
    """When a record put at ``now`` with ``ttl`` seconds expires; 0 is never."""
    now, ttl = ((x if isinstance(x, Column) else F.lit(x)).cast("long") for x in (now, ttl))
    return F.when(ttl > 0, now + ttl).otherwise(F.lit(0).cast("long"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: a key per user, errors delete, signups and
    views expire after EVENT_TTL."""
    e = table(spark, sf_dir, "events")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        F.format_string("u%06d", "user_id").alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.col("props").alias("v"),
        expiry(second, F.when(F.col("event_type").isin("signup", "view"), EVENT_TTL).otherwise(0)).alias("exp"),
    )


def puts(rows: DataFrame, seq: int, now: int, ttl: int = 0) -> DataFrame:
    """Put records for ``rows`` (k, v), all with one number: it orders a key's
    versions, so keys of one batch may share it.  Of several values for a key
    the greatest stays."""
    each = rows.groupBy("k").agg(F.max("v").alias("v"))
    return each.select("k", F.lit(seq).cast("long").alias("seq"), F.lit(PUT).alias("op"), "v", expiry(now, ttl).alias("exp"))


def deletes(keys: DataFrame, seq: int) -> DataFrame:
    """Delete records for ``keys`` (k), known or not, with one number."""
    return keys.select("k").distinct().select(
        "k", F.lit(seq).cast("long").alias("seq"), F.lit(DELETE).alias("op"), F.lit("").cast(keys.schema["k"].dataType).alias("v"),
        F.lit(0).cast("long").alias("exp"),
    )


def append(log: DataFrame, path: str) -> None:
    log.select(*LOG_COLUMNS).write.mode("append").parquet(path)


def write_sorted(log: DataFrame, path: str, partitions: int | None = None) -> None:
    """A sorted table: files cover key ranges, rows by key, newest first, so
    that footers skip by key; a bloom filter on k serves lookups."""
    ranges = log.repartitionByRange(partitions, "k") if partitions else log.repartitionByRange("k")
    (
        ranges.sortWithinPartitions("k", F.desc("seq"))
        .write.option("parquet.bloom.filter.enabled#k", "true")
        .mode("overwrite")
        .parquet(path)
    )


def prefix_end(prefix: str | bytes) -> str | bytes | None:
    """The least string above every string with ``prefix``; None if there is
    none."""
    if isinstance(prefix, bytes):
        left = prefix.rstrip(b"\xff")
        return left[:-1] + bytes([left[-1] + 1]) if left else None
    points = list(prefix)
    while points:
        last = ord(points.pop())
        if last < 0x10FFFF:
            following = 0xE000 if last == 0xD7FF else last + 1
            return "".join(points) + chr(following)
    return None


def manifest_newest(manifest: DataFrame) -> DataFrame:
    """The table locations of the last valid checkpoint of each partition;
    ``manifest`` has part_id, version, valid and tables."""
    newest = manifest.where("valid").groupBy("part_id").agg(F.max_by("tables", "version").alias("tables"), F.max("version").alias("version"))
    return newest.select("part_id", "version", F.explode("tables").alias("table_id"))


def recovered(tables: DataFrame, log: DataFrame) -> DataFrame:
    """The records of flushed ``tables`` and those of ``log`` after them."""
    flushed = tables.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("flushed"))
    later = log.join(F.broadcast(flushed), F.col("seq") > F.col("flushed")).drop("flushed")  # one row is broadcast
    return tables.unionByName(later.select(*tables.columns))
