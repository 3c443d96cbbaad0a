"""Compaction: what it keeps, drops and discards, and which tables it takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.latest import in_range, newest, visible
from strandline.sources.log import NOW

MIB = 1 << 20
# Fixed values of the table choice: tables at most, full size of a table, the share of
# it under which a table is small, the head share, and the limit for a pair, in MiB.
MOST_TABLES, TABLE_MIB, RATIO, HEAD_SHARE, PAIR_MIB = 5, 256, 0.5, 0.3, 512


def major(log: DataFrame, low: str = "", high: str = "", now: int = NOW) -> DataFrame:
    """The newest version of every key in range, if live."""
    return newest(log.where(in_range(F.col("k"), low, high))).where(visible(now))


def minor(log: DataFrame, low: str = "", high: str = "") -> DataFrame:
    """The newest version of every key in range; deletes and expired versions
    stay, as older tables may still hold what they hide."""
    return newest(log.where(in_range(F.col("k"), low, high)))


def _judged(log: DataFrame, low: str, high: str, now: int) -> DataFrame:
    """All records with kept = 0, and those that a major compaction keeps once
    more with kept = 1, so that sums of either need no ranking of whole keys."""
    return log.withColumn("kept", F.lit(0)).unionByName(major(log, low, high, now).withColumn("kept", F.lit(1)))


def stats(log: DataFrame, low: str = "", high: str = "", now: int = NOW) -> DataFrame:
    """One row: records in, kept and discarded, and the bytes of either."""
    size = (F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long")
    rows = _judged(log.withColumn("_size", size), low, high, now)
    of = lambda kept, x: F.coalesce(F.sum(F.when(F.col("kept") == kept, x)), F.lit(0))
    one, size = F.lit(1), F.col("_size")
    return rows.agg(
        of(0, one).alias("n_in"),
        of(1, one).alias("n_kept"),
        (of(0, one) - of(1, one)).alias("n_discarded"),
        of(1, size).alias("bytes_kept"),
        (of(0, size) - of(1, size)).alias("bytes_discarded"),
    )


def discards(log: DataFrame, low: str = "", high: str = "", now: int = NOW) -> DataFrame:
    """Bytes of dropped large values by extent; ``log`` has pointer
    (extent_id, offset, len), null for values stored in place."""
    rows = _judged(log, low, high, now).where("pointer is not null")
    lost = F.sum(F.when(F.col("kept") == 0, F.col("pointer.len")).otherwise(-F.col("pointer.len")))
    return rows.groupBy(F.col("pointer.extent_id").alias("extent_id")).agg(lost.alias("discarded")).where("discarded > 0")


def table_properties(log: DataFrame, table_id: str = "table_id") -> DataFrame:
    """By table: key bounds, greatest seq, entries, raw bytes and the earliest
    expiry (0 if nothing expires)."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return log.groupBy(table_id).agg(
        F.min("k").alias("min_key"),
        F.max("k").alias("max_key"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("entries"),
        F.sum(size.cast("long")).alias("raw_bytes"),
        F.coalesce(F.min(F.when(F.col("exp") > 0, F.col("exp"))), F.lit(0)).alias("min_expires_at"),
    )


def pointer_deps(log: DataFrame, table_id: str = "table_id") -> DataFrame:
    """The extents that a table's pointers lead to, one row each."""
    return log.where("pointer is not null").select(table_id, F.col("pointer.extent_id").alias("extent_id")).distinct()


def due_for_major(properties: DataFrame, now: int = NOW) -> DataFrame:
    """The tables whose earliest expiry has passed: any one calls for a major
    compaction."""
    return properties.where((F.col("min_expires_at") > 0) & (F.col("min_expires_at") <= now))


def overlapping(properties: DataFrame, low: str, high: str) -> DataFrame:
    """The tables with a bound outside the partition's range."""
    inside = in_range(F.col("min_key"), low, high) & in_range(F.col("max_key"), low, high)
    return properties.where(~inside)


def skips(n_tables: Column | int, overlap: Column | bool) -> Column | bool:
    """Whether a major compaction has nothing to do."""
    return (n_tables < 2) & (overlap == False)  # noqa: E712


@dataclass(frozen=True)
class Table:
    """What the choice of tables looks at; one object a table of a partition."""

    table_id: int
    extent_id: int
    size: int
    last_seq: int


def pick_tables(tables: list[Table], pair_limit: int = PAIR_MIB * MIB) -> tuple[list[Table], int]:
    """The tables for a minor compaction, and the extent before which the
    stream may then be cut (0 for none).

    If the first table's extent has a small share of all bytes, its tables go,
    with what lies between them by seq, so that the extent can be dropped.
    Otherwise the first run of small tables by seq goes, one older neighbour
    included where both fit the pair limit.
    """
    if len(tables) < 2:
        return [], 0
    by_seq = sorted(tables, key=lambda t: t.last_seq)
    first = tables[0].extent_id
    of_first = [t for t in tables if t.extent_id == first]
    if sum(t.size for t in of_first) < round(HEAD_SHARE * sum(t.size for t in tables)):
        goal = of_first[:MOST_TABLES]
        low, high = min(t.last_seq for t in goal), max(t.last_seq for t in goal)
        run = [t for t in by_seq if low <= t.last_seq <= high][:MOST_TABLES]
        if len(run) < 2:
            return [], 0
        later = next((t.extent_id for t in tables if t.extent_id != first), 0)
        return run, later if all(t in run for t in goal) else 0

    small = [t.size < round(RATIO * TABLE_MIB * MIB) for t in by_seq]
    fits = lambda i, j: by_seq[i].size + by_seq[j].size < pair_limit
    at = 0
    while at < len(by_seq):
        if not small[at]:
            at += 1
            continue
        start = at - 1 if at and fits(at - 1, at) else at
        end = at + 1
        while end < len(by_seq) and small[end] and end - start < MOST_TABLES:
            end += 1
        if end - start == 1 and end < len(by_seq) and fits(at, end):
            return by_seq[start : end + 1], 0
        if end - start > 1:
            return by_seq[start:end], 0
        at = end + 1
    return [], 0
