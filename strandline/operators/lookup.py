"""Point, metadata and range reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.latest import current, visible
from strandline.sources.log import NOW, prefix_end


def get(log: DataFrame, key: str | bytes, now: int = NOW) -> DataFrame:
    """The live version of one key; no row if there is none."""
    return current(log.where(F.col("k") == F.lit(key)), now)


def get_many(log: DataFrame, keys: DataFrame, now: int = NOW) -> DataFrame:
    """One row per row of ``keys`` (k): found, and v if it was.

    Only the keys asked for are ranked.  Spark broadcasts the keys if it knows
    them to be few, and shuffles otherwise.
    """
    asked = log.join(keys.select("k").distinct(), "k", "left_semi")
    live = current(asked, now).select("k", "v", F.lit(True).alias("_hit"))
    return keys.join(live, "k", "left").select("k", F.coalesce("_hit", F.lit(False)).alias("found"), "v")


def subrange(value: Column, offset: int | Column, length: int | Column) -> Column:
    """Part of a text or binary value, in its own units.

    Offset and end are clamped; a length of 0 is to the end; an offset beyond
    the end gives an empty value, for stored and pointed-to values alike.
    """
    offset, length = (x if isinstance(x, Column) else F.lit(x) for x in (offset, length))
    rest = F.when(length == 0, F.length(value)).otherwise(length)
    return F.substring(value, (offset + 1).cast("int"), rest.cast("int"))


def pieces(value: Column, piece: int = 4 << 20) -> Column:
    """The places at which a value is read piece by piece: an array of offset
    and length, empty for an empty value."""
    n = F.octet_length(value).cast("long")
    last = F.floor((n - 1) / piece).cast("long")
    each = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    return F.transform(each, lambda i: F.struct((i * piece).alias("offset"), F.least(F.lit(piece).cast("long"), n - i * piece).alias("length")))


def head(log: DataFrame, now: int = NOW) -> DataFrame:
    """Key and value length in bytes of every live key; values behind pointers
    (pointer.len, where the log has it) by the pointer."""
    live = current(log, now)
    stored = F.octet_length("v").cast("long")
    size = F.coalesce(F.col("pointer.len"), stored) if "pointer" in log.columns else stored
    return live.select("k", F.coalesce(size, F.lit(0)).alias("value_length"))


def exists(keys: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """The rows of ``keys`` that ``rows`` has."""
    return keys.join(rows.select(on), on, "left_semi")


def key_bounds(prefix: str | bytes, start: str | bytes = "") -> Column:
    """Keys from ``start`` on that have ``prefix``, both texts or both bytes.

    The bounds reach the scan for text and binary keys alike; startswith alone
    would for text only.
    """
    k, low = F.col("k"), max(prefix or type(start)(), start or type(prefix)())
    found = k >= F.lit(low) if low else F.lit(True)
    if not prefix:
        return found
    end = prefix_end(prefix)
    found = found & F.startswith(k, F.lit(prefix))
    return found & (k < F.lit(end)) if end else found


def range_keys(log: DataFrame, prefix: str | bytes = "", start: str | bytes = "", limit: int | None = None, now: int = NOW) -> DataFrame:
    """Live keys in order, without values, from ``start`` and with ``prefix``;
    the first ``limit``."""
    keys = current(log.where(key_bounds(prefix, start)), now).select("k")
    return keys.orderBy("k").limit(limit) if limit is not None else keys


def page_after(log: DataFrame, last: str | bytes, limit: int, prefix: str | bytes = "", now: int = NOW) -> DataFrame:
    """The next page: live keys after ``last``."""
    keys = current(log.where(key_bounds(prefix) & (F.col("k") > last)), now).select("k")
    return keys.orderBy("k").limit(limit)


def seek(log: DataFrame, target: str) -> DataFrame:
    """The first entry at or after ``target``: least key, newest version."""
    return log.where(F.col("k") >= target).orderBy("k", F.desc("seq")).limit(1)


def read_source(log: DataFrame, source: Column, keys: DataFrame, now: int = NOW) -> DataFrame:
    """How many lookups each source (memory, table, ...) answers; keys that
    are not live count as 'miss'."""
    live = current(log.withColumn("_source", source).join(keys.select("k").distinct(), "k", "left_semi"), now)
    found = keys.join(live.select("k", "_source"), "k", "left")
    return found.groupBy(F.coalesce("_source", F.lit("miss")).alias("source")).agg(F.count("*").alias("lookups"))


def resolved(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """``rows`` with values behind pointers read from ``extents`` (extent_id,
    data binary)."""
    e = extents.select(F.col("extent_id").alias("_e"), F.col("data").alias("_data"))
    value = F.when(F.col("pointer").isNull(), F.col("v")).otherwise(
        F.substring("_data", (F.col("pointer.offset") + 1).cast("int"), F.col("pointer.len").cast("int"))
    )
    return rows.join(e, F.col("pointer.extent_id") == F.col("_e"), "left").withColumn("v", value).drop("_e", "_data")


__all__ = [
    "exists", "get", "get_many", "head", "key_bounds", "page_after", "range_keys", "read_source", "resolved",
    "seek", "subrange", "visible",
]
