"""Key ranges: routing, splitting, placement and reference counts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.latest import current, in_range
from strandline.sources.log import NOW
from strandline.sources.shared import Scratch

#: Up to so many range starts are constants of a plan, in blocks of so many.
FEW_RANGES, BLOCK = 4096, 64


def presplit(spark: SparkSession, n: int) -> DataFrame:
    """``n`` ranges of the 32-bit hexadecimal key space: part, low, high; the
    outer ends are open (empty)."""
    step = 0xFFFFFFFF // max(1, n)
    at = lambda i: F.lower(F.lpad(F.hex(i * step), 8, "0"))
    i = F.col("id")
    return spark.range(max(1, n)).select(
        i.alias("part"),
        F.when(i == 0, "").otherwise(at(i)).alias("low"),
        F.when(i == max(1, n) - 1, "").otherwise(at(i + 1)).alias("high"),
    )


def route(rows: DataFrame, lows: Iterable[str], key: str = "k") -> Column:
    """The index of the range that holds a key, ranges given by their sorted
    low ends; -1 before the first.

    A driver-side list of range starts is a constant of the plan, so a key
    needs neither a join nor a shuffle.  It is compared with the first start of
    each block, and with the starts of its block.
    """
    lows = list(lows)
    if lows != sorted(lows) or len(lows) > FEW_RANGES:
        raise ValueError(f"at most {FEW_RANGES} sorted range starts")
    below = lambda starts: F.size(F.filter(starts, lambda s: s <= F.col(key)))
    all_ = F.array(*[F.lit(x) for x in lows])
    if len(lows) <= BLOCK:
        return below(all_) - 1
    first = F.greatest(below(F.array(*[F.lit(x) for x in lows[::BLOCK]])) - 1, F.lit(0)) * BLOCK
    return first + below(F.slice(all_, first + 1, F.lit(BLOCK))) - 1


def route_join(rows: DataFrame, ranges: DataFrame, key: str = "k", few: int = FEW_RANGES) -> DataFrame:
    """``rows`` with the part of ``ranges`` (part, low, high) that holds them,
    for tables of ranges of any number.

    Up to ``few`` starts, evenly spread over the ranges, cut the keys into
    buckets; a range is in each bucket that it touches.  Rows and ranges meet by
    bucket, so that no row is compared with all ranges.  Where buckets would
    have more than BLOCK starts each, keys and ranges meet by the keys' places
    in order instead.
    """
    n = ranges.count()
    every = max(1, -(-n // max(1, few)))
    if every > BLOCK:
        return _route_by_place(rows, ranges, key)
    place = F.row_number().over(W.orderBy("low")) - 1  # of ranges: metadata, one row a partition of a store
    starts = ranges.select("low").distinct().withColumn("_i", place).where(F.col("_i") % every == 0)
    lows = sorted(r["low"] for r in starts.collect()) or [""]
    last = F.when(F.col("high") == "", len(lows) - 1).otherwise(route(ranges, lows, "high"))
    touched = F.sequence(F.greatest(route(ranges, lows, "low"), F.lit(-1)), F.greatest(last, route(ranges, lows, "low")))
    held = ranges.withColumn("_bucket", F.explode(touched))
    here = rows.withColumn("_at", route(rows, lows, key))
    same = (F.col("_at") == F.col("_bucket")) & in_range(F.col(key), F.col("low"), F.col("high"))
    return here.join(held, same).drop("_at", "_bucket")


def _route_by_place(rows: DataFrame, ranges: DataFrame, key: str, chunk: int = 4096) -> DataFrame:
    """The same by equality alone: distinct keys and the ends of ranges are
    sorted together into ranges of the key space and the keys numbered; a range
    holds the keys from its start's number to its end's, each of which some row
    has.
    """
    scratch, zero = Scratch(rows.sparkSession), F.lit(0).cast("long")
    ends = ranges.select(F.explode(F.array("low", "high")).alias("_k"), zero.alias("_n"))
    points = rows.select(F.col(key).alias("_k"), (zero + 1).alias("_n")).union(ends).where("_k is not null")
    points = points.groupBy("_k").agg(F.max("_n").alias("_n"))
    # written, since a part's number must not change between its two uses
    cut = scratch.keep(points.repartitionByRange("_k").withColumn("_cut", F.spark_partition_id()))
    before = F.sum("_n").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1))  # one row a partition of the sort
    starts = cut.groupBy(F.col("_cut").alias("_c")).agg(F.sum("_n").alias("_n")).select("_c", before.alias("_before"))
    so_far = F.sum("_n").over(W.partitionBy("_cut").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    numbered = cut.withColumn("_own", so_far).join(F.broadcast(starts), F.col("_cut") == F.col("_c"))
    numbered = scratch.keep(numbered.select("_k", "_n", (F.col("_own") + F.coalesce("_before", zero)).alias("_at")))
    total = cut.agg(F.coalesce(F.sum("_n"), zero)).first()[0]

    end = lambda c: numbered.select(F.col("_k").alias("_" + c), F.col("_at").alias("_at_" + c))
    held = ranges.join(end("low"), F.col("low") == F.col("_low")).join(end("high"), F.col("high") == F.col("_high"))
    last = F.when(F.col("high") == "", F.lit(total).cast("long")).otherwise(F.col("_at_high")) - 1
    held = held.select(*ranges.columns, F.col("_at_low").alias("_first"), last.alias("_last")).where("_first <= _last")
    # in chunks, so that no array grows with the keys of a range
    held = held.withColumn("_chunk", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(chunk).cast("long"))))
    held = held.withColumn("_at", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + (chunk - 1), F.col("_last")))))
    # each of these pairs has a row at least
    pairs = numbered.where("_n = 1").select("_k", "_at").join(held.drop("_first", "_last", "_chunk"), "_at").drop("_at")
    return rows.join(pairs, F.col(key) == F.col("_k")).drop("_k")


def route_key(lows: list[str], key: str) -> int:
    """The same for one key on the driver."""
    return bisect_right(lows, key) - 1


def key_at_rank(keys: DataFrame, rank: int, few: int = 4096) -> str | None:
    """The key of this rank, from 0, among distinct ``keys`` (k) in order.

    The keys are resolved once and dealt to ranges; counts tell the range that
    has the rank, which is dealt out anew until ``few`` are left.  Each time a
    thousandth of the keys or so is left, so that no task sorts them all.
    """
    scratch, left = Scratch(keys.sparkSession), rank
    n = keys.count()
    while True:
        ranges = min(1024, max(1, -(-n // few)))
        dealt = scratch.keep(keys.select("k").repartitionByRange(ranges, "k").withColumn("part", F.spark_partition_id()))
        counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # at most 1,024 rows
        for part in sorted(counts):
            if left < counts[part]:
                break
            left -= counts[part]
        else:
            return None
        keys = dealt.where(F.col("part") == part)
        n, before = counts[part], n
        if n <= few or n == before:
            return keys.orderBy("k").limit(left + 1).tail(1)[0]["k"]


def split_key(live_keys: DataFrame) -> str | None:
    """The middle live key, where a partition splits; None under two keys."""
    n = live_keys.count()
    return key_at_rank(live_keys, n // 2) if n >= 2 else None


def live_keys(log: DataFrame, lows: Iterable[str], now: int = NOW) -> DataFrame:
    """Distinct live keys by partition, partitions given by their sorted low
    ends."""
    live = current(log, now)
    return live.groupBy(route(live, lows).alias("part")).agg(F.count("*").alias("keys"))


def split(partitions: DataFrame, part: int, mid: str, new_part: int) -> DataFrame:
    """The table of ranges (part, low, high) after a split: the left half keeps
    its id, the right one gets ``new_part``."""
    hit = F.col("part") == part
    left = partitions.withColumn("high", F.when(hit, mid).otherwise(F.col("high")))
    right = partitions.where(hit).withColumns({"part": F.lit(new_part), "low": F.lit(mid)})
    return left.unionByName(right)


def duplicated_streams(members: DataFrame, copied: DataFrame, new_ids: Mapping[int, int]) -> DataFrame:
    """Stream members (stream_id, pos, extent_id) after each stream in
    ``new_ids`` was copied, by reference, to a new id."""
    names = F.create_map(*[F.lit(x) for kv in new_ids.items() for x in kv])
    more = copied.withColumn("stream_id", F.get(F.map_values(names), F.array_position(F.map_keys(names), F.col("stream_id")).cast("int") - 1))
    return members.unionByName(more)


def refs(members: DataFrame) -> DataFrame:
    """How many streams hold each extent."""
    return members.select("stream_id", "extent_id").distinct().groupBy("extent_id").agg(F.count("*").alias("refs"))


def refs_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed reference counts between two snapshots (extent_id, refs)."""
    b = new.select(F.col("extent_id").alias("_e"), F.col("refs").alias("_new"))
    both = old.join(b, F.col("extent_id") == F.col("_e"), "full_outer")
    delta = F.coalesce("_new", F.lit(0)) - F.coalesce("refs", F.lit(0))
    return both.select(F.coalesce("extent_id", "_e").alias("extent_id"), delta.alias("delta")).where("delta <> 0")


def refs_applied(current: DataFrame, diff: DataFrame) -> DataFrame:
    """Counts after a diff, never below 0."""
    d = diff.select(F.col("extent_id").alias("_e"), "delta")
    both = current.join(d, F.col("extent_id") == F.col("_e"), "full_outer")
    n = F.greatest(F.lit(0), F.coalesce("refs", F.lit(0)) + F.coalesce("delta", F.lit(0)))
    return both.select(F.coalesce("extent_id", "_e").alias("extent_id"), n.alias("refs"))


def overlaid(base: DataFrame, overlay: DataFrame, field: str, on: str = "extent_id") -> DataFrame:
    """``base`` with one field from ``overlay`` where that has a row; rows of
    ``overlay`` alone are added with nulls in the other fields."""
    o = overlay.select(F.col(on).alias("_on"), F.col(field).alias("_field"))
    both = base.join(o, F.col(on) == F.col("_on"), "full_outer")
    merged = {on: F.coalesce(on, "_on"), field: F.coalesce("_field", field)}
    return both.select(*(merged.get(c, F.col(c)).alias(c) for c in base.columns))


def punched(members: DataFrame, holes: DataFrame, stream_id: int) -> DataFrame:
    """Members after ``holes`` (extent_id) were taken out of a stream; an error
    if it would be empty."""
    own = members.where(F.col("stream_id") == stream_id)
    left = own.join(holes, "extent_id", "left_anti")
    if own.limit(1).count() and not left.limit(1).count():
        raise ValueError("a stream may not become empty")
    return members.where(F.col("stream_id") != stream_id).unionByName(left)


def truncated(members: DataFrame, stream_id: int, extent_id: int) -> DataFrame:
    """Members after a stream was cut before an extent; an error if that is
    its first or not in it."""
    own = members.where(F.col("stream_id") == stream_id)
    at = own.where(F.col("extent_id") == extent_id).agg(F.min("pos")).first()[0]
    first = own.agg(F.min("pos")).first()[0]
    if at is None or at == first:
        raise ValueError("nothing stands before this extent")
    return members.where((F.col("stream_id") != stream_id) | (F.col("pos") >= at))


def deletable(refs_now: DataFrame, pointer_refs: DataFrame) -> DataFrame:
    """Extents that neither streams nor tables' pointers refer to any more."""
    p = pointer_refs.where("vp_table_refs > 0").select("extent_id")
    return refs_now.where("refs = 0").join(p, "extent_id", "left_anti").select("extent_id")


def gaps(starts: DataFrame, start: str, bucket: int = 1 << 16) -> DataFrame:
    """Starts whose next one leaves a gap: start, next_start, gap.

    Neighbours are found within buckets of the key space; a bucket's last start
    is compared with the first one of the next bucket that has any.
    """
    b = F.floor(F.col(start) / bucket).cast("long")
    keys = starts.select(F.col(start).alias("start"), b.alias("_b")).distinct()
    inner = keys.withColumn("next_start", F.lead("start").over(W.partitionBy("_b").orderBy("start")))
    # one row for each bucket of 65,536 places
    firsts = keys.groupBy("_b").agg(F.min("start").alias("_first"))
    following = firsts.select("_b", F.lead("_first").over(W.orderBy("_b")).alias("_following"))
    both = inner.join(following, "_b").withColumn("next_start", F.coalesce("next_start", "_following"))
    return both.select("start", "next_start", (F.col("next_start") - F.col("start")).alias("gap")).where("gap > 1")


def load(servers: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions by server, idle servers at 0."""
    n = regions.groupBy("ps_id").agg(F.count("*").alias("_n"))
    return servers.join(n, "ps_id", "left").select("ps_id", F.coalesce("_n", F.lit(0)).alias("load"))


def least_loaded(loads: DataFrame) -> DataFrame:
    """The server of least load; of several, the one of least id."""
    return loads.agg(F.min_by("ps_id", F.struct("load", "ps_id")).alias("ps_id"))


def rebalance(parts: Iterable[int], servers: Iterable[int], regions: Mapping[int, int]) -> dict[int, int]:
    """Server of each partition: the one it has if that lives, else the least
    loaded one, in order of partition ids.  Metadata only: small by nature."""
    parts, alive = sorted(parts), set(servers)
    if not alive:
        return {p: s for p, s in regions.items() if p in set(parts)}
    held = {p: s for p, s in regions.items() if p in set(parts)}
    loads = dict.fromkeys(alive, 0)
    for s in held.values():
        if s in loads:
            loads[s] += 1
    placed = {}
    for p in parts:
        s = held.get(p)
        if s not in alive:
            s = min(alive, key=lambda x: (loads[x], x))
            loads[s] += 1
        placed[p] = s
    return placed


def evicted(heartbeats: DataFrame, now: int, after: int = 10) -> DataFrame:
    """Servers (ps_id, last_seen) not heard of for over ``after`` seconds."""
    return heartbeats.where(F.lit(now) - F.col("last_seen") > after)


def allocated(rows: DataFrame, next_id: int, order: str) -> DataFrame:
    """``rows`` with ids from ``next_id`` in the given order; for metadata."""
    return rows.withColumn("id", F.row_number().over(W.orderBy(order)).cast("long") + (next_id - 1))
