"""Reports over cluster metadata: nodes, disks, streams, extents, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def partition_sizes(partitions: DataFrame, members: DataFrame, extents: DataFrame) -> DataFrame:
    """Extents and bytes by partition: ``partitions`` has part and stream_id, or
    streams (an array), ``members`` stream_id and extent_id, ``extents``
    extent_id and length.  An extent that several streams of a partition hold
    counts once; extents that ``extents`` has not do not count."""
    if "streams" in partitions.columns:
        partitions = partitions.select("part", F.explode_outer("streams").alias("stream_id"))
    own = partitions.select("part", "stream_id")
    held = own.join(members.select("stream_id", "extent_id"), "stream_id").select("part", "extent_id").distinct()
    sums = held.join(extents.select("extent_id", "length"), "extent_id").groupBy("part").agg(
        F.count("*").alias("extents"), F.sum("length").alias("bytes")
    )
    return partitions.select("part").distinct().join(sums, "part", "left").na.fill(0, ["extents", "bytes"])


def largest(sizes: DataFrame, n: int, by: str = "bytes", key: str = "part") -> DataFrame:
    return sizes.orderBy(F.desc(by), key).limit(n)


def addresses(regions: DataFrame, servers: DataFrame, own: DataFrame) -> DataFrame:
    """Each partition's address: its own (``own``: part, address) if it has
    one, else its server's (``servers``: ps_id, address)."""
    s = servers.select("ps_id", F.col("address").alias("_server"))
    o = own.select("part", F.col("address").alias("_own"))
    return regions.join(s, "ps_id", "left").join(o, "part", "left").select(
        "part", "ps_id", F.coalesce("_own", "_server").alias("address")
    )


def node_disks(nodes: DataFrame, disks: DataFrame) -> DataFrame:
    """One row for each disk of a node (node_id, disk_ids); unknown disks are
    offline."""
    each = nodes.select("node_id", F.explode_outer("disk_ids").alias("disk_id"))
    return each.join(disks.select("disk_id", "online"), "disk_id", "left").select(
        "node_id", "disk_id", F.coalesce("online", F.lit(False)).alias("online")
    )


def orphan_extents(reported: DataFrame, known: DataFrame) -> DataFrame:
    """Extents that nodes have and the metadata has not."""
    return reported.join(known.select("extent_id"), "extent_id", "left_anti")


def commit_length(replicas: DataFrame) -> DataFrame:
    """The length that all replicas of an extent have."""
    return replicas.groupBy("extent_id").agg(F.min("length").alias("commit_length"))


def all_available(replicas: DataFrame, slots: Column | None = None) -> DataFrame:
    """By extent: the mask of slots seen, and whether none is missing."""
    bit = _bit(F.col("slot"))
    n = F.max("slots") if slots is None else slots
    return replicas.groupBy("extent_id").agg(F.bit_or(bit).alias("mask"), n.alias("slots")).withColumn(
        "all_available", F.col("mask") == _bit(F.col("slots")) - 1
    )


def recovery_candidates(extents: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas to recover, with the reason.

    ``extents`` has extent_id, sealed_length, avali (a bit mask) and replicas,
    an array of (node_id, disk_id) by slot.  Of a sealed extent, a replica is
    lost if its disk is known to be offline, its bit is not set, or its node is
    not reachable (``nodes``: node_id, reachable).
    """
    each = extents.where("sealed_length > 0").select(
        "extent_id", "avali", F.posexplode("replicas").alias("slot", "r")
    ).select("extent_id", "avali", "slot", F.col("r.node_id").alias("node_id"), F.col("r.disk_id").alias("disk_id"))
    known = each.join(disks.select("disk_id", "online"), "disk_id", "left").join(
        nodes.select("node_id", "reachable"), "node_id", "left"
    )
    unset = F.col("avali").bitwiseAND(_bit(F.col("slot"))) == 0
    reason = (
        F.when(F.col("online") == F.lit(False), "disk offline")
        .when(unset, "not available")
        .when(~F.coalesce("reachable", F.lit(False)), "node unreachable")
    )
    return known.withColumn("reason", reason).where("reason is not null").select("extent_id", "slot", "node_id", "disk_id", "reason")


def erasure_candidates(members: DataFrame, streams: DataFrame, extents: DataFrame, recovering: DataFrame) -> DataFrame:
    """Sealed extents, not converted yet, of streams with parity shards, that
    nobody recovers; each once, by the least stream."""
    open_ = extents.where("sealed_length > 0 and not converted")
    found = members.join(streams.where("parity > 0").select("stream_id", "data", "parity"), "stream_id").join(
        open_.select("extent_id"), "extent_id"
    )
    free = found.join(recovering.select("extent_id"), "extent_id", "left_anti")
    first = F.row_number().over(W.partitionBy("extent_id").orderBy("stream_id"))
    return free.withColumn("_rank", first).where("_rank = 1").select("extent_id", "stream_id", "data", "parity")


def healthy_first(nodes: DataFrame, n: int) -> DataFrame:
    """The first ``n`` healthy nodes by id; if there are fewer, the first ``n``
    of all."""
    rank = F.row_number().over(W.partitionBy("healthy").orderBy("node_id"))
    # ranks within each kind; no more than n of either are looked at further
    few = nodes.withColumn("_rank", rank).where(F.col("_rank") <= n)
    healthy = few.where("healthy").orderBy("node_id").limit(n)
    enough = healthy.count() >= n
    return (healthy if enough else nodes.orderBy("node_id").limit(n)).select("node_id")


def stream_info(members: DataFrame, extents: DataFrame) -> DataFrame:
    """By stream (``members``: stream_id, pos, extent_id): its extents' number
    and bytes (``extents``: extent_id, length), and its tail."""
    both = members.join(extents.select("extent_id", "length"), "extent_id", "left")
    return both.groupBy("stream_id").agg(
        F.count("*").alias("extents"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.max(F.struct("pos", "extent_id")).extent_id.alias("tail"),
    )


def last_extent(members: DataFrame) -> DataFrame:
    """The tail of each stream."""
    return members.groupBy("stream_id").agg(F.max(F.struct("pos", "extent_id")).extent_id.alias("extent_id"))


def report(sizes: DataFrame, where: DataFrame) -> DataFrame:
    """One JSON text a partition: id, address, extents, bytes."""
    rows = sizes.join(where, "part", "left")
    return rows.select("part", F.to_json(F.struct("part", "address", "extents", "bytes")).alias("info"))
