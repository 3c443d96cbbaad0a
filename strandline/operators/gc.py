"""Garbage of large values: which extents to rewrite, and with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.latest import current
from strandline.sources.log import NOW, PUT

# Extents a run looks at, and the garbage share that is worth it.
MOST_EXTENTS, LEAST_RATIO = 3, 0.4


def discard_totals(table_discards: DataFrame) -> DataFrame:
    """Discarded bytes by extent over all tables' maps (extent_id, discarded)."""
    return table_discards.groupBy("extent_id").agg(F.sum("discarded").alias("discarded"))


def pending(table_discards: DataFrame, members: DataFrame) -> DataFrame:
    """Discards of the extents that the stream (extent_id) still has."""
    return discard_totals(table_discards).join(members.select("extent_id").distinct(), "extent_id", "left_semi")


def candidates(discarded: DataFrame, extents: DataFrame, most: int = MOST_EXTENTS, ratio: float = LEAST_RATIO) -> DataFrame:
    """The extents to rewrite: of the sealed ones (extent_id, sealed_length;
    the open tail is not among them) the ``most`` with most discards, and of
    those the ones that are garbage beyond ``ratio``.

    The limit comes before the ratio; ties go to the lower id.
    """
    share = F.col("discarded") / F.col("sealed_length")
    top = discarded.join(extents, "extent_id").orderBy(F.desc("discarded"), "extent_id").limit(most)
    return top.withColumn("ratio", share).where(F.col("ratio") > ratio)


def forced(requested: DataFrame, sealed: DataFrame, most: int = MOST_EXTENTS) -> DataFrame:
    """The first ``most`` requested extents (pos, extent_id) that are sealed."""
    return requested.join(sealed.select("extent_id").distinct(), "extent_id", "left_semi").orderBy("pos").limit(most)


def rewrite(log: DataFrame, extent_id: int, seq: int, now: int = NOW) -> DataFrame:
    """New records for the live values that still lie in an extent, one a key,
    with a number beyond all others.  Each is marked as pointing anew, so that a
    later collection sees it."""
    live = current(log, now).where(F.col("pointer.extent_id") == extent_id)
    return live.withColumns(
        {"seq": F.lit(seq).cast("long"), "op": F.lit(PUT), "rewritten": F.lit(True)}
    )


def still_live(log: DataFrame, extent_id: Column | int, now: int = NOW) -> DataFrame:
    """Which records of an extent the newest versions still point to."""
    live = current(log, now).select("k", "seq")
    return log.where(F.col("pointer.extent_id") == extent_id).join(live, ["k", "seq"], "left_semi")
