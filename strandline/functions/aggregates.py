"""Aggregates of operational figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.sources.shared import Scratch

# Fixed value: the weight of a new sample.
ALPHA = 0.3


def nearest_ranks(rows: DataFrame, group: str, value: str, percents: list[int], buckets: int = 256) -> DataFrame:
    """Percentiles that are values of the sample: element floor(p / 100 * n) in
    order, the last one at most; 0.0 for a group without values.

    Equal values are counted first, in one pass over the rows.  Approximate
    quantiles cut each group's distinct values into buckets; sums by bucket tell
    in which one an element lies, and only that bucket is ranked.  The result is
    exact, and no task ranks a whole group.
    """
    scratch, key = Scratch(rows.sparkSession), F.col(group)
    all_ = scratch.keep(rows.groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    counts = all_.where("_v is not null")
    steps = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(key.alias("_g")).agg(F.percentile_approx("_v", steps, 10 * buckets).alias("_cuts"))
    # written, since approximate quantiles may change between their two uses with the order in which blocks arrive
    cuts = scratch.keep(cuts)
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = counts.join(cuts, key.eqNullSafe(F.col("_g"))).withColumn("_b", below).drop("_cuts", "_g")

    w = W.partitionBy(group)
    # at most one row a bucket and group
    sums = placed.groupBy(group, "_b").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumns(
        {
            "_end": F.sum("_sum").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)),
            "_total": F.sum("_sum").over(w),
        }
    )
    place = F.least(F.floor(F.col("_p") * F.col("_total") / 100).cast("long"), F.col("_total") - 1)
    wanted = (
        sums.withColumn("_p", F.explode(F.array(*map(F.lit, percents))))
        .withColumn("_at", place - (F.col("_end") - F.col("_sum")))
        .where("_at >= 0 and _at < _sum")
        .select(key.alias("_g"), F.col("_b").alias("_in"), "_p", "_at")
    )
    end = F.sum("_n").over(W.partitionBy(group, "_b", "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    own = key.eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_in"))
    found = placed.join(wanted, own).withColumn("_upto", end).where("_at < _upto and _at >= _upto - _n")
    of = lambda p: F.max(F.when(F.col("_p") == p, F.col("_v")))
    values = found.groupBy(key.alias("_g")).agg(*[of(p).alias(f"p{p}") for p in percents])
    groups = all_.select(group).distinct().join(values, key.eqNullSafe(F.col("_g")), "left").drop("_g")
    return groups.na.fill(0.0, [f"p{p}" for p in percents])


def ema(rows: DataFrame, group: str, order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """The exponential moving average of each group's values in order; the
    first one seeds it, values that are not positive are passed over.

    It is a sum of the values, each weighed by a power of 1 - alpha by its place
    from the end.  Values so far back that no double can show their weight are
    left out before the shuffle; how far that is follows from alpha.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    most = 1 if alpha == 1 else math.ceil(1075 * math.log(2) / -math.log1p(-alpha))
    good = rows.where(F.col(value) > 0)
    back = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
    recent = good.withColumn("_back", back).where(F.col("_back") <= most)
    weight = lambda n: F.pow(F.lit(1.0 - alpha), n - 1)
    seed = F.max_by(value, "_back") * weight(F.max("_back")) * (1 - alpha)
    return recent.groupBy(group).agg((F.sum(F.col(value) * weight(F.col("_back")) * alpha) + seed).alias("ema"))


def average_ms(nanoseconds: Column, n: Column) -> Column:
    """Mean milliseconds of a sum of nanoseconds; 0 of nothing."""
    return F.when(n > 0, nanoseconds / n / 1e6).otherwise(F.lit(0.0))


def throughput(rows: DataFrame, group: str, size: str, seconds: Column) -> DataFrame:
    """Operations, bytes, and both a second (MiB), by group."""
    t = F.max(seconds)
    return rows.groupBy(group).agg(
        F.count("*").alias("ops"),
        F.sum(size).alias("bytes"),
        F.when(t > 0, F.count("*") / t).otherwise(0.0).alias("ops_per_second"),
        F.when(t > 0, F.sum(size) / t / float(1 << 20)).otherwise(0.0).alias("mib_per_second"),
    )


def per_second(rows: DataFrame, second: Column) -> DataFrame:
    """Operations by second, with the running total; one row a second."""
    n = rows.groupBy(second.alias("second")).agg(F.count("*").alias("ops"))
    so_far = F.sum("ops").over(W.orderBy("second").rowsBetween(W.unboundedPreceding, 0))
    return n.withColumn("total", so_far)
