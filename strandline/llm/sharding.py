"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard comes from a sequence of pseudo-random jumps seeded by the key
(Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm").  No
ring table exists, and going from n to n + 1 shards moves a key only into the
new shard, with probability 1 / (n + 1).

The generator is the 64-bit linear congruential one of the paper.  Spark's
arithmetic checks for overflow, so the product modulo 2**64 is made of limbs of
22, 22 and 20 bits whose partial sums stay far below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, dealt_out

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW = (1 << 22) - 1
_TOP = (1 << 20) - 1
_M0, _M1, _M2 = MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44
#: A key jumps ln(shards) times on average; with 2**31 shards, more than 128
#: jumps have a chance of under 10**-50, and are an error, not a wrong shard.
MAX_JUMPS = 128


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long ``key``; a null key counts as 0."""
    if not 1 <= shards < 1 << 31:
        raise ValueError("shards must be from 1 to 2**31 - 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(_LOW).alias("a"),
        F.shiftrightunsigned(key, 22).bitwiseAND(_LOW).alias("b"),
        F.shiftrightunsigned(key, 44).alias("c"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(s: Column) -> Column:
        s0 = s.a * _M0 + INCREMENT
        s1 = s.a * _M1 + s.b * _M0 + F.shiftright(s0, 22)
        s2 = s.a * _M2 + s.b * _M1 + s.c * _M0 + F.shiftright(s1, 22)
        b, c = s1.bitwiseAND(_LOW), s2.bitwiseAND(_TOP)
        high = F.shiftleft(c, 11).bitwiseOR(F.shiftright(b, 11))  # the state's upper 31 bits
        jump = ((s.jump + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        return F.struct(
            s0.bitwiseAND(_LOW).alias("a"),
            b.alias("b"),
            c.alias("c"),
            s.jump.alias("shard"),
            jump.alias("jump"),
        )

    return F.reduce(
        F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))),
        start,
        lambda s, _: F.when(s.jump < shards, step(s)).otherwise(s),
        lambda s: F.when(s.jump >= shards, s.shard.cast("int")).otherwise(
            F.raise_error(F.lit("jump hash did not end")).cast("int")
        ),
    )


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's long ``key`` in column ``name``,
    which replaces a column of that name."""
    return df.withColumn(name, jump_hash(F.col(key), shards))


def shard_manifest(
    df: DataFrame,
    shards: int = 8,
    key: str = "doc_id",
    text: str = "text",
    rows_per_bucket: int = 8192,
) -> DataFrame:
    """One row per row of ``df``: its shard, and its place in that shard.

    Columns: ``key``, size (UTF-8 bytes of the text plus 1; a null text has
    none), text_crc32 (0 for a null or empty text), law ('key'), shard, slot
    (gapless from 0 in each shard) and grown_shard (the shard if there were one
    more).  Other columns of ``df`` are not read.

    Null keys count as key 0.  Repeated rows get a slot each.  An empty table
    gives no rows.

    Slots are two-level: each shard has hash buckets of about
    ``rows_per_bucket`` rows; a bucket's first slot is the sum of those before
    it.  Rows alike in key, size and checksum are counted before the shuffle
    and dealt out again after it, so no key makes a large bucket.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).cast("long").alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
    )
    alike = rows.groupBy("_key", "_size", "_crc").agg(F.count("*").alias("_n"))
    alike = scratch.keep(
        alike.withColumns({"_shard": jump_hash(F.col("_key"), shards), "_grown": jump_hash(F.col("_key"), shards + 1)})
    )
    distinct, most = alike.agg(F.count("*"), F.coalesce(F.max("_n"), F.lit(0))).first()
    buckets = max(1, -(-distinct // (shards * rows_per_bucket)))
    dealt = alike.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_size", "_crc"), F.lit(buckets)))

    before = W.orderBy("_bucket").partitionBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("_shard", "_bucket")
        .agg(F.sum("_n").alias("_total"))
        .select("_shard", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    )
    within = W.partitionBy("_shard", "_bucket").orderBy("_key", "_size", "_crc")
    placed = dealt.withColumn(
        "_before", F.coalesce(F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).join(starts, ["_shard", "_bucket"])
    first = F.col("_start") + F.col("_before")
    return dealt_out(placed.withColumn("_first", first), "_n", most).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_first") + F.col("_copy")).alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
