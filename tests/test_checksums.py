import random

import xxhash
from pyspark.sql import functions as F

from strandline.functions import checksums, scalar


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (checksums.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def values():
    rng = random.Random(1)
    return [rng.randbytes(n) for n in (0, 1, 2, 9, 255, 256, 257, 511, 512, 513, 5000)] + [b"123456789", bytes(300), b"\xff" * 700]


def test_crc32c():
    assert checksums.crc32c([b"123456789"]) == [0xE3069283]
    assert checksums.crc32c(values()) == [slow_crc(v) for v in values()] and checksums.crc32c([]) == []


def test_columns(spark, monkeypatch):
    monkeypatch.setattr(checksums, "HELD", 600)
    rows = [(i, bytearray(v)) for i, v in enumerate(values())] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, v binary")
    got = {r.i: r for r in df.select("i", checksums.crc32c_of(F.col("v")).alias("c"), checksums.xxh3_of(F.col("v"), 7).alias("x")).collect()}
    for i, v in enumerate(values()):
        assert got[i].c == slow_crc(v) and got[i].x % 2**64 == xxhash.xxh3_64_intdigest(v, 7)
    assert got[-1].c is None and got[-1].x is None


def test_internal_keys_order_by_key_then_newest(spark):
    rows = [(k, s) for k in ("a", "b", "bb") for s in (0, 1, 255, 256, 2**62)]
    df = spark.createDataFrame(rows, "k string, seq long").withColumn("i", scalar.internal_key(F.col("k"), F.col("seq")))
    assert [(r.k, r.seq) for r in df.orderBy("i").collect()] == sorted(rows, key=lambda r: (r[0], -r[1]))
    short = spark.createDataFrame([(bytearray(b"\0" * 9),)], "i binary")
    r = short.select(scalar.key_of_internal(F.col("i")).alias("k"), scalar.seq_of_internal(F.col("i")).alias("s")).first()
    assert bytes(r.k) == b"\0" * 9 and r.s == 0
