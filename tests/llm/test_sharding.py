import zlib
from collections import Counter

from pyspark.sql import functions as F

from strandline.llm import sharding as S


def jump(key, n):
    """The published algorithm."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 7, -1, 10**12, 2**63 - 1, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 1000):
        got = {r.k: r.s for r in df.select("k", S.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_manifest(spark):
    rows = [(i, f"téxt {i % 7}", "s") for i in range(500)] + [(3, "same", "s")] * 300 + [(None, None, None), (9, "", "s"), (9, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = S.shard_manifest(df, 8, rows_per_bucket=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    by = {}
    for r in got:
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 8) and r.grown_shard == jump(r.doc_id or 0, 9)
        assert r.grown_shard in (r.shard, 8)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = S.shard_manifest(df.repartition(3), 8, rows_per_bucket=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert S.shard_manifest(df.limit(0)).count() == 0


def test_a_plan_without_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = S.shard_manifest(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
