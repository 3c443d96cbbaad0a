"""Mutation logs: what is visible, and what stays true of any log."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import compaction, gc, latest, lookup, partitions
from strandline.sources import log as logs

NOW = 1000
SCHEMA = "k string, seq long, op int, v string, exp long"


def random_log(seed, n=300, keys=40):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = logs.DELETE if rng.random() < 0.2 else logs.PUT
        exp = rng.choice([0, 0, 0, 500, 999, 1000, 1001, 5000])
        rows.append((f"k{rng.randrange(keys):03}", seq, op, "" if op == logs.DELETE else f"v{seq}", exp))
    rng.shuffle(rows)
    return rows


def live(rows, now=NOW):
    newest = {}
    for r in sorted(rows, key=lambda r: r[1]):
        newest[r[0]] = r
    return {k: r for k, r in newest.items() if r[2] != logs.DELETE and (r[4] == 0 or r[4] > now)}


def as_dict(df):
    return {r.k: tuple(r[c] for c in logs.LOG_COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_invariants_of_random_logs(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA).cache()
    want = live(rows)
    assert as_dict(latest.current(log, NOW)) == want
    assert as_dict(latest.newest_by_max(log)) == as_dict(latest.newest(log))
    major = compaction.major(log, now=NOW)
    assert as_dict(latest.current(major, NOW)) == want
    assert as_dict(compaction.major(major, now=NOW)) == want
    minor = compaction.minor(log)
    assert as_dict(compaction.major(minor, now=NOW)) == want
    assert minor.where(F.col("op") == logs.DELETE).count() > 0
    s = compaction.stats(log, now=NOW).first()
    assert s.n_kept + s.n_discarded == s.n_in == len(rows) and s.n_kept == len(want)
    mid = partitions.split_key(latest.current(log, NOW).select("k"))
    keys = sorted(want)
    assert mid == keys[len(keys) // 2]
    pages, last = [], ""
    while page := [r.k for r in lookup.page_after(log, last, 7, now=NOW).collect()]:
        pages += page
        last = page[-1]
    assert pages == keys


def test_filters_come_after_the_newest_version(spark):
    rows = [("a", 1, 1, "x", 0), ("a", 2, 2, "", 0), ("b", 1, 1, "x", 0), ("b", 2, 1, "y", NOW), ("c", 1, 1, "x", NOW + 1)]
    log = spark.createDataFrame(rows, SCHEMA)
    assert [r.k for r in latest.current(log, NOW).collect()] == ["c"]
    wrong = latest.newest(log.where(latest.visible(NOW)))
    assert wrong.count() == 3


def test_plan_of_a_lookup(spark, tmp_path):
    path = str(tmp_path / "t")
    logs.write_sorted(spark.createDataFrame(random_log(1), SCHEMA), path, 3)
    log = spark.read.schema(SCHEMA).parquet(path)
    plan = lookup.range_keys(log, "k01", "k012", now=NOW)._jdf.queryExecution().toString()
    assert "StringStartsWith(k,k01)" in plan and "GreaterThanOrEqual(k,k012)" in plan and "LessThan(k,k02)" in plan
    plan = latest.current(log, NOW)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    keys = [r.k for r in log.select("k").collect()]
    assert len(keys) == 300


def test_lookups(spark):
    rows = [(f"key-{i:02}", i + 1, 1, f"val-{i}", 0) for i in range(30)] + [("key-03", 100, 2, "", 0)]
    log = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([("key-01",), ("key-03",), ("nope",)], "k string")
    got = {r.k: (r.found, r.v) for r in lookup.get_many(log, asked, NOW).collect()}
    assert got == {"key-01": (True, "val-1"), "key-03": (False, None), "nope": (False, None)}
    assert {r.k: r.value_length for r in lookup.head(log, NOW).collect()}["key-10"] == 6
    assert [r.k for r in lookup.seek(log, "key-03").collect()] == ["key-03"]
    assert lookup.seek(log, "key-03").first().seq == 100
    assert lookup.exists(asked, log, "k").count() == 2
    sources = {r.source: r.lookups for r in lookup.read_source(log, F.lit("table"), asked, NOW).collect()}
    assert sources == {"table": 1, "miss": 2}


@pytest.mark.parametrize("offset, length, want", [(0, 0, b"hello world"), (6, 5, b"world"), (6, 50, b"world"), (11, 3, b""), (99, 0, b""), (3, 0, b"lo world")])
def test_subrange_of_stored_and_pointed_values(spark, offset, length, want):
    df = spark.createDataFrame([(bytearray(b"hello world"),)], "v binary")
    assert bytes(df.select(lookup.subrange(F.col("v"), offset, length)).first()[0]) == want


def test_prefix_end():
    assert logs.prefix_end("abc") == "abd" and logs.prefix_end("a\U0010ffff") == "b" and logs.prefix_end("") is None
    assert logs.prefix_end("\U0010ffff") is None and logs.prefix_end("퟿") == ""


def test_large_values(spark):
    from strandline.operators.blocks import pointers

    rows = [("a", 1, 1, "x" * 4096, 0), ("a", 2, 1, "y" * 4097, 0), ("b", 3, 1, "z" * 5000, 0), ("b", 4, 1, "w" * 6000, 0)]
    log = pointers(spark.createDataFrame(rows, SCHEMA), "v", F.lit(7), "seq").cache()
    p = {r.seq: r.pointer and tuple(r.pointer) for r in log.collect()}
    assert p == {1: None, 2: (7, 0, 4097), 3: (7, 4097, 5000), 4: (7, 9097, 6000)}
    data = spark.createDataFrame([(7, bytearray(b"y" * 4097 + b"z" * 5000 + b"w" * 6000))], "extent_id long, data binary")
    apart = log.withColumn("v", F.when(F.col("pointer").isNull(), F.col("v").cast("binary")))
    whole = {r.seq: bytes(r.v).decode() for r in lookup.resolved(apart, data).collect()}
    assert whole == {r[1]: r[3] for r in rows}
    assert [tuple(r) for r in compaction.discards(log, now=NOW).collect()] == [(7, 5000)]
    again = gc.rewrite(log, 7, 100, NOW).collect()
    assert {r.k for r in again} == {"a", "b"} and min(r.seq for r in again) >= 100 and all(r.rewritten for r in again)
    assert {r.seq for r in gc.still_live(log, 7, NOW).collect()} == {2, 4}


def test_gc_takes_three_before_the_ratio(spark):
    discards = spark.createDataFrame([(1, 90), (2, 80), (3, 70), (4, 60), (1, 10)], "extent_id long, discarded long")
    sizes = spark.createDataFrame([(1, 1000), (2, 100), (3, 175), (4, 61)], "extent_id long, sealed_length long")
    got = gc.candidates(gc.discard_totals(discards), sizes)
    assert [r.extent_id for r in got.collect()] == [2]  # 1 and 3 are not beyond 0.4, 4 is not among three
    asked = spark.createDataFrame([(0, 9), (1, 2), (2, 1), (3, 4), (4, 3)], "pos int, extent_id long")
    assert [r.extent_id for r in gc.forced(asked, sizes).collect()] == [2, 1, 4]
    members = spark.createDataFrame([(1,), (1,)], "extent_id long")
    assert [tuple(r) for r in gc.pending(discards, members).collect()] == [(1, 100)]


def T(i, extent, mib, seq):
    return compaction.Table(i, extent, mib << 20, seq)


def test_table_choice():
    def pick(*tables):
        chosen, extent = compaction.pick_tables(list(tables))
        return [t.table_id for t in chosen], extent

    assert pick(T(1, 1, 10, 1)) == ([], 0)
    # the first extent holds little: its tables and what lies between go, and it can be cut
    assert pick(T(1, 1, 10, 1), T(2, 2, 300, 3), T(3, 1, 10, 5), T(4, 3, 300, 7)) == ([1, 2, 3], 2)
    assert pick(T(1, 1, 10, 9), T(2, 2, 300, 3)) == ([], 0)
    # else small tables by seq, with one older neighbour that fits
    assert pick(T(1, 1, 200, 1), T(2, 1, 100, 2), T(3, 1, 100, 3), T(4, 1, 600, 4)) == ([1, 2, 3], 0)
    assert pick(T(1, 1, 500, 1), T(2, 1, 100, 2), T(3, 1, 600, 3)) == ([], 0)
    assert pick(T(1, 1, 500, 1), T(2, 1, 100, 2), T(3, 1, 300, 3)) == ([2, 3], 0)
    assert pick(*[T(i, 1, 10, i) for i in range(9)]) == ([0, 1, 2, 3, 4], 0)
    assert compaction.skips(1, False) and not compaction.skips(1, True) and not compaction.skips(2, False)


def test_expired_tables(spark):
    rows = [("a", 1, 1, "x", 0), ("b", 2, 1, "x", 700), ("c", 3, 1, "x", 1500), ("d", 4, 1, "x", 1200)]
    log = spark.createDataFrame([(*r, 1 if r[1] < 3 else 2) for r in rows], SCHEMA + ", table_id int")
    props = compaction.table_properties(log)
    assert {r.table_id: r.min_expires_at for r in props.collect()} == {1: 700, 2: 1200}
    assert [r.table_id for r in compaction.due_for_major(props, NOW).collect()] == [1]
    assert [r.table_id for r in compaction.overlapping(props, "c", "").collect()] == [1]


def test_recovery(spark):
    rows = random_log(4)
    log = spark.createDataFrame(rows, SCHEMA)
    both = logs.recovered(log.where("seq <= 200"), log)
    assert sorted(map(tuple, both.collect())) == sorted(rows)
    m = spark.createDataFrame([(1, 1, True, [1]), (1, 2, True, [1, 2]), (1, 3, False, [9]), (2, 1, True, [5])], "part_id int, version int, valid boolean, tables array<int>")
    assert sorted((r.part_id, r.table_id) for r in logs.manifest_newest(m).collect()) == [(1, 1), (1, 2), (2, 5)]
