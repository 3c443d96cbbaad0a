"""Blocks, records, shards, files and scalar functions."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strandline.functions import aggregates, erasure, scalar
from strandline.operators import blocks, files
from strandline.plans import catalogue
from strandline.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_records_stop_at_the_cut(spark, tmp_path):
    rows = [(1, b"k\x00", b"v", 0), (2, b"", b"", 7), (1, b"key", b"x" * 5000, 2**40)]
    data = b"".join(records.encode_record(*r) for r in rows)
    assert len(records.encode_record(1, b"ab", b"c")) == 20
    got = list(records.decode_records(data))
    assert [g[1:] for g in got] == rows and got[1][0] == 20
    assert len(list(records.decode_records(data[:-1]))) == 2
    (tmp_path / "a.log").write_bytes(data[:-1])
    df = records.read_record_files(spark, str(tmp_path))
    assert [(r.offset, r.op, bytes(r.key)) for r in df.orderBy("offset").collect()] == [(0, 1, b"k\x00"), (20, 2, b"")]


def test_bench_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"name": "write", "ops": 5}]}')
    (tmp_path / "b.json").write_text('[{"name": "read", "ops": 7}]')
    for f, want in (("a", ("write", 5)), ("b", ("read", 7))):
        r = records.read_bench_reports(spark, str(tmp_path / f"{f}.json")).first()
        assert (r.name, r.ops) == want


@pytest.mark.parametrize("k, m", [(1, 1), (3, 2), (4, 3)])
@pytest.mark.parametrize("size", [0, 1, 3, 4, 100, 1001])
def test_any_lost_shards_come_back(k, m, size):
    payload = random.Random(size).randbytes(size)
    shards = erasure.encode(payload, k, m)
    assert {len(s) for s in shards} == {erasure.shard_bytes(size, k)} and len(shards) == k + m
    for lost in itertools.combinations(range(k + m), m):
        left = [None if i in lost else s for i, s in enumerate(shards)]
        assert erasure.decode(left, k, m) == payload
        assert erasure.reconstruct(left, k, m, lost[0]) == shards[lost[0]]
    with pytest.raises(ValueError):
        erasure.decode([None] * (m + 1) + shards[m + 1 :], k, m)


def test_shards_in_columns(spark):
    df = spark.createDataFrame([(bytearray(b"hello world"),), (bytearray(b""),)], "v binary")
    shards = df.withColumn("s", erasure.encoded(F.col("v"), 3, 2))
    data = blocks.data_shards(F.col("v"), F.length("v").cast("long"), 3)
    for r in shards.withColumn("d", data).collect():
        assert [bytes(x) for x in r.s[:3]] == [bytes(x) for x in r.d]
    lost = F.transform("s", lambda s, i: F.when(i > 1, s))
    assert shards.where(erasure.decoded(lost, 3, 2) != F.col("v")).count() == 0
    assert one(spark, blocks.shard_size(F.lit(0), 4)) == 4 and one(spark, blocks.shard_size(F.lit(13), 4)) == 5
    first, last = blocks.shard_span(F.lit(9), F.lit(2), F.lit(5))
    assert (one(spark, first), one(spark, last)) == (1, 2)


def test_greedy_packing(spark):
    sizes = [40, 50, 30, 200, 10, 10, 10, 10]
    df = spark.createDataFrame([(1, f"k{i}", 1, s) for i, s in enumerate(sizes)], "table_id int, k string, seq long, size long")
    got = {r.k: r.block for r in blocks.packed(df, "table_id", ["k", "seq"], "size", 100, 3).collect()}
    assert [got[f"k{i}"] for i in range(8)] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_files(spark):
    text = bytes(range(256)) * 5
    f = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b""))], "ino long, v binary")
    chunks = files.chunked(f, "v", 100).cache()
    assert chunks.count() == 13
    inodes = spark.createDataFrame([(1, len(text)), (2, 0)], "ino long, size long")
    for offset, size in ((0, 5), (95, 10), (100, 100), (1250, 500), (0, 2000)):
        got = {r.ino: bytes(r.data) for r in files.read(inodes, chunks, offset, size, 100).collect()}
        assert got == {1: text[offset : offset + size]}
    holes = chunks.where("chunk <> 1")
    assert bytes(files.read(inodes, holes, 90, 120, 100).first().data) == text[90:100] + bytes(100) + text[200:210]
    w = spark.createDataFrame([(1, 195, bytearray(b"X" * 120)), (2, 150, bytearray(b"new"))], "ino long, offset long, data binary")
    after = files.overwritten(chunks, w, 100)
    assert after.agg(F.max(F.octet_length("data"))).first()[0] == 100
    assert bytes(files.read(inodes, after, 0, 2000, 100).where("ino = 1").first().data) == text[:195] + b"X" * 120 + text[315:]
    assert bytes(after.where("ino = 2").first().data) == bytes(50) + b"new"
    cut = files.truncated(chunks, 1, 250, 100)
    assert sorted((r.chunk, len(r.data)) for r in cut.collect()) == [(0, 100), (1, 100), (2, 50)]
    assert files.truncated(chunks, 1, 200, 100).count() == 2


def test_a_large_directory_is_numbered_in_ranges(spark):
    names = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).when(F.col("id") < 2900, F.col("id") % 50).cast("long").alias("parent"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
        (F.col("id") + 100).alias("ino"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listing = files.readdir(names).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for r in sorted(names.collect(), key=lambda r: r.name):
        want.setdefault(r.parent, []).append((r.name, r.ino))
    assert {None, 7} < set(want)
    for parent, entries in want.items():
        got = sorted((r.offset, r.name, r.ino) for r in listing if r.parent == parent and r.offset > 2)
        assert got == [(i, *e) for i, e in enumerate(entries, 3)]


def test_directories(spark):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "x", 4)], "parent long, name string, ino long")
    i = spark.createDataFrame([(2, True), (3, False), (4, False)], "ino long, is_dir boolean")
    got = sorted(map(tuple, files.readdir(d).where("parent = 1").collect()), key=lambda r: r[3])
    assert got == [(1, ".", 1, 1), (1, "..", 1, 2), (1, "a", 3, 3), (1, "b", 2, 4)]
    assert [r.ino for r in files.readdir(d).where("parent = 2 and name = '..'").collect()] == [1]
    assert [r.ino for r in files.resolve_path(d, "/b/x").collect()] == [4] and files.resolve_path(d, "/b/y").count() == 0
    assert files.lookup(d, i, 1, "b").first().is_dir
    names = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz")], "parent long, name string")
    errors = lambda df: {r.name: r.error for r in df.collect()}
    assert errors(files.removed(d, i, names)) == {"a": None, "b": "EISDIR", "zz": "ENOENT"}
    assert errors(files.removed(d, i, names, directories=True)) == {"a": "ENOTDIR", "b": "ENOTEMPTY", "zz": "ENOENT"}
    assert errors(files.created(d, names.withColumn("ino", F.lit(9)))) == {"a": "EEXIST", "b": "EEXIST", "zz": None}
    moved, gone = files.renamed(d, 1, "a", 2, "x")
    assert sorted(map(tuple, moved.collect())) == [(1, "b", 2), (2, "x", 3)] and [r.ino for r in gone.collect()] == [4]
    same, gone = files.renamed(d, 1, "a", 1, "a")
    assert same.count() == 3 and gone.count() == 0


def test_path_lookup_goes_through_the_operators(spark, monkeypatch):
    from strandline.plans import catalogue

    called = []
    for name in ("lookup", "resolve_path"):
        monkeypatch.setattr(files, name, lambda *a, f=getattr(files, name), n=name: called.append(n) or f(*a))
    assert catalogue.queries()["path_lookup"](spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(called) == ["lookup", "resolve_path"]
    monkeypatch.setattr(files, "resolve_path", lambda dirents, path: dirents.select("ino").limit(0))
    assert catalogue.queries()["path_lookup"](spark, "/root/testdata/sf0.001").count() == 0


def test_long_keys_order_as_numbers(spark):
    n = [0, 1, 255, 256, 2**40, 2**62]
    df = spark.createDataFrame([(x, y) for x in n for y in n], "a long, b long").withColumn("k", scalar.long_key(2, F.col("a"), F.col("b")))
    rows = df.orderBy("k").collect()
    assert [(r.a, r.b) for r in rows] == sorted((x, y) for x in n for y in n)
    back = df.where(scalar.long_from_key(F.col("k"), 0) != F.col("a")).count() + df.where(scalar.long_from_key(F.col("k"), 1) != F.col("b")).count()
    assert back == 0


def test_scalars(spark):
    x = lambda c: one(spark, c)
    assert x(scalar.human_size(F.lit(1023))) == "1023 B" and x(scalar.human_size(F.lit(1536))) == "1.5 KB"
    assert x(scalar.human_size(F.lit(3 << 30))) == "3.0 GB" and x(scalar.hex_key(F.lit(255))) == "000000ff"
    assert x(scalar.extension(F.lit("a.B.JPG"))) == "jpg" and x(scalar.extension(F.lit("none"))) == ""
    assert x(scalar.media_kind(F.lit("a.MP4"))) == "video" and x(scalar.mode_kind(F.lit(0o040755))) == "directory"
    assert x(scalar.with_permissions(F.lit(0o100644), F.lit(0o600))) == 0o100600
    assert tuple(x(scalar.replication(F.lit("4+2")))) == (4, 2) and x(scalar.replication(F.lit("4+x"))) is None
    assert tuple(x(scalar.replication(F.lit("3")))) == (3, 0) and x(scalar.shard_of(F.lit(17), 5)) == 2
    assert x(scalar.common_prefix(F.lit("abcd"), F.lit("abx"))) == 2 and x(scalar.common_prefix(F.lit(""), F.lit("a"))) == 0
    assert x(aggregates.average_ms(F.lit(3_000_000), F.lit(2))) == 1.5 and x(aggregates.average_ms(F.lit(0), F.lit(0))) == 0


def test_sizes_of_any_number(spark):
    """Sizes over 64 bits, and those whose shortest digits look like a tie."""
    n = [1280, 1792, 1048575, 5 << 28, 2**53 + 1, 1231429**3, 2097151**3, 9_000_000**3]
    n += [(x << 30) + round(y * 2**30) for x in range(1 << 20, (1 << 20) + 3) for y in (0.05, 0.15, 0.25, 0.35, 0.95)]
    df = spark.createDataFrame([(Decimal(x),) for x in n], "n decimal(38,0)")

    def want(x):
        bits, unit = next((b, u) for b, u in ((30, "GB"), (20, "MB"), (10, "KB")) if x >= 1 << b)
        return f"{float(x) / (1 << bits):.1f} {unit}"

    assert [r.s for r in df.select(scalar.human_size(F.col("n")).alias("s")).collect()] == list(map(want, n))


def test_human_sizes_of_large_keys(spark, tmp_path):
    spark.range(2_097_150, 2_097_155).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.size for r in catalogue.queries()["human_sizes"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{k**3 / 2**30:.1f} GB" for k in range(2_097_150, 2_097_155)}


def test_percentiles_of_many_values(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.random(), round(rng.random(), 1)])) for g in "ab" for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p0, r.p37, r.p99, r.p100) for r in aggregates.nearest_ranks(df, "g", "v", [0, 37, 99, 100], 16).collect()}
    for g in "ab":
        s = sorted(v for h, v in rows if h == g)
        assert got[g] == (s[0], s[37 * 40], s[99 * 40], s[-1])


def test_hex_keys_over_32_bits(spark):
    n = [0, 255, 2**32 - 1, 2**32, 70000 * 65536, 2**62]
    df = spark.createDataFrame([(x,) for x in [*n, None]], "n long")
    assert [r.k for r in df.select(scalar.hex_key(F.col("n")).alias("k")).collect()] == [f"{x:08x}" for x in n] + [None]


@pytest.mark.parametrize("n", [30, 60000])
def test_bloom_filters(spark, monkeypatch, n):
    """No key is missed, few others are hit, by blocks sent to all tasks and by
    blocks that keys are dealt to; a key reads a word for each of its places."""
    keys = spark.range(n).select(F.format_string("k%d", "id").alias("k"))
    others = spark.range(20000).select(F.format_string("other%d", "id").alias("k"))
    bits, hashes = scalar.bloom_shape(n, 0.01)
    for most in (scalar.BLOOM_BROADCAST, 0):
        monkeypatch.setattr(scalar, "BLOOM_BROADCAST", most)
        filter_ = scalar.bloom_built(keys, bits, hashes)
        assert filter_.select(F.max(F.size("words"))).first()[0] <= scalar.BLOOM_BLOCK // 64
        assert scalar.bloom_asked(keys, filter_, bits, hashes).where("not hit").count() == 0
        assert scalar.bloom_asked(others, filter_, bits, hashes).where("hit").count() <= 0.02 * 20000


def test_derived_keys(spark):
    keys = ["v.mp4", ".hls/v.mp4/index.m3u8", ".hls/v.mp4/0.ts", ".thumb/320/v.mp4", "w.mp4", ".thumb/64/w.mp4"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    names = spark.createDataFrame([("v.mp4",), ("v.mp4",), ("x",)], "name string")
    assert sorted(r.k for r in files.derived(df, names).collect()) == sorted(keys[:4])


def test_attributes(spark):
    i = spark.createDataFrame([(1, 2, 0o755), (2, 2, 0o700)], "ino long, nlink long, mode int")
    made = spark.createDataFrame([(1, "a", 3), (1, "b", 4)], "parent long, name string, ino long")
    assert sorted(map(tuple, files.with_subdirectories(i, made).collect())) == [(1, 4, 0o755), (2, 2, 0o700)]
    c = spark.createDataFrame([(2, 0o644, None)], "ino long, mode int, nlink long")
    assert sorted(map(tuple, files.with_attributes(i, c).collect())) == [(1, 2, 0o755), (2, 2, 0o644)]


def test_texts(spark):
    assert one(spark, scalar.json_text(F.lit('a"b\\c\nd\x01é'))) == '"a\\"b\\\\c\\nd\\u0001é"'
    assert one(spark, scalar.load_key(F.lit("3fffffff"), "w", F.lit(2), F.lit(9))) == "3fffffff!w_2_9"


def test_nearest_ranks_and_ema(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, -1.0, 4.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("none", 0, None)], "g string, i long, v double")
    got = {r.g: (r.p0, r.p50, r.p100) for r in aggregates.nearest_ranks(df, "g", "v", [0, 50, 100]).collect()}
    assert got == {"g": (-1.0, 3.0, 9.0), "none": (0.0, 0.0, 0.0)}
    e = None
    for v in values:
        if v > 0:
            e = v if e is None else e * 0.7 + v * 0.3
    assert aggregates.ema(df, "g", "i", "v").first().ema == pytest.approx(e)


@pytest.mark.parametrize("group", ["a", None])
def test_percentiles_cut_once(spark, monkeypatch, group):
    """Approximate quantiles that come out otherwise each time they are asked
    for, as they may on several executors, change no percentile."""
    approx = F.percentile_approx
    chance = F.expr("cast(reflect('java.lang.Math', 'random') AS double)")
    noise = lambda v, steps, accuracy: F.transform(approx(v, steps, accuracy), lambda c: c + chance)
    monkeypatch.setattr(aggregates.F, "percentile_approx", noise)
    df = spark.range(1000).select(F.lit(group).cast("string").alias("g"), (F.col("id") / 1000).alias("v"))
    for _ in range(3):
        got = {r.g: (r.p0, r.p50, r.p99) for r in aggregates.nearest_ranks(df, "g", "v", [0, 50, 99], 16).collect()}
        assert got == {group: (0.0, 0.5, 0.99)}


def test_ema_of_any_alpha(spark):
    rng = random.Random(2)
    values = [rng.random() + 0.1 for _ in range(5000)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i long, v double")
    for alpha in (0.001, 0.01, 0.3, 0.999, 1.0):
        e = values[0]
        for v in values[1:]:
            e = e * (1 - alpha) + v * alpha
        assert aggregates.ema(df, "g", "i", "v", alpha).first().ema == pytest.approx(e, rel=1e-12)
    one_ = aggregates.ema(df.limit(1), "g", "i", "v", 0.25).first().ema
    assert one_ == pytest.approx(values[0]) and aggregates.ema(df.limit(0), "g", "i", "v").count() == 0
    for alpha in (0, 1.5):
        with pytest.raises(ValueError):
            aggregates.ema(df, "g", "i", "v", alpha)


def test_encoded_records(spark):
    rows = [("a", 1, "v", 0), ("é", 2, None, 7), ("k", 1, "x" * 300, 2**40)]
    df = spark.createDataFrame(rows, "k string, op int, v string, exp long")
    got = [bytes(r.b) for r in df.select(records.encoded(df).alias("b")).collect()]
    assert got == [records.encode_record(op, k.encode(), (v or "").encode(), exp) for k, op, v, exp in rows]


def test_json_text_of_any_line(spark):
    assert one(spark, scalar.json_text(F.lit("a\u2028b\u0085"))) == '"a\u2028b\u0085"'
    assert one(spark, scalar.json_text(F.lit(None).cast("string"))) is None
