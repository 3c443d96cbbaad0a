import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandline import Client
from strandline.api import InvalidArgument, NotFound
from strandline.operators.latest import newest
from strandline.sources.log import LOG_COLUMNS
from strandline.streaming import ingest


def test_client(spark, tmp_path):
    kv = Client(spark, str(tmp_path / "log"))
    assert kv.range() == ([], False) and kv.head("a") == (False, 0)
    kv.put("a/1", "one")
    kv.put("a/2", "two")
    kv.put("a/1", "uno")
    kv.put("b", "gone soon", ttl_secs=1000)
    kv.put_many(spark.createDataFrame([(f"c/{i}", f"v{i}") for i in range(5)], "k string, v string"))
    assert kv.get("a/1") == "uno" and kv.get_range("a/1", 1, 1) == "n" and kv.head("a/2") == (True, 3)
    assert kv.range("a/") == (["a/1", "a/2"], False) and kv.range("c/", limit=5)[1] is True and kv.range(limit=0) == ([], True)
    kv.delete("a/1")
    kv.delete("never there")
    with pytest.raises(NotFound):
        kv.get("a/1")
    with pytest.raises(InvalidArgument):
        kv.put("", "x")
    assert kv.batch_delete("c/") == 5 and kv.batch_delete("c/") == 0
    after = kv.compact(str(tmp_path / "sorted"))
    assert after.range() == (["a/2", "b"], False) == kv.range() and after.log().count() == 2
    assert kv.split_key() == "b"
    kept = kv.compact(str(tmp_path / "minor"), major=False)
    assert kept.range() == kv.range() and kept.log().where("op = 2").count() == 7
    found = kv.get_many(spark.createDataFrame([("b",), ("x",)], "k string"))
    assert {r.k: r.found for r in found.collect()} == {"b": True, "x": False}


def test_bytes(spark, tmp_path):
    kv = Client(spark, str(tmp_path / "log"), binary=True)
    image = bytes(range(256)) * 3
    kv.put(b"a\xff\x00", image)
    kv.put(b"a\xff\xff", "é".encode())
    kv.put(b"b", b"", ttl_secs=1000)
    kv.put_many(spark.createDataFrame([(bytearray(b"c\x00"), bytearray(b"\xfe"))], "k binary, v binary"))
    assert kv.get(b"a\xff\x00") == image and kv.get_range(b"a\xff\x00", 250, 12) == image[250:262]
    assert kv.head(b"a\xff\xff") == (True, 2) and kv.get(b"b") == b""
    assert kv.range(b"a\xff") == ([b"a\xff\x00", b"a\xff\xff"], False) and kv.range(start=b"b")[0] == [b"b", b"c\x00"]
    kv.delete(b"b")
    assert kv.batch_delete(b"a\xff\xff") == 1
    after = kv.compact(str(tmp_path / "sorted"))
    assert after.range()[0] == [b"a\xff\x00", b"c\x00"] == kv.range()[0] and after.get(b"c\x00") == b"\xfe"
    with pytest.raises(NotFound):
        after.get(b"b")


def test_several_writers(spark, tmp_path, monkeypatch):
    """No two writes have one number, and the last one wins, whatever the clocks say."""
    path = str(tmp_path / "log")
    writers = [Client(spark, path) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        numbers = [n for got in pool.map(lambda w: [w._seq() for _ in range(20)], writers) for n in got]
    assert len(set(numbers)) == 60
    monkeypatch.setattr("strandline.api.KEPT_CLAIMS", 5)
    for i, w in enumerate(writers * 4):
        monkeypatch.setattr(time, "time", lambda at=10**9 - i: at)
        w.put("k", f"v{i}")
    monkeypatch.undo()
    assert writers[0].get("k") == "v11"
    assert max(r.seq for r in writers[1].log().collect()) == writers[2]._seq() - 1
    again = writers[0].compact(str(tmp_path / "sorted"))
    again.put("k", "later")
    assert Client(spark, again.path).get("k") == "later"


def test_streams_agree_with_batches(spark, tmp_path):
    def feed(rows, name):
        df = spark.createDataFrame(rows, ingest.SCHEMA)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return df

    first = [("a", 1, 1, "x", 0), ("b", 2, 1, "y", 0), ("a", 3, 2, "", 0)]
    second = [("a", 3, 2, "", 0), ("b", 5, 1, "z", 0), ("c", 4, 1, "w", 9)]  # a replay among them
    feed(first, "1")
    stream = ingest.read_mutations(spark, str(tmp_path / "in" / "*"))
    run = lambda f, *a: f(stream, *map(str, a)).awaitTermination()
    run(ingest.ingest, tmp_path / "log", tmp_path / "cp1")
    run(ingest.latest_state, tmp_path / "state", tmp_path / "cp2")
    feed(second, "2")
    run(ingest.ingest, tmp_path / "log", tmp_path / "cp1")
    run(ingest.latest_state, tmp_path / "state", tmp_path / "cp2")
    log = spark.read.schema(ingest.SCHEMA).parquet(str(tmp_path / "log"))
    assert log.count() == 6 and ingest.without_replays(log).count() == 5
    state = spark.read.parquet(str(tmp_path / "state")).drop("batch").select(*LOG_COLUMNS)
    want = sorted(map(tuple, newest(ingest.without_replays(log)).select(*LOG_COLUMNS).collect()))
    assert sorted(map(tuple, newest(state.dropDuplicates(["k", "seq"])).collect())) == want
    assert state.where(F.col("k") == "b").count() == 2 and time
