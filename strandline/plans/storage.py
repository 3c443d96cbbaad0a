"""Queries on storage: written logs and tables, values kept apart, compaction's
choices, erasure coding, and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.api import Client
from strandline.functions import aggregates, checksums, erasure, scalar
from strandline.operators import blocks, compaction, gc, latest, lookup, partitions
from strandline.plans.catalogue import CURRENT, DOC_LOG, LOG, NEWEST, RANGES, ROUTED, TABLES, doc_log, event_tables
from strandline.plans.registry import query
from strandline.sources import log as logs
from strandline.sources import records
from strandline.sources.log import NOW, events_log, table
from strandline.sources.shared import Scratch
from strandline.streaming import ingest as streams

# writes


@query(
    "put_batches",
    f"""WITH a AS (SELECT 'c' || o_custkey AS k, max(o_orderpriority) AS v FROM orders GROUP BY 1),
b AS (SELECT 'c' || o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT a.k, CAST(CASE WHEN b.k IS NULL THEN 1 ELSE 2 END AS BIGINT) AS seq, coalesce(b.v, a.v) AS v,
       CAST(CASE WHEN b.k IS NULL THEN {NOW} + 3600 ELSE 0 END AS BIGINT) AS exp FROM a LEFT JOIN b ON a.k = b.k""",
)
def put_batches(spark, d):
    """A batch that expires, and a later one for some of its keys that does not."""
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey"
    )
    both = logs.puts(rows, 1, NOW, 3600).unionByName(logs.puts(rows.where("o_orderkey % 2 = 1"), 2, NOW))
    return latest.current(both).select("k", "seq", "v", "exp")


@query(
    "deleted_batch",
    f"WITH {CURRENT} SELECT k, seq, v FROM cur WHERE k NOT IN (SELECT printf('u%06d', c_custkey) FROM customer WHERE c_nationkey < 12)",
)
def deleted_batch(spark, d):
    """Deletes of keys that are there, and of some that are not."""
    log = events_log(spark, d)
    gone = table(spark, d, "customer").where("c_nationkey < 12").select(F.format_string("u%06d", "c_custkey").alias("k"))
    return latest.current(log.unionByName(logs.deletes(gone, 1 << 40))).select("k", "seq", "v")


CLIENT = """c AS (SELECT c_name AS k, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE c_mktsegment END AS v,
  c_custkey % 3 = 0 AS expires FROM customer)
, kept AS (SELECT k, v, expires FROM c WHERE NOT starts_with(k, 'Customer#00000001') UNION ALL SELECT 'two', 'y', true)"""


def client_of(spark, d):
    """A client's log after puts, puts that expire, and deletes by key and prefix."""
    rows = table(spark, d, "customer")
    client = Client(spark, Scratch(spark).folder())
    client.put_many(rows.select(F.col("c_name").alias("k"), F.col("c_mktsegment").alias("v")))
    client.put_many(rows.where("c_custkey % 3 = 0").select(F.col("c_name").alias("k"), F.lit("again").alias("v")), ttl_secs=10**9)
    client.batch_delete("Customer#00000001")
    client.put("one", "x")
    client.stream_put("two", "y", ttl_secs=10**9)
    client.delete("one")
    client.flush()
    return client


@query("client_log", f"WITH {CLIENT} SELECT * FROM kept")
def client_log(spark, d):
    live = latest.current(client_of(spark, d).log())
    return live.select("k", "v", (F.col("exp") > 0).alias("expires"))


@query("client_compacted", f"WITH {CLIENT} SELECT * FROM kept")
def client_compacted(spark, d):
    """The table that a compaction of that log writes, all of it."""
    table_ = client_of(spark, d).compact(Scratch(spark).folder()).log()
    return table_.select("k", "v", (F.col("exp") > 0).alias("expires"))


@query("sorted_table", f"WITH {LOG} SELECT k, seq, v, true AS in_order FROM log")
def sorted_table(spark, d):
    """A table written sorted, and whether each row stands where it should in
    its file."""
    path = Scratch(spark).folder()
    logs.write_sorted(events_log(spark, d), path, 4)
    rows = spark.read.parquet(path).select("k", "seq", "v", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    w = W.partitionBy("f").orderBy("i")
    k, seq = F.lag("k").over(w), F.lag("seq").over(w)
    ok = k.isNull() | (k < F.col("k")) | ((k == F.col("k")) & (seq > F.col("seq")))
    return rows.select("k", "seq", "v", ok.alias("in_order"))


@query(
    "wal_codec",
    f"""WITH {LOG}, s AS (SELECT *, seq // 1000 AS batch, 17 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS size FROM log)
SELECT batch, CAST(coalesce(sum(size) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       op, k, coalesce(v, '') AS v, exp FROM s""",
)
def wal_codec(spark, d):
    """Records written to one byte string a batch, and read back."""
    log = events_log(spark, d)
    record = F.struct("seq", F.hex(records.encoded(log)).alias("hex"))
    batches = log.groupBy(F.expr("seq div 1000").cast("string").alias("path")).agg(F.sort_array(F.collect_list(record)).alias("r"))
    data = batches.select("path", F.unhex(F.array_join(F.transform("r", lambda r: r.hex), "")).alias("content"))
    text = lambda c: F.decode(F.col(c), "UTF-8")
    return records.decoded(data).select(
        F.col("path").cast("long").alias("batch"), "offset", "op", text("key").alias("k"), text("value").alias("v"), "exp"
    )


@query(
    "bench_reports",
    """SELECT event_type AS name, count(*) AS ops, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1""",
)
def bench_reports(spark, d):
    """Results written as a report, and read from it."""
    e = table(spark, d, "events").withColumn("size", F.octet_length("props").cast("long"))
    found = aggregates.throughput(e, "event_type", "size", F.lit(1.0))
    result = F.struct(F.col("event_type").alias("name"), "ops", "bytes")  # one a kind of event
    path = Scratch(spark).folder()
    found.agg(F.collect_list(result).alias("results")).coalesce(1).write.json(path)
    return records.read_bench_reports(spark, path).select("name", "ops", "bytes")


@query(
    "internal_keys",
    f"""WITH {LOG} SELECT lower(hex(encode(k))) || '00' || lower(hex(CAST(18446744073709551615 - CAST(seq AS UBIGINT) AS UBIGINT))) AS internal,
  k, seq FROM log""",
)
def internal_keys(spark, d):
    key = scalar.internal_key(F.col("k"), F.col("seq"))
    rows = events_log(spark, d).select(key.alias("key"))
    return rows.select(
        F.lower(F.hex("key")).alias("internal"),
        F.decode(scalar.key_of_internal(F.col("key")), "UTF-8").alias("k"),
        scalar.seq_of_internal(F.col("key")).alias("seq"),
    )


CRC_STEP = "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 2197175160) ELSE x // 2 END"


@query(
    "crc32c",
    f"""WITH t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), {CRC_STEP}) AS c FROM range(256) r(i))
), e AS (SELECT event_id, user_id || props AS v FROM events WHERE props IS NOT NULL)
SELECT event_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(octet_length(encode(v))), lambda j: CAST(ord(substr(v, j + 1, 1)) AS BIGINT))),
  lambda s, b: xor(t[1 + xor(s % 256, b)], s // 256))) AS crc FROM e, t""",
)
def crc32c(spark, d):
    """Of ASCII texts."""
    e = table(spark, d, "events").where("props is not null")
    text = F.concat(F.col("user_id").cast("string"), "props")
    return e.select("event_id", checksums.crc32c_of(text).alias("crc"))


@query("xxh3_hashes")
def xxh3_hashes(spark, d):
    """The two hashes of every key that a filter in the stored format combines;
    DuckDB has none of them, a test has the library's."""
    keys = events_log(spark, d).select("k").distinct()
    return keys.select("k", checksums.xxh3_of(F.col("k")).alias("h1"), checksums.xxh3_of(F.col("k"), 0xC0FFEE42DEADBEEF).alias("h2"))


# values kept apart


def doc_values(spark, d):
    """Extents of the large values, each value where its pointer says."""
    rows = doc_log(spark, d).where("pointer is not null")
    value = F.struct("pointer.offset", F.hex(F.col("v").cast("binary")).alias("hex"))
    # an extent is as large as a store seals it: here 64 documents
    each = rows.groupBy(F.col("pointer.extent_id").alias("extent_id")).agg(F.sort_array(F.collect_list(value)).alias("x"))
    return each.select("extent_id", F.unhex(F.array_join(F.transform("x", lambda x: x.hex), "")).alias("data"))


@query("values_resolved", "SELECT doc_id, md5(text) AS v FROM documents")
def values_resolved(spark, d):
    """Every value, from its record or through its pointer."""
    inline = F.when(F.col("pointer").isNull(), F.col("v").cast("binary"))
    rows = lookup.resolved(doc_log(spark, d).withColumn("v", inline), doc_values(spark, d))
    return rows.select(F.col("seq").alias("doc_id"), F.md5("v").alias("v"))


@query(
    "extent_reads",
    f"""WITH {DOC_LOG}, x AS (SELECT extent_id, hex(encode(string_agg(text, '' ORDER BY doc_id))) AS data
  FROM docs JOIN documents ON doc_id = seq WHERE size > 4096 GROUP BY 1)
SELECT extent_id, substr(data, 201, 200) AS part, md5(unhex(substr(data, 8193))) AS rest FROM x""",
)
def extent_reads(spark, d):
    """Bytes of an extent from an offset: so many, and to the end."""
    x = doc_values(spark, d)
    part, rest = lookup.subrange(F.col("data"), 100, 100), lookup.subrange(F.col("data"), 4096, 0)
    return x.select("extent_id", F.hex(part).alias("part"), F.md5(rest).alias("rest"))


@query(
    "read_pieces",
    """SELECT doc_id, o * 1000 AS "offset", least(1000, octet_length(encode(text)) - o * 1000) AS length
FROM documents, LATERAL (SELECT unnest(range((octet_length(encode(text)) + 999) // 1000)) AS o)""",
)
def read_pieces(spark, d):
    """Values read piece by piece."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(lookup.pieces(F.col("text"), 1000)).alias("p")).select("doc_id", "p.offset", "p.length")


# compaction's choices


@query(
    "picked_tables",
    f"""WITH {TABLES}, t AS (SELECT table_id, table_id // 2 AS extent_id, raw_bytes, last_seq FROM tabs),
s AS (SELECT min(extent_id) AS first, count(*) AS n, sum(raw_bytes) AS total FROM t),
h AS (SELECT sum(raw_bytes) AS head, count(*) AS n_head FROM t, s WHERE extent_id = first)
SELECT table_id, CAST(CASE WHEN head < round(0.3 * total) THEN first + 1 ELSE 0 END AS BIGINT) AS cut_before
FROM (SELECT *, row_number() OVER (ORDER BY last_seq) AS place FROM t), s, h
WHERE n > 1 AND CASE WHEN head < round(0.3 * total) THEN n_head > 1 AND extent_id = first ELSE place <= 5 END""",
)
def picked_tables(spark, d):
    """Two tables lie in each extent; the choice is on the driver, over one row
    a table of a partition."""
    rows = event_tables(spark, d).orderBy("table_id").collect()
    chosen, cut = compaction.pick_tables([compaction.Table(r.table_id, r.table_id // 2, r.raw_bytes, r.last_seq) for r in rows])
    return spark.createDataFrame([(t.table_id, cut) for t in chosen], "table_id long, cut_before long")


@query(
    "compaction_skips",
    """SELECT n_nationkey, count(s_suppkey) < 2 AND NOT n_regionkey = 0 AS skips
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""",
)
def compaction_skips(spark, d):
    """Nations as partitions, suppliers as tables; a region's overlap."""
    n = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = n.groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").alias("tables"))
    return n.select("n_nationkey", compaction.skips(F.col("tables"), F.col("n_regionkey") == 0).alias("skips"))


CHUNK = 1500


@query(
    "chunk_emission",
    f"""WITH RECURSIVE {CURRENT}, r AS (
  SELECT {ROUTED} AS part, k, seq, 29 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS size,
         row_number() OVER (PARTITION BY {ROUTED} ORDER BY k, seq DESC) AS i FROM cur
), f AS (
  SELECT part, k, i, CAST(0 AS BIGINT) AS chunk, size AS held FROM r WHERE i = 1
  UNION ALL
  SELECT r.part, r.k, r.i, CASE WHEN f.held + r.size > {CHUNK} THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN f.held + r.size > {CHUNK} THEN r.size ELSE f.held + r.size END
  FROM f JOIN r ON r.part = f.part AND r.i = f.i + 1
)
SELECT part, k, chunk FROM f""",
)
def chunk_emission(spark, d):
    """What a compaction of each partition writes, cut into tables."""
    kept = compaction.major(events_log(spark, d))
    rows = blocks.chunk_rows(kept, partitions.route(kept, RANGES).cast("int"))
    packed = blocks.packed(rows, "part", ["k", "seq"], "size", CHUNK, 1 << 62)
    return packed.select("part", "k", F.col("block").alias("chunk"))


@query("discard_totals", f"WITH {DOC_LOG} SELECT extent_id, 2 * discarded AS discarded FROM dropped")
def discard_totals(spark, d):
    """Over two tables' maps."""
    each = compaction.discards(doc_log(spark, d))
    return gc.discard_totals(each.unionByName(each))


# erasure coding

SHARDS = """x AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, greatest((octet_length(encode(text)) + 7) // 4, 4) AS per
  FROM documents WHERE text IS NOT NULL)
, w AS (SELECT doc_id, per, h || repeat('00', CAST(4 * per - 4 - n AS BIGINT)) || printf('%08X', n) AS h FROM x)"""


def doc_shards(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", erasure.encoded(F.col("text").cast("binary"), 4, 2).alias("shards"))


@query(
    "erasure_shards",
    f"WITH {SHARDS} SELECT doc_id, i AS shard, md5(unhex(substr(h, CAST(2 * per * i + 1 AS BIGINT), CAST(2 * per AS BIGINT)))) AS data FROM w, range(4) t(i)",
)
def erasure_shards(spark, d):
    """The data shards of every document."""
    first = doc_shards(spark, d).select("doc_id", F.posexplode(F.slice("shards", 1, 4)).alias("shard", "data"))
    return first.select("doc_id", F.col("shard").cast("long").alias("shard"), F.md5("data").alias("data"))


@query("erasure_decoded", "SELECT doc_id, md5(text) AS data FROM documents WHERE text IS NOT NULL")
def erasure_decoded(spark, d):
    """Documents from what is left of their shards: two are lost, other ones
    from document to document."""
    lost = lambda s, i: F.when((i != F.col("doc_id") % 6) & (i != (F.col("doc_id") * 5 + 1) % 6), s)
    left = doc_shards(spark, d).select("doc_id", F.transform("shards", lost).alias("shards"))
    return left.select("doc_id", F.md5(erasure.decoded(F.col("shards"), 4, 2)).alias("data"))


@query(
    "erasure_reconstructed",
    f"WITH {SHARDS} SELECT doc_id, md5(unhex(substr(h, CAST(2 * per + 1 AS BIGINT), CAST(2 * per AS BIGINT)))) AS data FROM w",
)
def erasure_reconstructed(spark, d):
    """The second shard, when it and another one are lost."""
    lost = lambda s, i: F.when((i != 1) & (i != F.col("doc_id") % 6), s)
    left = doc_shards(spark, d).select("doc_id", F.transform("shards", lost).alias("shards"))
    return left.select("doc_id", F.md5(erasure.reconstructed(F.col("shards"), 4, 2, 1)).alias("data"))


@query(
    "shard_spans",
    """SELECT doc_id, n // 3 // per AS first, (n // 3 + n // 4) // per AS last FROM (
  SELECT doc_id, octet_length(encode(text)) AS n, greatest((octet_length(encode(text)) + 7) // 4, 4) AS per FROM documents)""",
)
def shard_spans(spark, d):
    """The shards that a middle part of each document touches."""
    n = F.octet_length("text").cast("long")
    third, quarter = F.floor(n / 3).cast("long"), F.floor(n / 4).cast("long")
    first, last = blocks.shard_span(third, quarter + 1, blocks.shard_size(n, 4))
    return table(spark, d, "documents").select("doc_id", first.alias("first"), last.alias("last"))


# streams


def mutation_files(spark, d):
    """Folders of files of the log, its halves by turns, for a stream to read."""
    log = events_log(spark, d)
    return [log.where(F.col("seq") % 2 == i).repartition(3).select(*logs.LOG_COLUMNS) for i in (1, 0)]


@query("stream_ingested", f"WITH {LOG} SELECT k, seq, op, v, exp FROM log")
def stream_ingested(spark, d):
    """A stream's table after it stopped, new files came, and it went on from
    its checkpoint: no record is lost or there twice."""
    scratch = Scratch(spark)
    source, out, checkpoint = (scratch.folder() for _ in range(3))
    for part in mutation_files(spark, d):
        part.write.mode("append").parquet(source)
        streams.ingest(streams.read_mutations(spark, source, 2), out, checkpoint).awaitTermination()
    return spark.read.schema(streams.SCHEMA).parquet(out)


@query("stream_latest", f"WITH {CURRENT} SELECT * FROM cur")
def stream_latest(spark, d):
    """Newest versions kept as a stream's state, over a restart; expiry is
    tested when they are read."""
    scratch = Scratch(spark)
    source, out, checkpoint = (scratch.folder() for _ in range(3))
    for part in mutation_files(spark, d):
        part.write.mode("append").parquet(source)
        streams.latest_state(streams.read_mutations(spark, source), out, checkpoint).awaitTermination()
    changed = spark.read.schema(streams.SCHEMA).parquet(f"{out}/batch=*")
    return latest.newest_by_max(changed).where(latest.visible()).select("k", "seq", "v", "exp")


@query("without_replays", f"WITH {LOG} SELECT k, seq, op FROM log")
def without_replays(spark, d):
    """A log of which a part arrived twice."""
    log = events_log(spark, d)
    return streams.without_replays(log.unionByName(log.where("seq % 3 = 0"))).select("k", "seq", "op")


@query("newest_before_expiry", f"WITH {NEWEST} SELECT k, seq, exp <> 0 AND exp <= {NOW} AS expired FROM newest WHERE op <> 2")
def newest_before_expiry(spark, d):
    """A newest version that expired hides older ones that did not."""
    newest = latest.newest(events_log(spark, d)).where(F.col("op") != logs.DELETE)
    return newest.select("k", "seq", (~latest.not_expired()).alias("expired"))
