"""Queries on a store's metadata: partitions, streams, extents, servers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import aggregates, scalar
from strandline.operators import cluster, files, partitions
from strandline.plans import catalogue
from strandline.plans.catalogue import CURRENT, RANGES, ROUTED, line_members
from strandline.plans.registry import oracle_sql, query
from strandline.sources.log import NOW, events_log, table

MEMBERS = "m AS (SELECT l_orderkey AS stream_id, l_linenumber AS pos, l_partkey AS extent_id FROM lineitem)"


def part_extents(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("extent_id"), F.col("p_size").cast("long").alias("length"))


@query("live_keys", f"WITH {CURRENT} SELECT {ROUTED} AS part, count(*) AS keys FROM cur GROUP BY 1")
def live_keys(spark, d):
    return partitions.live_keys(events_log(spark, d), RANGES)


@query(
    "route_many",
    """WITH r AS (SELECT p_partkey AS part, p_partkey AS low, lead(p_partkey) OVER (ORDER BY p_partkey) AS high FROM part)
SELECT l_orderkey, l_linenumber, l_extendedprice, part FROM lineitem JOIN r
ON CAST(l_partkey AS BIGINT) >= low AND (high IS NULL OR l_partkey < high)""",
)
def route_many(spark, d):
    """As many ranges as there are parts, their starts as keys in text."""
    from pyspark.sql import Window as W

    key = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    low = table(spark, d, "part").select(F.col("p_partkey").alias("part"), key("p_partkey").alias("low"))
    ranges = low.withColumn("high", F.coalesce(F.lead("low").over(W.orderBy("low")), F.lit("")))
    rows = table(spark, d, "lineitem").withColumn("k", key("l_partkey"))
    return partitions.route_join(rows, ranges, few=64).select("l_orderkey", "l_linenumber", "l_extendedprice", "part")


@query(
    "refs_applied",
    """SELECT l_partkey AS extent_id, greatest(CAST(0 AS BIGINT), 2 * count(DISTINCT l_orderkey) FILTER (l_orderkey % 3 <> 0) - count(DISTINCT l_orderkey)) AS refs
FROM lineitem GROUP BY 1""",
)
def refs_applied(spark, d):
    """Counts after a third of the streams went, and went once more."""
    m = line_members(spark, d)
    old, new = partitions.refs(m), partitions.refs(m.where("stream_id % 3 <> 0"))
    diff = partitions.refs_diff(old, new)
    return partitions.refs_applied(partitions.refs_applied(old, diff), diff)


@query(
    "overlaid",
    """WITH o AS (SELECT l_partkey AS e, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1 UNION ALL SELECT 1000000000, 7)
SELECT coalesce(p_partkey, e) AS extent_id, p_brand AS brand, coalesce(n, p_size) AS refs FROM part FULL OUTER JOIN o ON p_partkey = e""",
)
def overlaid(spark, d):
    base = table(spark, d, "part").select(
        F.col("p_partkey").alias("extent_id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("refs")
    )
    even = table(spark, d, "lineitem").where("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("extent_id"))
    alone = spark.createDataFrame([(10**9, 7)], "extent_id long, refs long")
    return partitions.overlaid(base, even.agg(F.count("*").alias("refs")).unionByName(alone), "refs")


@query(
    "copied_pointers",
    """WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS e FROM lineitem)
SELECT s AS stream_id, e AS extent_id FROM m UNION ALL SELECT s + 100000000, e FROM m WHERE s % 100 = 1 AND s < 1000""",
)
def copied_pointers(spark, d):
    """A right child's snapshot of what its parent's tables point to."""
    m = line_members(spark, d).select("stream_id", "extent_id").distinct()
    copied = {s: s + 100000000 for s in range(1, 1000, 100)}
    return partitions.duplicated_streams(m, m.where(F.col("stream_id").isin(*copied)), copied)


CUT = f"""{MEMBERS}, ends AS (SELECT stream_id, max({{'p': pos, 'e': extent_id}}).e AS last, min({{'p': pos, 'e': extent_id}}).e AS first FROM m GROUP BY 1),
s AS (SELECT stream_id, last FROM ends WHERE last <> first ORDER BY stream_id LIMIT 1)"""


@query(
    "stream_truncated",
    f"""WITH {CUT}, place AS (SELECT min(pos) AS p FROM m JOIN s USING (stream_id) WHERE extent_id = last)
SELECT m.stream_id, pos, extent_id FROM m, s, place WHERE m.stream_id <> s.stream_id OR pos >= p""",
)
def stream_truncated(spark, d):
    """The first stream that has two extents is cut before its last one."""
    m = line_members(spark, d)
    place = F.struct("pos", "extent_id")
    ends = m.groupBy("stream_id").agg(F.max(place).extent_id.alias("last"), F.min(place).extent_id.alias("first"))
    s = ends.where("last <> first").orderBy("stream_id").first()
    return partitions.truncated(m, s["stream_id"], s["last"])


@query(
    "stream_punched",
    f"""WITH {MEMBERS}, s AS (SELECT min(stream_id) AS own FROM (SELECT stream_id FROM m GROUP BY 1
  HAVING bool_or(extent_id % 2 = 0) AND bool_or(extent_id % 2 = 1)))
SELECT stream_id, pos, extent_id FROM m, s WHERE stream_id <> own OR extent_id % 2 = 1""",
)
def stream_punched(spark, d):
    """Even extents are taken out of the first stream that has odd ones as well."""
    m = line_members(spark, d)
    kinds = m.groupBy("stream_id").agg(F.countDistinct(F.col("extent_id") % 2).alias("n"))
    own = kinds.where("n = 2").agg(F.min("stream_id")).first()[0]
    return partitions.punched(m, table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("extent_id")), own)


@query(
    "deletable_extents",
    """SELECT extent_id FROM (SELECT l_partkey AS extent_id, count(*) FILTER (l_orderkey % 40 = 0) AS refs FROM lineitem GROUP BY 1)
WHERE refs = 0 AND extent_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
)
def deletable_extents(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("extent_id"))
    refs = line.agg(F.count_if(F.col("l_orderkey") % 40 == 0).alias("refs"))
    pointers = table(spark, d, "part").select(F.col("p_partkey").alias("extent_id"), F.greatest(F.col("p_size") - 25, F.lit(0)).alias("vp_table_refs"))
    return partitions.deletable(refs, pointers)


BEATS = f"beats AS (SELECT n_nationkey AS ps_id, CAST({NOW} - n_nationkey AS BIGINT) AS last_seen FROM nation)"


@query("evicted_servers", f"WITH {BEATS} SELECT ps_id, last_seen FROM beats WHERE {NOW} - last_seen > 10")
def evicted_servers(spark, d):
    beats = table(spark, d, "nation").select(F.col("n_nationkey").alias("ps_id"), (F.lit(NOW) - F.col("n_nationkey")).cast("long").alias("last_seen"))
    return partitions.evicted(beats, NOW)


@query("allocated_ids", "SELECT n_name AS name, 999 + row_number() OVER (ORDER BY n_name) AS id FROM nation")
def allocated_ids(spark, d):
    return partitions.allocated(table(spark, d, "nation").select(F.col("n_name").alias("name")), 1000, "name")


@query(
    "healthy_nodes",
    """SELECT 4 AS asked, n_nationkey AS node_id FROM (SELECT * FROM nation WHERE n_regionkey <> 0 ORDER BY n_nationkey LIMIT 4)
UNION ALL SELECT 23, n_nationkey FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 23)""",
)
def healthy_nodes(spark, d):
    """Of 25 nodes 20 are healthy: enough for four, too few for 23."""
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), (F.col("n_regionkey") != 0).alias("healthy"))
    of = lambda n: cluster.healthy_first(nodes, n).select(F.lit(n).alias("asked"), "node_id")
    return of(4).union(of(23))


@query(
    "erasure_candidates",
    """SELECT l_partkey AS extent_id, min(l_orderkey) AS stream_id, 4 AS data, CAST(arg_min(l_orderkey % 3, l_orderkey) AS BIGINT) AS parity
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 3 > 0 AND p_size > 10 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 GROUP BY 1""",
)
def erasure_candidates(spark, d):
    p, o = table(spark, d, "part"), F.col("o_orderkey")
    streams = table(spark, d, "orders").select(o.alias("stream_id"), F.lit(4).alias("data"), (o % 3).alias("parity"))
    extents = p.select(
        F.col("p_partkey").alias("extent_id"),
        F.greatest(F.col("p_size") - 10, F.lit(0)).alias("sealed_length"),
        (F.col("p_partkey") % 5 == 0).alias("converted"),
    )
    recovering = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("extent_id"))
    return cluster.erasure_candidates(line_members(spark, d), streams, extents, recovering)


@query(
    "cluster_report",
    f"""SELECT part, CASE WHEN c_name IS NULL THEN printf('{{"part":%d,"extents":%d,"bytes":%d}}', part, extents, bytes)
  ELSE printf('{{"part":%d,"address":"%s","extents":%d,"bytes":%d}}', part, c_name, extents, bytes) END AS info
FROM ({oracle_sql()["partition_sizes"]}) LEFT JOIN customer ON c_custkey = part""",
)
def cluster_report(spark, d):
    where = table(spark, d, "customer").select(F.col("c_custkey").alias("part"), F.col("c_name").alias("address"))
    return cluster.report(catalogue.partition_sizes(spark, d), where)


@query(
    "stream_info",
    f"""WITH {MEMBERS} SELECT stream_id, count(*) AS extents, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes,
  max({{'p': pos, 'e': extent_id}}).e AS tail FROM m LEFT JOIN part ON p_partkey = extent_id GROUP BY 1""",
)
def stream_info(spark, d):
    return cluster.stream_info(line_members(spark, d), part_extents(spark, d))


@query(
    "average_latency",
    """SELECT event_type, user_id % 7 AS part, CASE WHEN count(value) > 0 THEN
  round(sum(CAST(round(value * 1000000) AS BIGINT)) / CAST(count(value) AS DOUBLE) / 1000000.0, 9) ELSE 0.0 END AS ms FROM events GROUP BY 1, 2""",
)
def average_latency(spark, d):
    ns = F.round(F.col("value") * 1000000).cast("long")
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("part"))
    return e.agg(F.round(aggregates.average_ms(F.sum(ns), F.count("value")), 9).alias("ms"))


@query("epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events")
def epoch_seconds(spark, d):
    return table(spark, d, "events").select("event_id", scalar.epoch_seconds(F.col("ts")).alias("second"))


@query(
    "load_keys",
    "SELECT event_id, printf('%08x', user_id * 65536) || '!w_' || (event_id % 8) || '_' || event_id AS k FROM events",
)
def load_keys(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(n, scalar.load_key(scalar.hex_key(F.col("user_id") * 65536), "w", n % 8, n).alias("k"))


@query(
    "common_prefixes",
    """SELECT page_id, CAST(len(list_filter(range(1, least(length(url), 40) + 1), lambda i: substr(url, 1, i) = substr(other, 1, i))) AS INTEGER) AS shared
FROM (SELECT page_id, url, rpad('http://the', 40, '.example/') AS other FROM pages)""",
)
def common_prefixes(spark, d):
    other = F.rpad(F.lit("http://the"), 40, F.lit(".example/"))
    return table(spark, d, "pages").select("page_id", scalar.common_prefix(F.col("url"), other).alias("shared"))


@query("json_texts", "SELECT doc_id, md5(CAST(to_json(text) AS VARCHAR)) AS json FROM documents")
def json_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalar.json_text(F.col("text")).cast("binary")).alias("json"))


FLAGS = [("4+2", 4, 2), ("3", 3, 0), ("1+0", 1, 0), ("4+x", None, None), ("+2", None, None), ("0+1", None, None), ("4+2+1", None, None), ("", None, None)]


@query(
    "replication_flags",
    "SELECT flag, CAST(data AS INTEGER) AS data, CAST(parity AS INTEGER) AS parity FROM (VALUES "
    + ", ".join(f"('{f}', {'NULL' if k is None else k}, {'NULL' if m is None else m})" for f, k, m in FLAGS)
    + ") t(flag, data, parity)",
)
def replication_flags(spark, d):
    df = spark.createDataFrame([(f,) for f, _, _ in FLAGS], "flag string")
    r = scalar.replication(F.col("flag"))
    return df.select("flag", r.data.alias("data"), r.parity.alias("parity"))


MODE = "(CASE o_orderkey % 4 WHEN 0 THEN 16384 WHEN 1 THEN 32768 WHEN 2 THEN 40960 ELSE 4096 END + o_orderkey % 512)"


@query(
    "file_modes",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' ELSE 'other' END AS kind,
  CAST({MODE} - o_orderkey % 512 + o_custkey % 4096 AS BIGINT) AS mode FROM orders""",
)
def file_modes(spark, d):
    """Kinds, and modes with new permissions; what else the permissions' number
    holds is left out."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, 16384).when(key % 4 == 1, 32768).when(key % 4 == 2, 40960).otherwise(4096)
    mode = (kind + key % 512).cast("long")
    new = (F.col("o_custkey") % 4096 + 65536).cast("long")
    o = table(spark, d, "orders")
    return o.select(key, scalar.mode_kind(mode).alias("kind"), scalar.with_permissions(mode, new).alias("mode"))


@query("extent_shards", "SELECT p_partkey AS extent_id, p_partkey % 5 AS shard FROM part")
def extent_shards(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("extent_id"), scalar.shard_of(p, 5).alias("shard"))


@query(
    "file_sizes",
    "SELECT source AS parent, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
)
def file_sizes(spark, d):
    """Documents as files, sources as directories."""
    inodes = table(spark, d, "documents").select(F.col("source").alias("parent"), F.octet_length("text").cast("long").alias("size"))
    return files.directory_sizes(inodes)
