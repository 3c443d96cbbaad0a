"""The registered queries on the standard tables, and SQL that says the same.

Each query reads whole tables.  A pair is registered by ``query``; without SQL
only the rows are checked, and a test stands in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import aggregates, scalar
from strandline.operators import blocks, cluster, compaction, files, gc, latest, lookup, partitions
from strandline.plans.registry import oracle_sql, queries, query
from strandline.sources import log as logs
from strandline.sources.log import NOW, events_log, table

__all__ = ["oracle_sql", "queries", "query"]

LOG = """log AS (
  SELECT printf('u%06d', user_id) AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
         props AS v,
         CASE WHEN event_type IN ('signup', 'view') THEN CAST(floor(epoch(ts)) AS BIGINT) + 21600 ELSE 0 END AS exp
  FROM events
)"""
NEWEST = f"""{LOG}, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank FROM log) WHERE rank = 1
)"""
CURRENT = f"""{NEWEST}, cur AS (SELECT k, seq, v, exp FROM newest WHERE op <> 2 AND (exp = 0 OR exp > {NOW}))"""
TABLES = f"""{LOG}, tabs AS (
  SELECT seq // 1000 AS table_id, min(k) AS min_key, max(k) AS max_key, max(seq) AS last_seq, count(*) AS entries,
         CAST(sum(octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0)) AS BIGINT) AS raw_bytes,
         coalesce(min(CASE WHEN exp > 0 THEN exp END), 0) AS min_expires_at
  FROM log GROUP BY 1
)"""
RANGES = ["", "u000050", "u000100"]
#: Text versions per key: documents as a log whose keys repeat.
DOC_KEYS, DOC_EXTENT = 97, 64
CHUNK = 1024


# lookups


@query("scan_live", f"WITH {CURRENT} SELECT * FROM cur")
def scan_live(spark, d):
    return latest.current(events_log(spark, d)).select("k", "seq", "v", "exp")


@query("scan_live_by_max", f"WITH {CURRENT} SELECT * FROM cur")
def scan_live_by_max(spark, d):
    log = latest.newest_by_max(events_log(spark, d))
    return log.where(latest.visible()).select("k", "seq", "v", "exp")


ASKED = "SELECT printf('u%06d', i * 7) AS k FROM range(30) t(i)"


@query(
    "get_many",
    f"WITH {CURRENT}, asked AS ({ASKED}) "
    "SELECT asked.k, cur.k IS NOT NULL AS found, v FROM asked LEFT JOIN cur ON asked.k = cur.k",
)
def get_many(spark, d):
    keys = spark.range(30).select(F.format_string("u%06d", F.col("id") * 7).alias("k"))
    return lookup.get_many(events_log(spark, d), keys)


@query("get_one", f"WITH {CURRENT} SELECT k, seq, v FROM cur WHERE k = 'u000008'")
def get_one(spark, d):
    return lookup.get(events_log(spark, d), "u000008").select("k", "seq", "v")


@query("head", f"WITH {CURRENT} SELECT k, octet_length(encode(v)) AS value_length FROM cur")
def head(spark, d):
    return lookup.head(events_log(spark, d))


@query("get_subrange", "SELECT doc_id, substr(text, 6, 10) AS part, substr(text, 6) AS rest FROM documents")
def get_subrange(spark, d):
    """In characters, as the values are text."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", lookup.subrange(t, 5, 10).alias("part"), lookup.subrange(t, 5, 0).alias("rest")
    )


@query("exists", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def exists(spark, d):
    return lookup.exists(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id").select("doc_id")


@query("range_prefix_limit", f"WITH {CURRENT} SELECT k FROM cur WHERE starts_with(k, 'u0000') ORDER BY k LIMIT 20")
def range_prefix_limit(spark, d):
    return lookup.range_keys(events_log(spark, d), "u0000", limit=20)


@query("range_from", f"WITH {CURRENT} SELECT k FROM cur WHERE starts_with(k, 'u0') AND k >= 'u000031'")
def range_from(spark, d):
    return lookup.range_keys(events_log(spark, d), "u0", "u000031")


@query("range_next_page", f"WITH {CURRENT} SELECT k FROM cur WHERE k > 'u000030' ORDER BY k LIMIT 20")
def range_next_page(spark, d):
    return lookup.page_after(events_log(spark, d), "u000030", 20)


@query("url_prefix_scan", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://th')")
def url_prefix_scan(spark, d):
    pages = table(spark, d, "pages").withColumnRenamed("url", "k")
    return pages.where(lookup.key_bounds("http://th")).select("page_id", F.col("k").alias("url"))


@query("seek", f"WITH {LOG} SELECT k, seq FROM log WHERE k >= 'u0000105' ORDER BY k, seq DESC LIMIT 1")
def seek(spark, d):
    return lookup.seek(events_log(spark, d), "u0000105").select("k", "seq")


@query("tombstones_current", f"WITH {NEWEST} SELECT k, seq FROM newest WHERE op = 2")
def tombstones_current(spark, d):
    return latest.newest(events_log(spark, d)).where(F.col("op") == logs.DELETE).select("k", "seq")


@query("expired_current", f"WITH {NEWEST} SELECT k, seq, exp FROM newest WHERE op <> 2 AND exp > 0 AND exp <= {NOW}")
def expired_current(spark, d):
    newest = latest.newest(events_log(spark, d))
    return newest.where((F.col("op") != logs.DELETE) & ~latest.not_expired()).select("k", "seq", "exp")


@query("version_rank", f"WITH {LOG} SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank FROM log")
def version_rank(spark, d):
    return latest.ranked(events_log(spark, d)).select("k", "seq", "rank")


@query(
    "read_sources",
    f"""WITH {NEWEST}, asked AS ({ASKED})
SELECT coalesce(CASE WHEN newest.op <> 2 AND (exp = 0 OR exp > {NOW})
                     THEN CASE WHEN seq % 3 = 0 THEN 'memory' ELSE 'table' END END, 'miss') AS source,
       count(*) AS lookups
FROM asked LEFT JOIN newest ON asked.k = newest.k GROUP BY 1""",
)
def read_sources(spark, d):
    keys = spark.range(30).select(F.format_string("u%06d", F.col("id") * 7).alias("k"))
    source = F.when(F.col("seq") % 3 == 0, "memory").otherwise("table")
    return lookup.read_source(events_log(spark, d), source, keys)


@query(
    "first_source_wins",
    f"WITH {LOG} SELECT k, min(CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END) AS src FROM log GROUP BY k",
)
def first_source_wins(spark, d):
    log = events_log(spark, d)
    parts = [log.where(F.col("seq") % 2 == i).select("k").distinct().withColumn("src", F.lit(i)) for i in (0, 1)]
    return latest.first_wins(parts).select("k", "src")


@query("prefix_delete_count", f"WITH {CURRENT} SELECT count(*) AS deleted FROM cur WHERE starts_with(k, 'u0000')")
def prefix_delete_count(spark, d):
    return lookup.range_keys(events_log(spark, d), "u0000").agg(F.count("*").alias("deleted"))


@query(
    "recovered_log",
    f"WITH {LOG} SELECT k, seq, op, v, exp FROM log",
)
def recovered_log(spark, d):
    """The log holds all records; those flushed to tables must not come twice."""
    log = events_log(spark, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    return logs.recovered(log.where(F.col("seq") <= last - 100), log)


@query(
    "manifest_newest",
    f"""WITH {LOG}, m AS (SELECT seq % 7 AS part_id, seq AS version, op = 1 AS valid FROM log)
SELECT part_id, version, version // 1000 AS table_id FROM (
  SELECT part_id, max(version) AS version FROM m WHERE valid GROUP BY 1)""",
)
def manifest_newest(spark, d):
    m = events_log(spark, d).select(
        (F.col("seq") % 7).alias("part_id"),
        F.col("seq").alias("version"),
        (F.col("op") == logs.PUT).alias("valid"),
        F.array(F.floor(F.col("seq") / 1000)).alias("tables"),
    )
    return logs.manifest_newest(m)


# compaction and garbage


@query("compact_major", f"WITH {CURRENT} SELECT k, seq, v, exp FROM cur WHERE k >= 'u000020' AND k < 'u000120'")
def compact_major(spark, d):
    return compaction.major(events_log(spark, d), "u000020", "u000120").select("k", "seq", "v", "exp")


@query(
    "compact_minor",
    f"""WITH {LOG} SELECT k, seq, op FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank FROM log
  WHERE seq // 1000 < (SELECT max(seq) // 1000 FROM log)) WHERE rank = 1""",
)
def compact_minor(spark, d):
    """All tables but the newest are compacted."""
    log = events_log(spark, d).withColumn("table_id", F.expr("seq div 1000"))
    newest = log.agg(F.max("table_id")).first()[0]
    return compaction.minor(log.where(F.col("table_id") < F.lit(newest))).select("k", "seq", "op")


@query(
    "compact_stats",
    f"""WITH {LOG}, j AS (
  SELECT octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS size,
         row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1 AND op <> 2 AND (exp = 0 OR exp > {NOW}) AS kept
  FROM log)
SELECT count(*) AS n_in, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_discarded,
       CAST(coalesce(sum(size) FILTER (kept), 0) AS BIGINT) AS bytes_kept,
       CAST(coalesce(sum(size) FILTER (NOT kept), 0) AS BIGINT) AS bytes_discarded FROM j""",
)
def compact_stats(spark, d):
    return compaction.stats(events_log(spark, d))


DOC_LOG = f"""docs AS (
  SELECT doc_id % {DOC_KEYS} AS k, doc_id AS seq, doc_id // {DOC_EXTENT} AS extent_id, octet_length(encode(text)) AS size
  FROM documents
), dropped AS (
  SELECT extent_id, CAST(sum(size) AS BIGINT) AS discarded FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank FROM docs) WHERE rank > 1 AND size > 4096
  GROUP BY 1
)"""


def doc_log(spark, d):
    """Documents as a log: their values lie in extents of 64 documents; larger
    ones behind pointers."""
    docs = table(spark, d, "documents").select(
        (F.col("doc_id") % DOC_KEYS).cast("string").alias("k"), F.col("doc_id").alias("seq"), F.lit(logs.PUT).alias("op"),
        F.col("text").alias("v"), F.lit(0).cast("long").alias("exp"),
    )
    return blocks.pointers(docs, "v", F.floor(F.col("seq") / DOC_EXTENT), "seq")


@query("discards_by_extent", f"WITH {DOC_LOG} SELECT * FROM dropped")
def discards_by_extent(spark, d):
    return compaction.discards(doc_log(spark, d))


# sealed lengths differ by extent, so that the ratio test has both outcomes
EXTENTS = f"""extents AS (
  SELECT extent_id, CAST(sum(size) * (1 + extent_id % 3) AS BIGINT) AS sealed_length FROM docs
  GROUP BY extent_id HAVING extent_id < (SELECT max(extent_id) FROM docs)
)"""


def doc_extents(spark, d):
    """The sealed extents: all but the last."""
    docs = table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / DOC_EXTENT).cast("long").alias("extent_id"),
        F.octet_length("text").cast("long").alias("size"),
    )
    last = docs.agg(F.max("extent_id")).first()[0]
    return docs.where(F.col("extent_id") < F.lit(last)).groupBy("extent_id").agg(
        (F.sum("size") * (1 + F.col("extent_id") % 3)).alias("sealed_length")
    )


@query(
    "gc_candidates",
    f"""WITH {DOC_LOG}, {EXTENTS}, top AS (
  SELECT extent_id, discarded, discarded / CAST(sealed_length AS DOUBLE) AS ratio
  FROM dropped JOIN extents USING (extent_id) ORDER BY discarded DESC, extent_id LIMIT 3)
SELECT extent_id, discarded, round(ratio, 9) AS ratio FROM top WHERE ratio > 0.4""",
)
def gc_candidates(spark, d):
    found = gc.candidates(compaction.discards(doc_log(spark, d)), doc_extents(spark, d))
    return found.select("extent_id", "discarded", F.round("ratio", 9).alias("ratio"))


@query("gc_pending", f"WITH {DOC_LOG}, {EXTENTS} SELECT extent_id, discarded FROM dropped WHERE extent_id IN (SELECT extent_id FROM extents)")
def gc_pending(spark, d):
    """The stream's members are the sealed extents."""
    return gc.pending(compaction.discards(doc_log(spark, d)), doc_extents(spark, d))


def newest_discarded(spark, d):
    """The newest extent with discards; -1 without any."""
    top = compaction.discards(doc_log(spark, d)).agg(F.max("extent_id")).first()[0]
    return -1 if top is None else top


NEWEST_DISCARDED = "(SELECT max(extent_id) FROM dropped)"
LIVE_DOCS = f"""{DOC_LOG}, live AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank FROM docs) WHERE rank = 1 AND size > 4096)"""


@query(
    "gc_live_records",
    f"WITH {LIVE_DOCS} SELECT CAST(k AS VARCHAR) AS k, seq, extent_id, size AS len FROM live WHERE extent_id = {NEWEST_DISCARDED}",
)
def gc_live_records(spark, d):
    live = gc.still_live(doc_log(spark, d), newest_discarded(spark, d))
    return live.select("k", "seq", "pointer.extent_id", "pointer.len")


@query(
    "gc_rewritten",
    f"""WITH {LIVE_DOCS} SELECT CAST(k AS VARCHAR) AS k, (SELECT max(seq) FROM docs) + 1 AS seq, 1 AS op, md5(text) AS v, true AS rewritten
FROM live JOIN documents ON doc_id = seq WHERE extent_id = {NEWEST_DISCARDED}""",
)
def gc_rewritten(spark, d):
    log = doc_log(spark, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    again = gc.rewrite(log, newest_discarded(spark, d), last + 1)
    return again.select("k", "seq", "op", F.md5(F.col("v").cast("binary")).alias("v"), "rewritten")


@query(
    "gc_forced",
    f"""WITH {DOC_LOG}, {EXTENTS} SELECT -extent_id AS pos, extent_id FROM (SELECT DISTINCT extent_id FROM docs)
WHERE extent_id IN (SELECT extent_id FROM extents) ORDER BY pos LIMIT 3""",
)
def gc_forced(spark, d):
    """All extents are requested, the newest first; the tail is not sealed."""
    asked = doc_log(spark, d).select(F.floor(F.col("seq") / DOC_EXTENT).cast("long").alias("extent_id")).distinct()
    return gc.forced(asked.withColumn("pos", -F.col("extent_id")), doc_extents(spark, d)).select("pos", "extent_id")


def event_tables(spark, d):
    return compaction.table_properties(
        events_log(spark, d).withColumn("table_id", F.floor(F.col("seq") / 1000).cast("long"))
    )


@query("table_properties", f"WITH {TABLES} SELECT * FROM tabs")
def table_properties(spark, d):
    return event_tables(spark, d)


@query("expiry_major_trigger", f"WITH {TABLES} SELECT table_id, min_expires_at FROM tabs WHERE min_expires_at > 0 AND min_expires_at <= {NOW}")
def expiry_major_trigger(spark, d):
    return compaction.due_for_major(event_tables(spark, d)).select("table_id", "min_expires_at")


@query("overlap_tables", f"WITH {TABLES} SELECT table_id FROM tabs WHERE NOT (min_key >= 'u000002' AND max_key < 'u000149')")
def overlap_tables(spark, d):
    return compaction.overlapping(event_tables(spark, d), "u000002", "u000149").select("table_id")


@query(
    "extent_pointer_refs",
    f"""WITH {DOC_LOG} SELECT extent_id, count(DISTINCT seq // 100) AS vp_table_refs FROM docs WHERE size > 4096 GROUP BY 1""",
)
def extent_pointer_refs(spark, d):
    log = doc_log(spark, d).withColumn("table_id", F.floor(F.col("seq") / 100))
    return compaction.pointer_deps(log).groupBy("extent_id").agg(F.count("*").alias("vp_table_refs"))


# partitions


@query(
    "presplit_bounds",
    """SELECT i AS part, CASE WHEN i = 0 THEN '' ELSE printf('%08x', 4294967295 // 16 * i) END AS low,
       CASE WHEN i = 15 THEN '' ELSE printf('%08x', 4294967295 // 16 * (i + 1)) END AS high FROM range(16) t(i)""",
)
def presplit_bounds(spark, d):
    return partitions.presplit(spark, 16)


ROUTED = "CASE WHEN k >= 'u000100' THEN 2 WHEN k >= 'u000050' THEN 1 ELSE 0 END"


@query("route_counts", f"WITH {LOG} SELECT {ROUTED} AS part, count(*) AS records FROM log GROUP BY 1")
def route_counts(spark, d):
    log = events_log(spark, d)
    part = partitions.route(log, RANGES).cast("int")
    return log.groupBy(part.alias("part")).agg(F.count("*").alias("records"))


@query("route_by_join", f"WITH {CURRENT} SELECT k, {ROUTED} AS part FROM cur")
def route_by_join(spark, d):
    ranges = spark.createDataFrame(
        [(i, low, high) for i, (low, high) in enumerate(zip(RANGES, [*RANGES[1:], ""]))], "part int, low string, high string"
    )
    keys = latest.current(events_log(spark, d)).select("k")
    return partitions.route_join(keys, ranges).select("k", "part")


MID = f"""{CURRENT}, mid AS (
  SELECT k AS mid FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM cur)
  WHERE pos = n // 2 AND n >= 2)"""


@query("split_mid", f"WITH {MID} SELECT mid FROM mid")
def split_mid(spark, d):
    mid = partitions.split_key(latest.current(events_log(spark, d)).select("k"))
    return spark.createDataFrame([(mid,)] if mid else [], "mid string")


@query("split_halves", f"WITH {MID} SELECT CASE WHEN k < mid THEN 'left' ELSE 'right' END AS half, count(*) AS keys FROM cur, mid GROUP BY 1")
def split_halves(spark, d):
    keys = latest.current(events_log(spark, d)).select("k")
    mid = partitions.split_key(keys)
    ranges = partitions.split(spark.createDataFrame([(1, "", "")], "part int, low string, high string"), 1, mid or "", 2)
    halves = partitions.route_join(keys, ranges)
    return halves.groupBy(F.when(F.col("part") == 1, "left").otherwise("right").alias("half")).agg(F.count("*").alias("keys"))


@query(
    "region_gaps",
    """SELECT * FROM (SELECT o_orderkey AS start, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_start,
       lead(o_orderkey) OVER (ORDER BY o_orderkey) - o_orderkey AS gap FROM (SELECT DISTINCT o_orderkey FROM orders))
WHERE gap > 1""",
)
def region_gaps(spark, d):
    return partitions.gaps(table(spark, d, "orders"), "o_orderkey")


REFS = "SELECT l_partkey AS extent_id, count(DISTINCT l_orderkey) AS refs FROM lineitem GROUP BY 1"
COPIED = (1, 2, 3)


def line_members(spark, d):
    """Orders as streams, their parts as extents."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("extent_id")
    )


@query(
    "refs_after_split",
    f"""WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS e FROM lineitem),
a AS (SELECT * FROM m UNION ALL SELECT s + 100000000, e FROM m WHERE s IN {COPIED})
SELECT e AS extent_id, count(*) AS refs FROM a GROUP BY 1""",
)
def refs_after_split(spark, d):
    m = line_members(spark, d)
    copied = m.where(F.col("stream_id").isin(*COPIED))
    return partitions.refs(partitions.duplicated_streams(m, copied, {s: s + 100000000 for s in COPIED}))


@query(
    "refs_diff",
    f"""WITH {LOG}, m AS (SELECT max(seq) AS last FROM log),
a AS (SELECT k, count(*) AS n FROM log, m WHERE seq <= last * 2 // 3 GROUP BY 1),
b AS (SELECT k, count(*) AS n FROM log, m WHERE seq > last // 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS extent_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""",
)
def refs_diff(spark, d):
    """Snapshots of the first and of the last two thirds of the log."""
    log = events_log(spark, d).select(F.col("k").alias("extent_id"), "seq")
    last = log.agg(F.max("seq")).first()[0] or 0
    n = lambda rows: rows.groupBy("extent_id").agg(F.count("*").alias("refs"))
    return partitions.refs_diff(n(log.where(F.col("seq") <= last * 2 // 3)), n(log.where(F.col("seq") > last // 3)))


@query(
    "stream_tails",
    "SELECT l_orderkey AS stream_id, max({'p': l_linenumber, 'e': l_partkey}).e AS extent_id FROM lineitem GROUP BY 1",
)
def stream_tails(spark, d):
    return cluster.last_extent(line_members(spark, d))


@query(
    "server_load",
    "SELECT n_nationkey AS ps_id, count(s_suppkey) AS load FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
def server_load(spark, d):
    servers = table(spark, d, "nation").select(F.col("n_nationkey").alias("ps_id"))
    return partitions.load(servers, table(spark, d, "supplier").select(F.col("s_nationkey").alias("ps_id")))


@query(
    "least_loaded",
    """SELECT n_nationkey AS ps_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
GROUP BY 1 ORDER BY count(s_suppkey), n_nationkey LIMIT 1""",
)
def least_loaded(spark, d):
    return partitions.least_loaded(server_load(spark, d))


@query(
    "rebalance",
    """WITH RECURSIVE alive AS (
  SELECT list(n_nationkey ORDER BY n_nationkey) AS ids, list(n ORDER BY n_nationkey) AS loads FROM (
    SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
    WHERE n_nationkey % 3 <> 0 GROUP BY 1)
), lost AS (
  SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier WHERE s_nationkey % 3 = 0
), step AS (
  SELECT CAST(0 AS BIGINT) AS i, loads, 0 AS place FROM alive
  UNION ALL
  SELECT i + 1, list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END),
         list_position(loads, list_min(loads))
  FROM step WHERE i < (SELECT count(*) FROM lost)
)
SELECT s_suppkey AS part, ids[place] AS ps_id FROM step JOIN lost USING (i), alive
UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey % 3 <> 0""",
)
def rebalance(spark, d):
    """Suppliers as partitions, nations as servers, one in three gone.  Cluster
    metadata, as many rows as there are partitions of a store."""
    regions = {r[0]: r[1] for r in table(spark, d, "supplier").select("s_suppkey", "s_nationkey").collect()}
    servers = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect() if r[0] % 3]
    placed = partitions.rebalance(regions, servers, regions)
    return spark.createDataFrame(sorted(placed.items()), "part long, ps_id int")


# layout


@query(
    "wal_offsets",
    f"""WITH {LOG}, s AS (SELECT seq // 1000 AS batch, seq, 17 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS size FROM log)
SELECT batch, seq, CAST(coalesce(sum(size) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(sum(size) OVER (PARTITION BY batch ORDER BY seq) AS BIGINT) AS "end" FROM s""",
)
def wal_offsets(spark, d):
    batch = F.floor(F.col("seq") / 1000).cast("long")
    return blocks.offsets(events_log(spark, d), batch).select("batch", "seq", "offset", "end")


@query(
    "value_pointers",
    f"""WITH {DOC_LOG} SELECT seq AS doc_id, extent_id, size AS len,
  CAST(coalesce(sum(size) OVER (PARTITION BY extent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM docs WHERE size > 4096""",
)
def value_pointers(spark, d):
    rows = doc_log(spark, d).where("pointer is not null")
    return rows.select(F.col("seq").alias("doc_id"), "pointer.extent_id", "pointer.len", "pointer.offset")


@query("shard_size", "SELECT doc_id, greatest((octet_length(encode(text)) + 7) // 4, 4) AS shard_size FROM documents")
def shard_size(spark, d):
    length = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", blocks.shard_size(length, 4).alias("shard_size"))


BLOCK = 4096


@query(
    "block_assignment",
    f"""WITH RECURSIVE {LOG}, r AS (
  SELECT seq // 1000 AS t, k, seq, 30 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS size,
         row_number() OVER (PARTITION BY seq // 1000 ORDER BY k, seq DESC) AS i FROM log
), f AS (
  SELECT t, k, seq, i, CAST(0 AS BIGINT) AS block, size AS held, 1 AS n FROM r WHERE i = 1
  UNION ALL
  SELECT r.t, r.k, r.seq, r.i, CASE WHEN f.held + r.size > {BLOCK} OR f.n >= 50 THEN f.block + 1 ELSE f.block END,
         CASE WHEN f.held + r.size > {BLOCK} OR f.n >= 50 THEN r.size ELSE f.held + r.size END,
         CASE WHEN f.held + r.size > {BLOCK} OR f.n >= 50 THEN 1 ELSE f.n + 1 END
  FROM f JOIN r ON r.t = f.t AND r.i = f.i + 1
)
SELECT t AS table_id, k, seq, block FROM f""",
)
def block_assignment(spark, d):
    rows = blocks.block_rows(events_log(spark, d), F.floor(F.col("seq") / 1000).cast("long"))
    packed = blocks.packed(rows, "table_id", ["k", "seq"], "size", BLOCK, 50)
    return packed.select("table_id", "k", "seq", "block")


# files


@query(
    "chunk_index",
    f"""SELECT doc_id AS ino, c AS chunk, least({CHUNK}, octet_length(encode(text)) - c * {CHUNK}) AS size
FROM documents, LATERAL (SELECT unnest(range((octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})) AS c)""",
)
def chunk_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ino"), "text")
    return files.chunked(docs, "text", CHUNK).select("ino", "chunk", F.octet_length("data").cast("long").alias("size"))


@query(
    "file_read_span",
    """SELECT doc_id AS ino, lower(substr(hex(encode(text)), 2 * 1500 + 1, 2 * 1200)) AS data
FROM documents WHERE octet_length(encode(text)) > 1500""",
)
def file_read_span(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ino"), "text")
    chunks = files.chunked(docs, "text", CHUNK)
    inodes = docs.select("ino", F.octet_length("text").cast("long").alias("size"))
    got = files.read(inodes, chunks, 1500, 1200, CHUNK)
    return got.select("ino", F.lower(F.hex("data")).alias("data"))


@query(
    "readdir",
    """WITH e AS (SELECT conv_id + 2 AS parent, printf('%s-%d', role, turn) AS name, 1000000 + conv_id * 1000 + turn AS ino FROM conversations)
SELECT parent, name, ino, row_number() OVER (PARTITION BY parent ORDER BY name) + 2 AS "offset" FROM e
UNION ALL SELECT DISTINCT parent, '.', parent, 1 FROM e UNION ALL SELECT DISTINCT parent, '..', parent, 2 FROM e""",
)
def readdir(spark, d):
    c = table(spark, d, "conversations")
    e = c.select(
        (F.col("conv_id") + 2).alias("parent"),
        F.concat_ws("-", "role", F.col("turn").cast("string")).alias("name"),
        (1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("ino"),
    )
    return files.readdir(e)


@query(
    "path_lookup",
    """SELECT c.conv_id, c.turn, length(c.text) AS size FROM conversations c WHERE c.turn = 0 AND c.role = 'user'""",
)
def path_lookup(spark, d):
    """Messages as files at /role/turn/conv_id; all of one directory.  Inode
    numbers are hashes of paths."""
    c = table(spark, d, "conversations")
    role, turn, conv = (F.col(x).cast("string") for x in ("role", "turn", "conv_id"))
    ino = lambda *path: F.xxhash64(F.concat_ws("/", *path))
    entry = lambda parent, name, at: c.select(parent.alias("parent"), name.alias("name"), at.alias("ino"))
    dirs = entry(F.lit(files.ROOT).cast("long"), role, ino(role)).union(entry(ino(role), turn, ino(role, turn))).distinct()
    dirents = dirs.union(entry(ino(role, turn), conv, ino(role, turn, conv)))
    inodes = c.select(ino(role, turn, conv).alias("ino"), "conv_id", "turn", F.length("text").cast("long").alias("size"))
    at = files.resolve_path(dirents, "/user/0").first()
    return files.lookup(dirents, inodes, at and at.ino, F.col("name")).select("conv_id", "turn", "size")


MEDIA_KEYS = """m AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id || '.jpg' WHEN 1 THEN '.thumb/320/p' || page_id || '.jpg'
    WHEN 2 THEN 'v' || page_id || '.mp4' ELSE '.hls/v' || (page_id - page_id % 8) + 2 || '.mp4/index.m3u8' END AS k FROM pages)"""


def media_keys(spark, d):
    p = F.col("page_id")
    k = (
        F.when(p % 4 == 0, F.concat(F.lit("p"), p.cast("string"), F.lit(".jpg")))
        .when(p % 4 == 1, F.concat(F.lit(".thumb/320/p"), p.cast("string"), F.lit(".jpg")))
        .when(p % 4 == 2, F.concat(F.lit("v"), p.cast("string"), F.lit(".mp4")))
        .otherwise(F.concat(F.lit(".hls/v"), (p - p % 8 + 2).cast("string"), F.lit(".mp4/index.m3u8")))
    )
    return table(spark, d, "pages").select(k.alias("k"))


@query(
    "listing_namespaced",
    f"""WITH {MEDIA_KEYS} SELECT DISTINCT CASE WHEN starts_with(k, '.hls/') THEN regexp_extract(k, '^[.]hls/(.*)/index[.]m3u8$', 1) ELSE k END AS name
FROM m WHERE NOT starts_with(k, '.thumb/')""",
)
def listing_namespaced(spark, d):
    return files.listing(media_keys(spark, d))


@query(
    "pending_videos",
    f"""WITH {MEDIA_KEYS} SELECT k FROM m WHERE k LIKE 'v%.mp4'
AND k NOT IN (SELECT regexp_extract(k, '^[.]hls/(.*)/index[.]m3u8$', 1) FROM m WHERE k LIKE '.hls/%')""",
)
def pending_videos(spark, d):
    return files.pending_videos(media_keys(spark, d))


@query("pending_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_work(spark, d):
    return files.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


RANGE_HEADERS = [
    ("bytes=0-", 100), ("bytes=10-19", 100), ("bytes=-5", 100), ("bytes=90-200", 100), ("bytes=100-", 100),
    ("bytes=5-2", 100), ("bytes=-0", 100), ("bytes=x-1", 100), ("items=0-1", 100), ("bytes=0-", 0), ("bytes=-500", 100),
]


@query(
    "byte_range_parse",
    """SELECT header, CAST(total AS BIGINT) AS total, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM (VALUES ('bytes=0-', 100, 0, 99), ('bytes=10-19', 100, 10, 19), ('bytes=-5', 100, 95, 99),
  ('bytes=90-200', 100, 90, 99), ('bytes=100-', 100, NULL, NULL), ('bytes=5-2', 100, NULL, NULL),
  ('bytes=-0', 100, NULL, NULL), ('bytes=x-1', 100, NULL, NULL), ('items=0-1', 100, NULL, NULL),
  ('bytes=0-', 0, NULL, NULL), ('bytes=-500', 100, 0, 99)) t(header, total, first, last)""",
)
def byte_range_parse(spark, d):
    df = spark.createDataFrame(RANGE_HEADERS, "header string, total long")
    r = scalar.byte_range(F.col("header"), F.col("total"))
    return df.select("header", "total", r.first.alias("first"), r.last.alias("last"))


@query(
    "human_sizes",
    """SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0)
  WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0)
  ELSE printf('%d B', b) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * o_orderkey AS BIGINT) AS b FROM orders)""",
)
def human_sizes(spark, d):
    """Cubes of keys as sizes; from the key 2,097,152 they are over 64 bits,
    where the SQL stops with an error."""
    key = F.col("o_orderkey").cast("decimal(19,0)")
    b = key * key * key
    return table(spark, d, "orders").select("o_orderkey", scalar.human_size(b).alias("size"))


@query(
    "media_kinds",
    f"""WITH {MEDIA_KEYS} SELECT k, CASE WHEN k LIKE '%.jpg' THEN 'image' WHEN k LIKE '%.mp4' THEN 'video' ELSE 'other' END AS kind FROM m""",
)
def media_kinds(spark, d):
    return media_keys(spark, d).select("k", scalar.media_kind(F.col("k")).alias("kind"))


@query("long_keys", "SELECT conv_id, turn, '03' || printf('%016x', conv_id) || printf('%016x', turn) AS key, turn AS back FROM conversations")
def long_keys(spark, d):
    key = scalar.long_key(3, F.col("conv_id"), F.col("turn"))
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.lower(F.hex(key)).alias("key"), scalar.long_from_key(key, 1).alias("back"))


@query(
    "bloom_no_false_negatives",
    f"""WITH {LOG}, asked AS (SELECT DISTINCT k, true AS has FROM log UNION ALL SELECT printf('other%d', o_orderkey), false FROM orders)
SELECT has, count(*) AS asked, CAST(0 AS BIGINT) AS wrong_absent, true AS few_wrong_present FROM asked GROUP BY 1""",
)
def bloom_no_false_negatives(spark, d):
    """A filter for a hundredth of false answers, asked for the keys it was
    made of and for as many others as there are orders; it may give thrice that."""
    keys = events_log(spark, d).select("k").distinct()
    bits, hashes = scalar.bloom_shape(keys.count(), 0.01)
    filter_ = scalar.bloom_built(keys, bits, hashes)
    others = table(spark, d, "orders").select(F.format_string("other%d", "o_orderkey").alias("k"), F.lit(False).alias("has"))
    asked = keys.withColumn("has", F.lit(True)).union(others)
    tested = scalar.bloom_asked(asked, filter_, bits, hashes)
    return tested.groupBy("has").agg(
        F.count("*").alias("asked"),
        F.count_if(F.col("has") & ~F.col("hit")).alias("wrong_absent"),
        (F.count_if(~F.col("has") & F.col("hit")) <= 0.03 * F.count("*")).alias("few_wrong_present"),
    )


# figures


@query(
    "latency_percentiles",
    """WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (pos = least(50 * n // 100, n - 1)) AS p50, max(value) FILTER (pos = least(95 * n // 100, n - 1)) AS p95,
  max(value) FILTER (pos = least(99 * n // 100, n - 1)) AS p99 FROM n GROUP BY 1""",
)
def latency_percentiles(spark, d):
    return aggregates.nearest_ranks(table(spark, d, "events"), "event_type", "value", [50, 95, 99])


@query(
    "ema",
    """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value > 0),
f AS (SELECT user_id, i, value AS e FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, f.e * 0.7::DOUBLE + s.value * 0.3::DOUBLE FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, round(arg_max(e, i), 6) AS ema FROM f GROUP BY 1""",
)
def ema(spark, d):
    rows = aggregates.ema(table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.select("user_id", F.round("ema", 6).alias("ema"))


@query(
    "ema_slow",
    """SELECT region, round(list_reduce(list(value ORDER BY event_id), lambda s, x: s * 0.999::DOUBLE + x * 0.001::DOUBLE), 6) AS ema
FROM (SELECT user_id % 2 AS region, value, event_id FROM events WHERE value > 0) GROUP BY 1""",
)
def ema_slow(spark, d):
    """A small alpha, where thousands of values count."""
    rows = table(spark, d, "events").withColumn("region", F.col("user_id") % 2)
    return aggregates.ema(rows, "region", "event_id", "value", 0.001).select("region", F.round("ema", 6).alias("ema"))


@query(
    "throughput",
    """SELECT event_type, count(*) AS ops, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, round(count(*) / 3600.0, 6) AS ops_per_second,
  round(sum(octet_length(encode(props))) / 3600.0 / 1048576.0, 9) AS mib_per_second FROM events GROUP BY 1""",
)
def throughput(spark, d):
    e = table(spark, d, "events").withColumn("size", F.octet_length("props").cast("long"))
    t = aggregates.throughput(e, "event_type", "size", F.lit(3600.0))
    return t.withColumns(
        {"ops_per_second": F.round("ops_per_second", 6), "mib_per_second": F.round("mib_per_second", 9)}
    )


@query(
    "ops_per_day",
    """SELECT second, ops, CAST(sum(ops) OVER (ORDER BY second) AS BIGINT) AS total FROM (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS second, count(*) AS ops FROM events GROUP BY 1)""",
)
def ops_per_day(spark, d):
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long")
    return aggregates.per_second(table(spark, d, "events"), day)


@query(
    "availability_mask",
    """SELECT l_orderkey AS extent_id, bit_or(CAST(1 AS BIGINT) << (l_linenumber - 1)) AS mask, max(l_linenumber) AS slots,
  bit_or(CAST(1 AS BIGINT) << (l_linenumber - 1)) = (CAST(1 AS BIGINT) << max(l_linenumber)) - 1 AS all_available
FROM lineitem GROUP BY 1""",
)
def availability_mask(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("extent_id"), (F.col("l_linenumber") - 1).alias("slot"), F.col("l_linenumber").alias("slots")
    )
    return cluster.all_available(r)


@query("commit_length", "SELECT l_partkey AS extent_id, min(l_quantity) AS commit_length FROM lineitem GROUP BY 1")
def commit_length(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("extent_id"), F.col("l_quantity").alias("length"))
    return cluster.commit_length(r)


@query(
    "live_size_top_n",
    "SELECT source AS part, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def live_size_top_n(spark, d):
    """The report of the five largest partitions."""
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("part")).agg(
        F.sum(F.octet_length("text").cast("long")).alias("bytes")
    )
    return cluster.largest(sizes, 5)


@query(
    "partition_sizes",
    """SELECT o_custkey AS part, count(DISTINCT l_partkey) AS extents, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes FROM (
  SELECT DISTINCT o_custkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def partition_sizes(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("stream_id"))
    extents = table(spark, d, "part").select(F.col("p_partkey").alias("extent_id"), F.col("p_size").cast("long").alias("length"))
    return cluster.partition_sizes(orders, line_members(spark, d), extents)


@query(
    "recovery_candidates",
    """WITH e AS (SELECT s_suppkey AS extent_id, s_suppkey % 8 AS avali, unnest([0, 1, 2]) AS slot,
  unnest([s_nationkey, (s_nationkey + 1) % 25, (s_nationkey + 2) % 25]) AS node_id FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT extent_id, slot, node_id, node_id AS disk_id, CASE WHEN n_regionkey = 0 THEN 'disk offline' WHEN (avali & (1 << slot)) = 0 THEN 'not available'
  ELSE 'node unreachable' END AS reason
FROM e JOIN nation ON n_nationkey = node_id WHERE n_regionkey = 0 OR (avali & (1 << slot)) = 0 OR n_nationkey % 7 = 0""",
)
def recovery_candidates(spark, d):
    s = table(spark, d, "supplier")
    at = lambda i: F.pmod(F.col("s_nationkey") + i, F.lit(25))
    extents = s.select(
        F.col("s_suppkey").alias("extent_id"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(1).alias("sealed_length"),
        (F.col("s_suppkey") % 8).alias("avali"),
        F.array(*[F.struct(at(i).alias("node_id"), at(i).alias("disk_id")) for i in range(3)]).alias("replicas"),
    )
    n = table(spark, d, "nation")
    disks = n.select(F.col("n_nationkey").alias("disk_id"), (F.col("n_regionkey") != 0).alias("online"))
    nodes = n.select(F.col("n_nationkey").alias("node_id"), (F.col("n_nationkey") % 7 != 0).alias("reachable"))
    return cluster.recovery_candidates(extents, disks, nodes)


@query(
    "node_disks",
    "SELECT c_nationkey AS node_id, c_custkey AS disk_id, s_suppkey IS NOT NULL AS online FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def node_disks(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_nationkey").alias("node_id"), F.array("c_custkey").alias("disk_ids"))
    disks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("disk_id"), F.lit(True).alias("online"))
    return cluster.node_disks(nodes, disks)


@query(
    "partition_addresses",
    """SELECT s_suppkey AS part, s_nationkey AS ps_id, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE n_name END AS address
FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def partition_addresses(spark, d):
    s = table(spark, d, "supplier")
    regions = s.select(F.col("s_suppkey").alias("part"), F.col("s_nationkey").alias("ps_id"))
    servers = table(spark, d, "nation").select(F.col("n_nationkey").alias("ps_id"), F.col("n_name").alias("address"))
    own = s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("part"), F.col("s_name").alias("address"))
    return cluster.addresses(regions, servers, own)


@query("orphan_extents", "SELECT DISTINCT l_suppkey AS extent_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def orphan_extents(spark, d):
    reported = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("extent_id")).distinct()
    known = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("extent_id"))
    return cluster.orphan_extents(reported, known)
