"""Queries on files and directories: messages of conversations as files of one
directory a conversation, documents as files of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import files
from strandline.plans.catalogue import CHUNK, MEDIA_KEYS, media_keys
from strandline.plans.registry import query
from strandline.sources.log import table

#: Directories (conversations) are numbered from 2, files from 1,000,000.
ENTRIES = """e AS (SELECT conv_id + 2 AS parent, printf('%s-%d', role, turn) AS name, 1000000 + conv_id * 1000 + turn AS ino, text FROM conversations)
, top AS (SELECT DISTINCT CAST(1 AS BIGINT) AS parent, printf('c%d', conv_id) AS name, conv_id + 2 AS ino FROM conversations)
, d AS (SELECT parent, name, ino FROM e UNION ALL SELECT * FROM top)"""


def entries(spark, d):
    c, conv = table(spark, d, "conversations"), F.col("conv_id")
    named = c.select(
        (conv + 2).alias("parent"),
        F.concat_ws("-", "role", F.col("turn").cast("string")).alias("name"),
        (1000000 + conv * 1000 + F.col("turn")).alias("ino"),
    )
    top = c.select(F.lit(1).cast("long").alias("parent"), F.format_string("c%d", conv).alias("name"), (conv + 2).alias("ino")).distinct()
    return named.union(top)


def inodes(spark, d):
    """ino, is_dir, nlink, mode and size of every file and directory."""
    c, conv = table(spark, d, "conversations"), F.col("conv_id")
    own = c.select(
        (1000000 + conv * 1000 + F.col("turn")).alias("ino"),
        F.lit(False).alias("is_dir"),
        F.lit(1).cast("long").alias("nlink"),
        F.lit(0o100644).alias("mode"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
    )
    top = c.select((conv + 2).alias("ino")).distinct().union(spark.range(1, 2).toDF("ino"))
    dirs = top.select("ino", F.lit(True).alias("is_dir"), F.lit(2).cast("long").alias("nlink"), F.lit(0o40755).alias("mode"), F.lit(0).cast("long").alias("size"))
    return own.union(dirs)


INODES = """i AS (SELECT ino, false AS is_dir, CAST(1 AS BIGINT) AS nlink, 33188 AS mode, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size FROM e
UNION ALL SELECT ino, true, 2, 16877, 0 FROM (SELECT ino FROM top UNION ALL SELECT 1))"""


@query(
    "names_created",
    f"WITH {ENTRIES} SELECT e.parent, e.name, CASE WHEN e.ino % 2 = 0 THEN 'EEXIST' END AS error FROM e",
)
def names_created(spark, d):
    """Every name made anew where only those of even inodes are taken."""
    named = entries(spark, d).where("parent > 1")
    got = files.created(named.where("ino % 2 = 0"), named.withColumn("ino", F.col("ino") + 10**9))
    return got.select("parent", "name", "error")


@query(
    "links_after_mkdir",
    f"WITH {ENTRIES}, {INODES} SELECT i.ino, nlink + (SELECT count(*) FROM top WHERE top.ino % 3 = 0 AND top.parent = i.ino) + CASE WHEN i.is_dir AND i.ino > 1 THEN 1 ELSE 0 END AS nlink FROM i",
)
def links_after_mkdir(spark, d):
    """A third of the conversations' directories are made in the root, and one
    more in each of them all."""
    dirs = entries(spark, d).where("parent = 1")
    made = dirs.where("ino % 3 = 0").union(dirs.select(F.col("ino").alias("parent"), F.lit("sub").alias("name"), (F.col("ino") + 10**9).alias("ino")))
    return files.with_subdirectories(inodes(spark, d), made).select("ino", "nlink")


@query(
    "attributes_set",
    f"""WITH {ENTRIES}, {INODES} SELECT ino, CASE WHEN ino % 2 = 0 AND ino % 4 = 0 THEN 33152 ELSE mode END AS mode,
  CASE WHEN ino % 2 = 0 AND ino % 3 = 0 THEN CAST(7 AS BIGINT) ELSE size END AS size FROM i""",
)
def attributes_set(spark, d):
    """Changes of half the inodes, each of one attribute, both or none."""
    i, ino = inodes(spark, d), F.col("ino")
    changes = i.where("ino % 2 = 0").select("ino", F.when(ino % 4 == 0, 0o100600).alias("mode"), F.when(ino % 3 == 0, F.lit(7).cast("long")).alias("size"))
    return files.with_attributes(i, changes).select("ino", "mode", "size")


@query(
    "names_unlinked",
    f"""WITH {ENTRIES} SELECT parent, name, ino, CASE WHEN parent = 1 THEN 'EISDIR' END AS error FROM d
UNION ALL SELECT parent, 'missing', NULL, 'ENOENT' FROM (SELECT DISTINCT parent FROM d)""",
)
def names_unlinked(spark, d):
    """Every name, and one more in every directory, unlinked as files."""
    named = entries(spark, d)
    asked = named.select("parent", "name").union(named.select("parent", F.lit("missing").alias("name")).distinct())
    return files.removed(named, inodes(spark, d), asked)


@query(
    "directories_removed",
    f"""WITH {ENTRIES} SELECT parent, name, ino, CASE WHEN parent > 1 THEN 'ENOTDIR' WHEN ino IN (SELECT parent FROM e WHERE ino % 2 = 0) THEN 'ENOTEMPTY' END AS error
FROM d WHERE parent = 1 OR ino % 2 = 0""",
)
def directories_removed(spark, d):
    """The same as directories, after odd files went."""
    named = entries(spark, d).where("parent = 1 or ino % 2 = 0")
    return files.removed(named, inodes(spark, d), named.select("parent", "name"), directories=True)


FIRST = "(SELECT min({'p': parent, 'n': name}) FROM e)"


@query(
    "renamed",
    f"""WITH {ENTRIES}, a AS (SELECT {FIRST} AS f, (SELECT max({{'p': parent, 'n': name}}) FROM e) AS t)
SELECT CASE WHEN (parent, name) = (f.p, f.n) THEN t.p ELSE parent END AS parent, CASE WHEN (parent, name) = (f.p, f.n) THEN t.n ELSE name END AS name, ino, false AS gone
FROM d, a WHERE (parent, name) <> (t.p, t.n) UNION ALL SELECT NULL, NULL, ino, true FROM d, a WHERE (parent, name) = (t.p, t.n)""",
)
def renamed(spark, d):
    """The first file takes the last one's place."""
    named, place = entries(spark, d), F.struct("parent", "name")
    a, b = named.where("parent > 1").agg(F.min(place), F.max(place)).first()
    left, gone = files.renamed(named, a.parent, a.name, b.parent, b.name)
    none = F.lit(None)
    return left.withColumn("gone", F.lit(False)).union(
        gone.select(none.cast("long").alias("parent"), none.cast("string").alias("name"), "ino", F.lit(True).alias("gone"))
    )


def chunks(spark, d):
    return files.chunked(table(spark, d, "documents").select(F.col("doc_id").alias("ino"), "text"), "text", CHUNK)


PIECES = """SELECT doc_id AS ino, c AS chunk, substr(h, CAST(2 * {0} * c + 1 AS BIGINT), 2 * {0}) AS data
FROM w, LATERAL (SELECT unnest(range((len(h) // 2 + {0} - 1) // {0})) AS c)"""


@query(
    "chunks_overwritten",
    f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, rpad(substr(h, 1, 1000), 1000, '0') || repeat('58', 1200) || substr(h, 3401) AS h FROM t)
{PIECES.format(CHUNK)}""",
)
def chunks_overwritten(spark, d):
    """1,200 bytes written to every file at 500, over chunk ends and beyond the
    ends of short files."""
    writes = table(spark, d, "documents").select(
        F.col("doc_id").alias("ino"), F.lit(500).cast("long").alias("offset"), F.repeat(F.lit("X"), F.lit(1200)).cast("binary").alias("data")
    )
    got = files.overwritten(chunks(spark, d), writes, CHUNK)
    return got.select("ino", "chunk", F.hex("data").alias("data"))


@query(
    "chunks_truncated",
    f"""WITH l AS (SELECT doc_id AS longest FROM documents ORDER BY octet_length(encode(text)) DESC NULLS LAST, doc_id LIMIT 1),
w AS (SELECT doc_id, CASE WHEN doc_id = longest THEN substr(hex(encode(text)), 1, 3000) ELSE hex(encode(text)) END AS h FROM documents, l WHERE text IS NOT NULL)
{PIECES.format(CHUNK)}""",
)
def chunks_truncated(spark, d):
    """The longest file cut to 1,500 bytes."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"))
    longest = docs.orderBy(F.desc_nulls_last("n"), "doc_id").first()["doc_id"]
    return files.truncated(chunks(spark, d), longest, 1500, CHUNK).select("ino", "chunk", F.hex("data").alias("data"))


@query(
    "derived_keys",
    f"""WITH {MEDIA_KEYS}, n AS (SELECT DISTINCT 'v' || page_id || '.mp4' AS name FROM pages WHERE page_id % 8 = 2 UNION SELECT 'p' || page_id || '.jpg' FROM pages WHERE page_id % 3 = 0)
SELECT k FROM m WHERE CASE WHEN starts_with(k, '.thumb/') THEN regexp_extract(k, '^[.]thumb/[^/]*/(.*)$', 1)
  WHEN starts_with(k, '.hls/') THEN regexp_extract(k, '^[.]hls/(.*)/[^/]*$', 1) ELSE k END IN (SELECT name FROM n)""",
)
def derived_keys(spark, d):
    """What goes with some pictures and videos."""
    p = F.col("page_id")
    pages = table(spark, d, "pages")
    video = pages.where(p % 8 == 2).select(F.concat(F.lit("v"), p.cast("string"), F.lit(".mp4")).alias("name"))
    picture = pages.where(p % 3 == 0).select(F.concat(F.lit("p"), p.cast("string"), F.lit(".jpg")).alias("name"))
    return files.derived(media_keys(spark, d), video.union(picture))
