"""A file system's view: directories, and files cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.sources.shared import Scratch

# Bytes of a chunk, and the root's inode number.
CHUNK = 256 << 10
ROOT = 1


def lookup(dirents: DataFrame, inodes: DataFrame, parent: int | None, name: Column | str) -> DataFrame:
    """The inode of a name in a directory; none in a null one."""
    return dirents.where((F.col("parent") == parent) & (F.col("name") == name)).join(inodes, "ino")


def resolve_path(dirents: DataFrame, path: str, root: int = ROOT) -> DataFrame:
    """The inode number at a path, one join a step; no row if there is none."""
    spark = dirents.sparkSession
    at = spark.range(root, root + 1).select(F.col("id").alias("ino"))
    for name in (p for p in path.split("/") if p):
        here = at.select(F.col("ino").alias("parent"))
        at = dirents.where(F.col("name") == name).join(here, "parent").select("ino")
    return at


def readdir(dirents: DataFrame) -> DataFrame:
    """Every directory's listing: parent, name, ino and offset; ``.`` is 1 and
    ``..`` 2, names follow in byte order from 3.

    The entries are sorted into ranges, which a large directory has many of, and
    numbered in each; a range's numbers start after those of the directory's
    ranges before it.  Entries are rows: a name listed twice has two numbers.
    """
    scratch = Scratch(dirents.sparkSession)
    dirs = dirents.select("parent").distinct()
    up = dirents.select(F.col("ino").alias("parent"), F.col("parent").alias("_up"))
    dots = dirs.join(up, "parent", "left").select(
        "parent",
        F.explode(
            F.array(
                F.struct(F.lit(".").alias("name"), F.col("parent").alias("ino"), F.lit(1).cast("long").alias("offset")),
                F.struct(F.lit("..").alias("name"), F.coalesce("_up", "parent").alias("ino"), F.lit(2).cast("long").alias("offset")),
            )
        ).alias("e"),
    )
    cut = dirents.select("parent", "name", "ino").repartitionByRange("parent", "name")
    # written, since a range's number must not change between its two uses
    cut = scratch.keep(cut.withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("parent", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("parent").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    # only the first directory of a range can go on from the range before: one row a range at most
    starts = sizes.select(F.col("parent").alias("_dir"), F.col("_range").alias("_at"), F.sum("_n").over(before).alias("_before"))
    same = F.col("parent").eqNullSafe(F.col("_dir")) & (F.col("_range") == F.col("_at"))
    rank = F.row_number().over(W.partitionBy("parent", "_range").orderBy("name")).cast("long") + 2
    named = cut.withColumn("_rank", rank).join(F.broadcast(starts.where("_before > 0")), same, "left")
    offset = F.col("_rank") + F.coalesce("_before", F.lit(0).cast("long"))
    return dots.select("parent", "e.*").unionByName(named.select("parent", "name", "ino", offset.alias("offset")))


def chunked(files: DataFrame, value: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of each file: ino, chunk (from 0), data (binary)."""
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.octet_length("_b") - 1) / chunk).cast("long"))
    each = files.select("ino", F.col(value).cast("binary").alias("_b")).where(F.octet_length("_b") > 0)
    each = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.select("ino", "chunk", F.substring("_b", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))


def read(inodes: DataFrame, chunks: DataFrame, offset: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """ino and data (binary): ``size`` bytes of each file from ``offset``, cut
    at its end (``inodes``: ino, size); missing chunks read as zeros."""
    end = F.least(F.col("size"), F.lit(offset + size).cast("long"))
    span = inodes.where(F.col("size") > offset).select("ino", end.alias("_end"))
    first = offset // chunk
    each = span.withColumn("chunk", F.explode(F.sequence(F.lit(first).cast("long"), F.floor((F.col("_end") - 1) / chunk).cast("long"))))
    own = chunks.where((F.col("chunk") >= first) & (F.col("chunk") <= (offset + size - 1) // chunk))
    got = each.join(own, ["ino", "chunk"], "left")
    low = F.greatest(F.lit(offset).cast("long") - F.col("chunk") * chunk, F.lit(0).cast("long"))
    n = F.least(F.col("_end") - F.col("chunk") * chunk, F.lit(chunk).cast("long")) - low
    have = F.substring(F.coalesce("data", F.lit(b"")), (low + 1).cast("int"), n.cast("int"))
    zeros = F.unhex(F.repeat(F.lit("00"), (n - F.octet_length(have)).cast("int")))
    parts = got.select("ino", "chunk", F.hex(F.concat(have, zeros)).alias("_hex"))
    # a read's span bounds the parts that meet here
    joined = parts.groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("chunk", "_hex"))).alias("_p"))
    return joined.select("ino", F.unhex(F.array_join(F.transform("_p", lambda p: p._hex), "")).alias("data"))


def overwritten(chunks: DataFrame, writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks after writes (ino, offset, data): bytes go where they belong,
    across chunk ends; gaps become zeros.  One write a file at a time."""
    last = F.floor((F.col("offset") + F.octet_length("data") - 1) / chunk).cast("long")
    each = writes.where(F.octet_length("data") > 0).withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("offset") / chunk).cast("long"), last))
    )
    low = F.greatest(F.col("offset") - F.col("chunk") * chunk, F.lit(0).cast("long"))
    start = F.greatest(F.col("chunk") * chunk - F.col("offset"), F.lit(0).cast("long"))
    new = each.select("ino", "chunk", low.alias("_low"), F.substring("data", (start + 1).cast("int"), (F.lit(chunk) - low).cast("int")).alias("_new"))
    both = chunks.join(new, ["ino", "chunk"], "full_outer")
    old = F.coalesce("data", F.lit(b""))
    before = F.substring(old, F.lit(1), F.col("_low").cast("int"))
    gap = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.col("_low").cast("int") - F.octet_length(before))))
    after = F.substring(old, (F.col("_low") + F.octet_length("_new") + 1).cast("int"), F.lit(chunk))
    return both.select("ino", "chunk", F.when(F.col("_new").isNull(), F.col("data")).otherwise(F.concat(before, gap, F.col("_new"), after)).alias("data"))


def truncated(chunks: DataFrame, ino: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks after a file was cut to ``size``: later ones gone, the last one
    cut."""
    own = F.col("ino") == ino
    full, rest = divmod(size, chunk)
    left = chunks.where(~own | (F.col("chunk") < full) | ((F.col("chunk") == full) & F.lit(rest > 0)))
    cut = own & (F.col("chunk") == full)
    return left.withColumn("data", F.when(cut, F.substring("data", F.lit(1), F.lit(rest))).otherwise(F.col("data")))


def created(dirents: DataFrame, new: DataFrame) -> DataFrame:
    """Each new entry (parent, name, ino) with error: EEXIST where taken."""
    taken = dirents.select("parent", "name", F.lit("EEXIST").alias("error"))
    return new.join(taken, ["parent", "name"], "left")


def removed(dirents: DataFrame, inodes: DataFrame, names: DataFrame, directories: bool = False) -> DataFrame:
    """Each name (parent, name) to unlink, or as a directory to remove, with
    its ino and error: ENOENT, EISDIR, ENOTDIR or ENOTEMPTY."""
    at = names.join(dirents, ["parent", "name"], "left").join(inodes.select("ino", "is_dir"), "ino", "left")
    full = dirents.select(F.col("parent").alias("ino"), F.lit(True).alias("_full")).distinct()
    at = at.join(full, "ino", "left")
    wrong = F.when(~F.col("is_dir"), "ENOTDIR") if directories else F.when(F.col("is_dir"), "EISDIR")
    error = F.when(F.col("ino").isNull(), "ENOENT").otherwise(
        F.coalesce(wrong, F.when(F.col("_full"), "ENOTEMPTY") if directories else F.lit(None).cast("string"))
    )
    return at.select("parent", "name", "ino", error.alias("error"))


def renamed(dirents: DataFrame, parent: int, name: str, to_parent: int, to_name: str) -> tuple[DataFrame, DataFrame]:
    """The entries after a rename, and the inodes it replaced, whose chunks are
    to go as well."""
    moved = (F.col("parent") == parent) & (F.col("name") == name)
    target = (F.col("parent") == to_parent) & (F.col("name") == to_name)
    replaced = dirents.where(target & ~moved).select("ino")
    left = dirents.where(~target | moved)
    return (
        left.withColumns(
            {
                "parent": F.when(moved, F.lit(to_parent).cast("long")).otherwise(F.col("parent")),
                "name": F.when(moved, to_name).otherwise(F.col("name")),
            }
        ),
        replaced,
    )


def listing(keys: DataFrame, thumbs: str = ".thumb/", videos: str = ".hls/", playlist: str = "index.m3u8") -> DataFrame:
    """Logical names (name): keys, without thumbnails, and videos by their
    playlist."""
    k = F.col("k")
    video = F.regexp_extract(k, f"^{videos.replace('.', '[.]')}(.*)/{playlist.replace('.', '[.]')}$", 1)
    name = F.when(k.startswith(videos), F.when(video != "", video)).when(~k.startswith(thumbs), k)
    return keys.select(name.alias("name")).where("name is not null").distinct()


def pending_videos(keys: DataFrame, extensions: tuple[str, ...] = ("mp4", "mov", "mkv", "webm", "avi")) -> DataFrame:
    """Videos (k) that have no playlist yet."""
    done = keys.select(F.regexp_extract("k", r"^[.]hls/(.*)/index[.]m3u8$", 1).alias("k")).where("k <> ''")
    own = keys.where(~F.col("k").startswith(".hls/") & ~F.col("k").startswith(".thumb/"))
    return own.where(F.lower(F.substring_index("k", ".", -1)).isin(*extensions)).join(done, "k", "left_anti")


def pending(items: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """The rows of ``items`` whose work is not among ``done`` yet."""
    return items.join(done.select(on), on, "left_anti")


def derived(keys: DataFrame, names: DataFrame) -> DataFrame:
    """The keys (k) that go when the logical ``names`` (name) are deleted: each
    itself, its thumbnails of all sizes, and its playlist and segments."""
    k = F.col("k")
    base = (
        F.when(k.startswith(".thumb/"), F.regexp_extract(k, "^[.]thumb/[^/]*/(.*)$", 1))
        .when(k.startswith(".hls/"), F.regexp_extract(k, "^[.]hls/(.*)/[^/]*$", 1))
        .otherwise(k)
    )
    return keys.withColumn("name", base).join(names.select("name").distinct(), "name", "left_semi").select("k")


def directory_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes by directory (``files``: parent, size)."""
    return files.groupBy("parent").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def with_subdirectories(inodes: DataFrame, made: DataFrame) -> DataFrame:
    """``inodes`` (ino, nlink, ...) after directories (parent, name, ino) were
    made: each adds a link to its parent."""
    more = made.groupBy(F.col("parent").alias("_parent")).agg(F.count("*").alias("_more"))
    links = F.col("nlink") + F.coalesce("_more", F.lit(0))
    return inodes.join(more, F.col("ino") == F.col("_parent"), "left").withColumn("nlink", links).drop("_parent", "_more")


def with_attributes(inodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``inodes`` with the attributes that ``changes`` (ino, and any of their
    columns) give; null leaves an attribute as it is."""
    own = [c for c in changes.columns if c != "ino"]
    c = changes.select(F.col("ino").alias("_ino"), *(F.col(x).alias("_" + x) for x in own))
    joined = inodes.join(c, F.col("ino") == F.col("_ino"), "left")
    return joined.select(*(F.coalesce("_" + x, x).alias(x) if x in own else F.col(x) for x in inodes.columns))
