"""Column expressions on keys, names, sizes and headers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File name endings by kind of media.
MEDIA = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "avif"),
    "video": ("mp4", "mov", "mkv", "webm", "avi", "m4v"),
    "audio": ("mp3", "wav", "ogg", "flac", "m4a"),
}
# The format bits of a file mode.
MODE_FORMAT = 0o170000
MODE_KINDS = {0o040000: "directory", 0o100000: "file", 0o120000: "symlink"}

#: Bits of a block of a bloom filter, and of a filter that tasks get whole (8 MB).
BLOOM_BLOCK, BLOOM_BROADCAST = 4096, 1 << 26


def hex_key(n: Column) -> Column:
    """A number as eight hexadecimal digits, or as more if it is over 32 bits."""
    digits = F.hex(n)
    return F.lower(F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0")))


def long_key(prefix: int, *numbers: Column) -> Column:
    """A binary key: a prefix byte, then big-endian 64-bit numbers; keys order
    as their numbers do."""
    return F.concat(F.lit(bytes([prefix])), *[F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0")) for n in numbers])


def long_from_key(key: Column, place: int) -> Column:
    """The number at a place, from 0, of such a key."""
    return F.conv(F.hex(F.substring(key, 2 + 8 * place, 8)), 16, -10).cast("long")


def internal_key(key: Column, seq: Column) -> Column:
    """A key with its version, binary: the key, a zero byte, and what is left
    of 2**64 - 1, big-endian, so that newer versions stand before older ones."""
    return F.concat(key.cast("binary"), F.lit(b"\0"), F.unhex(F.lpad(F.hex(F.bitwise_not(seq.cast("long"))), 16, "0")))


def key_of_internal(internal: Column) -> Column:
    """The key of such a key; the whole if it is too short for a version."""
    n = F.octet_length(internal)
    return F.when(n > 9, F.substring(internal, F.lit(1), n - 9)).otherwise(internal)


def seq_of_internal(internal: Column) -> Column:
    """The version of such a key; 0 if it is too short for one."""
    last = F.conv(F.hex(F.substring(internal, -8, 8)), 16, -10).cast("long")
    return F.when(F.octet_length(internal) > 9, F.bitwise_not(last)).otherwise(F.lit(0).cast("long"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, in UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def human_size(n: Column) -> Column:
    """A size with one decimal, ties to even, in GB, MB or KB of 1024s, or in
    whole bytes; ``n`` is a whole number of any type."""

    def shown(bits: int, unit: str) -> Column:
        size = n.cast("double") / float(1 << bits)
        rest = size % 1.0  # at most 30 bits, so that ten times it is exact
        tenths = F.rint(rest * 10)
        return F.format_string(f"%.0f.%.0f {unit}", size - rest + F.floor(tenths / 10), tenths % 10)

    out = F.when(n >= 1 << 30, shown(30, "GB"))
    for bits, unit in ((20, "MB"), (10, "KB")):
        out = out.when(n >= 1 << bits, shown(bits, unit))
    return out.otherwise(F.format_string("%d B", n.cast("long")))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def media_kind(name: Column) -> Column:
    out = F.lit("other")
    for kind, endings in MEDIA.items():
        out = F.when(extension(name).isin(*endings), kind).otherwise(out)
    return out


def byte_range(header: Column, total: Column) -> Column:
    """An HTTP range as a struct of inclusive first and last; null if it is not
    of the form or cannot be met."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    number = lambda s: s.try_cast("long")
    suffix = (first == "") & (number(last) > 0)
    low = F.when(suffix, total - F.least(number(last), total)).when(first != "", number(first))
    bad = (last != "") & number(last).isNull()
    high = F.when(suffix | (last == ""), total - 1).otherwise(F.least(number(last), total - 1))
    ok = (total > 0) & low.isNotNull() & ~bad & (low < total) & (low <= high)
    return F.when(ok, F.struct(low.alias("first"), high.alias("last")))


def replication(flag: Column) -> Column:
    """``K+M`` as a struct of data and parity; a number alone has no parity."""
    parts = F.split(flag, r"\+")
    k, m = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    ok = (F.size(parts) <= 2) & (k > 0) & ((F.size(parts) == 1) | m.isNotNull())
    return F.when(ok, F.struct(k.alias("data"), F.coalesce(m, F.lit(0)).alias("parity")))


def mode_kind(mode: Column) -> Column:
    out = F.lit("other")
    for bits, kind in MODE_KINDS.items():
        out = F.when(mode.bitwiseAND(MODE_FORMAT) == bits, kind).otherwise(out)
    return out


def with_permissions(mode: Column, permissions: Column) -> Column:
    """A mode with new permission bits and the format it had."""
    return mode.bitwiseAND(MODE_FORMAT).bitwiseOR(permissions.bitwiseAND(0o7777))


def shard_of(extent_id: Column, shards: int) -> Column:
    return F.pmod(extent_id, F.lit(shards))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, same))


def bloom_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter for ``n`` keys and a false positive rate."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def _bloom_blocks(bits: int) -> tuple[int, int]:
    """Blocks of a filter of ``bits``, and bits of each, in whole words."""
    blocks = max(1, -(-bits // BLOOM_BLOCK))
    return blocks, -(-bits // (64 * blocks)) * 64


def bloom_places(key: Column, bits: int, hashes: int) -> list[Column]:
    """The places of a key in its block: two hashes, combined."""
    _, own = _bloom_blocks(bits)
    a, b = F.pmod(F.xxhash64(key), F.lit(own)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(own))
    return [F.pmod(a + b * i, F.lit(own)) for i in range(hashes)]


def _bloom_block(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(_bloom_blocks(bits)[0]))


def bloom_built(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """A filter over keys (k): block, words (64 bits each).

    A key belongs to one block, so that filters of any size are rows of at most
    BLOOM_BLOCK bits.
    """
    words = _bloom_blocks(bits)[1] // 64
    each = keys.select(_bloom_block(F.col("k"), bits).alias("block"), F.explode(F.array(*bloom_places(F.col("k"), bits, hashes))).alias("_p"))
    bit = F.expr("shiftleft(1L, cast(_p % 64 AS int))")
    some = each.groupBy("block", F.expr("cast(_p div 64 AS int)").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    of = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))  # at most BLOOM_BLOCK / 64 entries
    all_ = F.sequence(F.lit(0), F.lit(words - 1))
    return some.groupBy("block").agg(of.alias("_of")).select(
        "block", F.transform(all_, lambda i: F.coalesce(F.try_element_at("_of", i), F.lit(0).cast("long"))).alias("words")
    )


def bloom_asked(asked: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``asked`` (k, ...) with hit: whether the filter may contain the key.  A
    key meets its block only, and each of its places one word of that.  Up to
    BLOOM_BROADCAST bits are sent to all tasks."""
    few = F.broadcast(filter_) if bits <= BLOOM_BROADCAST else filter_
    met = asked.join(few.withColumnRenamed("block", "_block"), _bloom_block(F.col("k"), bits) == F.col("_block"), "left")
    hit = F.lit(True)
    for p in bloom_places(F.col("k"), bits, hashes):
        word = F.get("words", F.floor(p / 64).cast("int"))
        hit = hit & (F.getbit(word, (p % 64).cast("int")) == 1)
    # a block without keys has no row
    return met.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_block", "words")


def load_key(low: Column, tag: str, thread: Column, n: Column) -> Column:
    """A load test's key that lies in the range beginning at ``low``: '!' sorts
    before every digit of the next range's start."""
    return F.concat_ws("_", F.concat(low, F.lit("!" + tag)), thread.cast("string"), n.cast("string"))


def json_text(s: Column) -> Column:
    """A text as a JSON string, quotes included; null of null."""
    whole = F.to_json(F.struct(s.alias("s")))  # {"s":...}
    return F.when(s.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
