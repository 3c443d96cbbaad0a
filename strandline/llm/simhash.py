"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has one bit for each bit of its shingles' hashes: the
majority's.  Two fingerprints that differ in at most 2h bits have a variant in
common, some h bits or fewer from either; and two that have a variant in common
differ in at most 2h bits.  So every distinct fingerprint stands for all its
variants within h bits, variants are brought together by a shuffle, and
fingerprints that share one are linked.

A fingerprint has 2,081 variants within 2 of 64 bits; sent one by one they
would be a hundred times the fingerprints.  A variant's leading bits decide its
cell, and a fingerprint is sent once to each cell where it has variants; those
get listed in the cell.  The number of leading bits follows the number of
fingerprints.  Cells that would hold too many variants are split by the
syndrome of the other bits (the exclusive or of the places of the set bits),
over which the variants of any one fingerprint are spread evenly.  In a cell
that even MOST_SPLIT bits of it leave too full, as when a third of all
fingerprints agree in the leading bits, variants are sent one by one after all:
no more than 2,081 fingerprints can have one in common, so no group grows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import Scratch, joined_evenly, marked, per_text, present, unmarked
from strandline.llm.graph import components, star_edges

SHINGLE, SEED, RADIUS = 4, 42, 4
#: About how many variants a cell holds; and the bits that may name cells at most.
CELL_VARIANTS, MOST_PREFIX, LEAST_PREFIX = 1 << 20, 20, 4
#: Bits of the syndrome that split a cell at most.
MOST_SPLIT = 3
#: A task lists at most about so many variants at once.
HELD_VARIANTS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; 0 without words.

    Words are what ASCII white space separates, with A to Z in lower case;
    shingles are ``shingle`` words with blanks between, repeats included; a text
    with fewer words is one shingle.  A bit is 1 where over half the shingles'
    XXH64 hashes have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1))
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, fp (the fingerprint as a signed
    long) and text_hash (which tells apart texts of one key)."""
    schema = T.StructType([T.StructField(key, T.LongType())] + [T.StructField(c, T.LongType()) for c in ("fp", "text_hash")])

    def make() -> Callable:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda cols: [cols[0], [signed(fingerprint(t)) for t in cols[1]], cols[2]]

    body = F.col(text).cast("string")
    return per_text(docs, [present(docs, key, "long"), body, text_hash(body)], schema, make)


def text_hash(body: Column) -> Column:
    return F.xxhash64(F.coalesce(body, F.lit("")))


def _variants_within(bits: int, most: int) -> int:
    return sum(math.comb(bits, i) for i in range(most + 1))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) with the same
    components as all pairs that differ in at most ``radius`` bits, an even
    number."""
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("the radius must be 0, 2, 4 or 6")
    half = radius // 2
    n = distinct.count()
    prefix = math.ceil(math.log2(max(1.0, n * _variants_within(64, half) / CELL_VARIANTS)))
    prefix = min(MOST_PREFIX, max(LEAST_PREFIX, prefix))
    low = 64 - prefix
    lead = F.shiftrightunsigned("fp", low)
    # at most 2**MOST_PREFIX counts come to the driver, 16 bytes each
    counts = np.zeros(1 << prefix, np.int64)
    held = distinct.groupBy(lead.cast("int").alias("c")).count().toArrow()
    counts[held.column(0).to_numpy()] = held.column(1).to_numpy()
    load = np.zeros_like(counts)
    places = np.arange(len(counts))
    masks = _masks(prefix, half)
    for m in masks:
        load += counts[places ^ m] * _variants_within(low, half - m.bit_count())
    split = np.maximum(0, np.ceil(np.log2(np.maximum(load, 1) / (2 * CELL_VARIANTS)))).astype(int)

    sent = distinct.select("fp", F.explode(F.array(*[lead.bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("cell"))
    one_by_one = None
    if split.any():
        hot = np.flatnonzero(split)
        # at most 2**MOST_PREFIX rows are broadcast, 12 bytes each
        bits = distinct.sparkSession.createDataFrame(pd.DataFrame({"hot": hot, "bits": split[hot]}), "hot long, bits int")
        sent = sent.join(F.broadcast(bits), F.col("cell") == F.col("hot"), "left").select(
            "fp", "cell", F.coalesce("bits", F.lit(0)).alias("bits")
        )
        if split.max() > MOST_SPLIT:
            one_by_one = _variant_links(sent.where(F.col("bits") > MOST_SPLIT), lead, prefix, half)
            sent = sent.where(F.col("bits") <= MOST_SPLIT)
        # a fingerprint with one variant in the cell goes to that one's part only, others to all
        body = F.col("fp").bitwiseAND((1 << low) - 1)
        parts = F.call_function("shiftleft", F.lit(1), F.col("bits"))
        own = F.when(F.bit_count(lead.bitwiseXOR(F.col("cell"))) == half, _syndrome_of(body).bitwiseAND(parts - 1))
        sent = sent.withColumn("part", F.explode(F.sequence(F.coalesce(own, F.lit(0)), F.coalesce(own, parts - 1))))
    else:
        sent = sent.select("fp", "cell", F.lit(0).alias("bits"), F.lit(0).alias("part"))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        u, v = cell_links(
            group["fp"].to_numpy(), int(group["cell"].iloc[0]), prefix, half, int(group["bits"].iloc[0]), int(group["part"].iloc[0])
        )
        return pd.DataFrame({"u": u, "v": v})

    found = sent.groupBy("cell", "part").applyInPandas(within, "u long, v long")
    return found if one_by_one is None else found.unionByName(one_by_one)


def _variant_links(sent: DataFrame, lead: Column, prefix: int, half: int) -> DataFrame:
    """The links within cells (fp, cell) whose variants are shuffled one by one:
    each fingerprint to the least that has the variant as well."""
    low = 64 - prefix
    flips = [F.array(*[F.lit(m).cast("long") for m in _masks(low, half - d)]) for d in range(half + 1)]
    flips = F.get(F.array(*flips), F.bit_count(lead.bitwiseXOR(F.col("cell"))))
    variants = sent.select("fp", "cell", F.explode(flips).alias("flip"))
    variants = variants.withColumn("body", F.col("fp").bitwiseAND((1 << low) - 1).bitwiseXOR(F.col("flip")))
    # no more fingerprints than a ball has members share a variant
    shared = variants.groupBy("cell", "body").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return shared.select(F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("u"), F.get("fps", F.lit(0)).alias("v")).distinct()


def _syndrome_of(x: Column) -> Column:
    """As ``_syndrome``, MOST_SPLIT bits of it."""
    out = F.lit(0)
    for i in range(MOST_SPLIT):
        of = sum(1 << p for p in range(63) if p >> i & 1)  # bodies have fewer bits than 63
        out = out + (F.bit_count(x.bitwiseAND(of)) % 2) * (1 << i)
    return out


def _syndrome(x: np.ndarray, bits: int) -> np.ndarray:
    """The exclusive or of the places of the set bits, its ``bits`` low bits."""
    out = np.zeros(x.shape, np.int64)
    for i in range(6):
        of = np.uint64(sum(1 << p for p in range(64) if p >> i & 1))
        out |= (np.bitwise_count(x & of).astype(np.int64) & 1) << i
    return out & ((1 << bits) - 1)


def cell_links(signed: np.ndarray, cell: int, prefix: int, half: int, bits: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u > v, one a node) of the fingerprints that have a variant in
    common whose leading bits are ``cell`` and whose other bits have a syndrome
    of ``part`` in its ``bits`` low bits."""
    signed = np.sort(signed)
    fps = signed.view(np.uint64)
    low = 64 - prefix
    off = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(cell)) if prefix else np.zeros(len(fps), np.int64)
    body = fps & np.uint64((1 << low) - 1)
    masks = [np.array(_masks(low, n), np.uint64) for n in range(half + 1)]
    parts = [_syndrome(m, bits) for m in masks]
    own = _syndrome(body, bits)
    # (fingerprints, masks) whose combinations are the variants in this part
    blocks = []
    for d in range(half + 1):
        for s in range(1 << bits):
            who = np.flatnonzero((off == d) & (own == s))
            flips = masks[half - d][parts[half - d] == part ^ s]
            step = max(1, HELD_VARIANTS // max(1, len(flips)))
            blocks += [(who[i : i + step], flips) for i in range(0, len(who), step) if len(flips)]
    total = sum(len(w) * len(f) for w, f in blocks)
    slices = -(-total // HELD_VARIANTS)
    a, b = [], []
    for s in range(slices):
        variants, whose = [], []
        for who, flips in blocks:
            x = (body[who][:, None] ^ flips[None, :]).ravel()
            w = np.repeat(who, len(flips))
            if slices > 1:
                here = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices) == s
                x, w = x[here], w[here]
            variants.append(x)
            whose.append(w)
        x, w = np.concatenate(variants), np.concatenate(whose)
        order = np.argsort(x)
        x = x[order]
        same = np.flatnonzero(x[1:] == x[:-1])
        i, j = w[order[same]], w[order[same + 1]]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= 2 * half
        pairs = np.unique(np.minimum(i, j)[near] * len(fps) + np.maximum(i, j)[near])
        a.append(pairs // len(fps))
        b.append(pairs % len(fps))
    if not a:
        return signed[:0], signed[:0]
    return star_edges(signed[np.concatenate(a)], signed[np.concatenate(b)])


def _firsts(found: DataFrame, first: Column, scratch: Scratch, radius: int) -> DataFrame:
    """For each distinct fingerprint fp_: first, the least ``first`` in its
    component, root, the component, and n, how many rows have the fingerprint."""
    distinct = scratch.keep(found.groupBy(F.col("fp").alias("fp_")).agg(F.min(first).alias("own"), F.count("*").alias("n")))
    # a cell's links are stars; a second function in one task would need a second Python worker
    roots = components(links(distinct.select(F.col("fp_").alias("fp")), radius), scratch, contract=False)
    classes = distinct.join(roots, F.col("fp_") == F.col("node"), "left")
    classes = scratch.keep(classes.select("fp_", "own", "n", F.coalesce("root", "fp_").alias("root")))
    by_root = classes.groupBy(F.col("root").alias("root_")).agg(F.min("own").alias("first"), F.count("*").alias("n_fps"))
    return joined_evenly(classes.drop("own"), scratch.keep(by_root), "root", "root_", "n_fps", classes.count())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``key``, fingerprint (16 hexadecimal
    digits), component_id (the least key that links reach, its own included).

    Texts without words, null ones too, have fingerprint zero and are linked
    like any other.  Null keys are passed over for component_id, which is null
    only if all keys of the component are.  Repeated rows stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(fingerprints(docs, key, text))
    named = scratch.keep(_firsts(found, F.col(key), scratch, radius).drop("root"))
    return joined_evenly(found, named, "fp", "fp_", "n", found.count()).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the least key of their component, unchanged:
    one row of each component, whichever of several rows with the same key and
    text.  Null keys come last; of several texts with the least key, that of
    the least hash stays.  All columns are given back, whatever their names; an
    empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(fingerprints(docs, key, text))
    place = F.struct(F.col(key).isNull().alias("no"), F.coalesce(key, F.lit(0)).alias("id"), F.col("text_hash").alias("h"))
    firsts = _firsts(found, place, scratch, radius)
    chosen = scratch.keep(firsts.select("first.*").distinct().select(*(F.col(c).alias("its_" + c) for c in ("no", "id", "h"))))
    own = marked(
        docs,
        no=F.col(key).isNull(),
        id=F.coalesce(F.col(key).cast("long"), F.lit(0)),
        h=text_hash(F.col(text).cast("string")),
    )
    if found.groupBy(key, "text_hash").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["no", "id", "h"])  # where they lie first, so that a row found often meets the join once
    same = (F.col("no") == F.col("its_no")) & (F.col("id") == F.col("its_id")) & (F.col("h") == F.col("its_h"))
    # a hash table of the chosen ids spares the sorting of texts
    return unmarked(own.join(chosen.hint("shuffle_hash"), same, "left_semi"), docs)
