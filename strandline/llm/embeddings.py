"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2c) of each
other, and so do their projections on any orthonormal directions.  Vectors are
sorted by the cells, eps wide, of their leading principal coordinates (Böhm and
others, "Epsilon Grid Order").  The sorted sequence is cut into intervals, those
into shorter ones, and so on down to blocks; pairs of intervals are joined from
the longest down, and a pair goes on only if the bounding boxes of its two come
within eps.  Pairs of blocks that are left meet in a task, which halves both
until the halves are provably distant or small enough to multiply.

Equal vectors with one label are one node from the start.  A joined pair of
blocks gives a count of links per node and links that keep its components,
never all pairs.  The directions come from at most ``FIT_ROWS`` vectors; they
decide how much is skipped, not what is found.

A block is sent once for each block it meets, so its size decides how many
bytes are moved for a product: all pairs of n near vectors move n / BLOCK times
their bytes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, joined_evenly
from strandline.llm.graph import components, local_roots

COSINE = 0.93
FIT_ROWS, DIMENSIONS = 4096, 8
#: Vectors of a block at most, and numbers; vectors of an interval that is multiplied.
BLOCK, BLOCK_NUMBERS, LEAF = 4096, 1 << 21, 64
#: Intervals that the next longer one is made of, as bits; and links held at once.
FAN, HELD_LINKS = 6, 1 << 20
#: Rounding of projections and boxes stays far below this.
SLACK = 1e-6

_BLOCKS = "block long, label long, dim int, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary"


def valid(vector: Column) -> Column:
    """Whether a vector is there, with finite components only and not all 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(nodes: DataFrame, fit_rows: int, most: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each length of vectors."""
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("vector").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    found = {}
    for dim, rows in by_dim.items():
        x = _unit(np.array(rows, np.float64))
        _, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
        found[dim] = vectors[:, ::-1][:, : min(most, dim)]
    return found


def _fixed(basis: np.ndarray | None, dim: int, most: int) -> np.ndarray:
    """Coordinates take the place of directions for lengths not in the sample."""
    return basis if basis is not None else np.eye(dim)[:, : min(most, dim)]


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, their places and the vectors as a matrix."""
    start = vectors.offsets.to_numpy()
    flat, sizes, start = vectors.flatten().to_numpy(), np.diff(start), start[:-1] - start[0]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)


def _sorted_blocks(nodes: DataFrame, eps: float, bases: dict, dims: int, block: int, number: str) -> DataFrame:
    """Blocks of up to ``block`` nodes of one label and length, in grid order;
    ``number`` is the numpy type in which vectors are packed.  A block's number
    is its partition's, 32 bits up, and its place there, so that numbers follow
    the order."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [None] * batch.num_rows
            for rows, x in _matrices(batch.column("vector")):
                at = np.floor(_unit(x) @ _fixed(bases.get(x.shape[1]), x.shape[1], dims) / eps).astype(np.int32)
                for row, cell in zip(rows.tolist(), at.tolist()):
                    cells[row] = cell
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"]
            )

    kind = nodes.schema["vector"].dataType.simpleString()
    placed = nodes.select("node", "label", "copies", "vector", F.size("vector").alias("dim")).mapInArrow(
        project, f"node long, label long, copies long, vector {kind}, dim int, cells array<int>"
    )
    n = nodes.count()
    parts = max(1, min(256, -(-n // (2 * block))), -(-n // (64 * block)))
    order = ["label", "dim", "cells", "node"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        label, held, size = None, [], 0  # of one label and length

        def out() -> pa.RecordBatch:
            x = np.concatenate([h[2] for h in held])
            p = _unit(x) @ _fixed(bases.get(x.shape[1]), x.shape[1], dims)
            nodes, copies = (np.concatenate([h[i] for h in held]).astype("<i8").tobytes() for i in (0, 1))
            row = (next(numbers), label, x.shape[1], p.min(axis=0).tolist(), p.max(axis=0).tolist(), nodes, copies, x.astype(number).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            labels, node, copies = (batch.column(c).to_numpy() for c in ("label", "node", "copies"))
            for rows, x in _matrices(batch.column("vector")):  # lengths of a label come in order
                most = max(1, min(block, BLOCK_NUMBERS // x.shape[1]))
                cuts = np.flatnonzero(labels[rows][1:] != labels[rows][:-1]) + 1
                for run in np.split(np.arange(len(rows)), cuts):
                    while len(run):
                        if held and (label != labels[rows[run[0]]] or held[0][2].shape[1] != x.shape[1] or size >= most):
                            yield out()
                            held, size = [], 0
                        label, part = labels[rows[run[0]]], run[: most - size]
                        held.append((node[rows[part]], copies[rows[part]], x[part]))
                        size, run = size + len(part), run[len(part) :]
        if held:
            yield out()

    return ordered.mapInArrow(pack, _BLOCKS)


def _near_blocks(blocks: DataFrame, eps: float, dims: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of blocks whose boxes come within eps.

    The intervals of a level are the blocks, then partitions, then runs of
    2**FAN of the level below, until at most that many are left.  Pairs of the
    longest intervals of a label come first; each goes on to pairs of its two
    intervals' parts.
    """
    top, last = 1, (blocks.agg(F.max("block")).first()[0] or 0) >> 32
    while last >> FAN * top:
        top += 1
    at = lambda c, level: F.shiftright(c, 32 + FAN * (level - 1)) if level else F.col(c)

    def intervals(level: int, side: str) -> DataFrame:
        box = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(dims)])
        own = blocks.groupBy("label", "dim", at("block", level).alias("id"), at("block", min(level + 1, top)).alias("up"))
        own = own.agg(box(F.min, "lo").alias("lo"), box(F.max, "hi").alias("hi"))
        return own.select(*(F.col(c).alias(f"{side}_{c}") for c in own.columns))

    gap = F.aggregate(
        F.zip_with(
            F.arrays_zip("a_lo", "a_hi"),
            F.arrays_zip("b_lo", "b_hi"),
            lambda p, q: F.greatest(p.a_lo - q.b_hi, q.b_lo - p.a_hi, F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    # the boxes of a label's longest intervals, at most 2**FAN
    kind = (F.col("a_label") == F.col("b_label")) & (F.col("a_dim") == F.col("b_dim"))
    meet = lambda pairs: pairs.where((F.col("a_id") <= F.col("b_id")) & (gap <= eps * eps)).select(
        F.col("a_label").alias("label"), F.col("a_dim").alias("dim"), F.col("a_id").alias("a"), F.col("b_id").alias("b")
    )
    pairs = meet(intervals(top, "a").join(intervals(top, "b"), kind))
    for level in reversed(range(top)):
        pairs = scratch.keep(pairs)
        for s in "ab":
            own = (F.col("label") == F.col(f"{s}_label")) & (F.col("dim") == F.col(f"{s}_dim")) & (F.col(s) == F.col(f"{s}_up"))
            pairs = pairs.join(intervals(level, s), own)
        pairs = meet(pairs)
    return pairs.where("a < b").select("a", "b")


def _joined(xa: np.ndarray, pa_: np.ndarray, xb: np.ndarray, pb: np.ndarray, cosine: float, eps: float, same: bool):
    """Links between two intervals of unit vectors, as index pairs in blocks of
    the product matrix: (first row, first column, matrix of links)."""
    todo = [(0, len(xa), 0, len(xb))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue  # the other half has these
        p, q = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            dots = xa[a0:a1] @ xb[b0:b1].T
            hit = dots >= cosine
            edge = np.argwhere(np.abs(dots - cosine) < 1e-12)
            for i, j in edge:  # the sum in a fixed order decides
                hit[i, j] = float((xa[a0 + i] * xb[b0 + j]).sum()) >= cosine
            if same:
                hit &= (np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :])
            if hit.any():
                yield a0, b0, hit
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            todo += [(a0, a1, b0, m), (a0, a1, m, b1)]


def block_links(a: dict, b: dict | None, basis: np.ndarray, cosine: float, eps: float, number: str = "<f8"):
    """(nodes, links of each to others' rows, u, v): the links within the pair
    of blocks, or within a block if ``b`` is None, counted by rows of the
    table, and links u > v that keep its components."""
    same = b is None
    nodes, copies, x = [], [], []
    for side in (a,) if same else (a, b):
        nodes.append(np.frombuffer(side["nodes"], "<i8"))
        copies.append(np.frombuffer(side["copies"], "<i8"))
        packed = np.frombuffer(side["vectors"], number).astype(np.float64)
        x.append(_unit(packed.reshape(len(nodes[-1]), -1)))
    x = x * 2 if same else x
    p = [y @ basis for y in x]
    off = 0 if same else len(nodes[0])
    node, copy = np.concatenate(nodes), np.concatenate(copies)
    count = np.zeros(len(node), np.int64)
    every = np.arange(len(node))
    root, held, links = every, 0, [[], []]

    def contracted() -> np.ndarray:
        return local_roots(len(node), np.concatenate([root, *links[0]]), np.concatenate([every, *links[1]]))

    for a0, b0, hit in _joined(x[0], p[0], x[1], p[1], cosine, eps, same):
        rows, cols = slice(a0, a0 + hit.shape[0]), slice(off + b0, off + b0 + hit.shape[1])
        count[rows] += hit @ copy[cols]
        count[cols] += hit.T @ copy[rows]
        i, j = np.nonzero(hit)
        links[0].append(a0 + i), links[1].append(off + b0 + j)
        held += len(i)
        if held >= HELD_LINKS:
            root, held, links = contracted(), 0, [[], []]
    root = contracted()
    linked = count > 0
    other = root != every
    u, v = node[other], node[root[other]]
    return node[linked], count[linked], np.maximum(u, v), np.minimum(u, v)


def _pair_results(blocks: DataFrame, cosine: float, eps: float, bases: dict, dims: int, number: str, scratch: Scratch) -> DataFrame:
    """Rows (u, v, n): links (u, v), and counts n of links of node u."""
    columns = ("dim", "nodes", "copies", "vectors")
    near = scratch.keep(_near_blocks(blocks, eps, dims, scratch))
    side = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    pairs = near.join(side("a"), F.col("a") == F.col("a_block")).join(side("b"), F.col("b") == F.col("b_block"))
    alone = side("a").drop("a_block")  # where they lie

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                a, b = ({k[2:]: v for k, v in r.items() if k.startswith(s)} for s in ("a_", "b_"))
                node, n, u, v = block_links(a, b or None, _fixed(bases.get(a["dim"]), a["dim"], dims), cosine, eps, number)
                none = np.full(len(u), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[u, node], pa.int64()),
                        pa.array(np.r_[v, np.full(len(node), -1)], pa.int64()),
                        pa.array(np.r_[none, n], pa.int64()),
                    ],
                    names=["u", "v", "n"],
                )

    found = "u long, v long, n long"
    return alone.mapInArrow(run, found).unionByName(pairs.drop("a", "b", "a_block", "b_block").mapInArrow(run, found))


def _identity(whole: bool) -> Column:
    """What stands for a label and a vector: 128 bits of hashes, or with
    ``whole`` the vector itself."""
    if whole:
        return F.struct("label", "vector")
    return F.struct("label", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"))


def linked_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    fit_rows: int = FIT_ROWS,
    dims: int = DIMENSIONS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: key, n_links (other rows linked directly),
    component_id (the least key that links reach), kept (key = component_id).

    Rows link if their labels are equal and not null, their vectors have one
    length, and their cosine in double precision is at least ``cosine``.  Null
    vectors, null labels, vectors that are all 0 or hold a null or non-finite
    component link with nothing: n_links 0, and their own component.  Repeated
    rows link with each other.  A null key is passed over for component_id and
    not kept.  Other columns are not read; an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be over 0 and at most 1")
    scratch = Scratch(df.sparkSession)
    # single precision is moved as it is, and multiplied in double precision
    kind, number = ("float", "<f4") if df.schema[vector].dataType.simpleString() == "array<float>" else ("double", "<f8")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    zero = F.lit(0.0).cast(kind)
    x = F.transform(F.col(vector), lambda c: F.when(c.cast(kind) == zero, zero).otherwise(c.cast(kind)))  # one zero only
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), x.alias("vector"))
    ok = F.coalesce(F.col("label").isNotNull() & valid(F.col("vector")), F.lit(False))
    nodes = (
        rows.where(ok)
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("key").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = scratch.keep(nodes)  # the numbers hold from here on
    bases = _directions(nodes, fit_rows, dims)
    blocks = scratch.keep(_sorted_blocks(nodes, eps, bases, dims, block, number))
    found = scratch.keep(_pair_results(blocks, cosine, eps, bases, dims, number, scratch))
    roots = components(found.where("n < 0").select("u", "v"), scratch)
    counts = found.where("n >= 0").groupBy(F.col("u").alias("c_node")).agg(F.sum("n").alias("others"))

    # rows find their nodes by hashes, after a look that no two nodes share them
    slim = nodes.select("node", "copies", "least", _identity(False).alias("is"))
    whole = bool(slim.groupBy("is").count().where("count > 1").limit(1).count())
    slim = nodes.select("node", "copies", "least", _identity(whole).alias("is"))
    known = slim.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").join(
        counts, F.col("node") == F.col("c_node"), "left"
    )
    known = scratch.keep(
        known.select(
            "is",
            "copies",
            F.coalesce("root", "node").alias("root"),
            "least",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        )
    )
    least = known.groupBy(F.col("root").alias("l_root")).agg(F.min("least").alias("component"), F.count("*").alias("n_nodes"))
    named = joined_evenly(known, scratch.keep(least), "root", "l_root", "n_nodes", known.count())
    named = scratch.keep(named.select("is", "copies", "links", "component"))
    each = scratch.keep(rows.select("key", F.when(ok, _identity(whole)).alias("its")))
    valid_rows = each.where("its is not null")
    linked = joined_evenly(valid_rows, named, "its", "is", "copies", valid_rows.count())
    alone = each.where("its is null").select("key", "its", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key),
        F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"),
    )
