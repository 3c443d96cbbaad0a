"""Connected components of links that lie in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, joined_evenly

_EDGE = "u long, v long"


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each node that is not the least of its
    component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Links (u, v) with the same components and u > v, at most one a node in
    each stretch of ``most`` links of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0

        def out():
            a, b = star_edges(np.concatenate(u), np.concatenate(v))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= most:
                yield out()
                u, v, held = [], [], 0
        if held:
            yield out()

    return edges.mapInArrow(run, _EDGE)


def components(edges: DataFrame, scratch: Scratch, contract: bool = True) -> DataFrame:
    """Columns node and root: each node of ``edges`` (u, v long) that is not the
    least of its component, and that least node.

    Links are first contracted within partitions, unless ``contract`` is False
    because they come so, with u > v; then large-star and small-star steps
    alternate (Kiveris and others, "Connected Components in MapReduce and
    Beyond") until all links are stars about least nodes.  All links stay in
    tables; each step is written to the shared folder, no step gathers a node's
    neighbours, and those of a node with many are spread.  No links give no
    rows.
    """
    edges = edges.where("u <> v")
    stars = scratch.keep((contracted(edges) if contract else edges).distinct())
    while not _done(stars):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.keep(_to_least(both, both.where("v > u"), scratch).distinct())
        next_ = scratch.keep(_to_least(large, large, scratch, own=True).distinct())
        scratch.drop(stars, large)
        stars = next_
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _to_least(neighbours: DataFrame, moved: DataFrame, scratch: Scratch, own: bool = False) -> DataFrame:
    """For each link (u, v) of ``moved``, v linked to u's least neighbour or
    itself; with ``own``, u as well."""
    least = neighbours.groupBy(F.col("u").alias("u_")).agg(F.min("v").alias("least"), F.count("*").alias("n"))
    least = scratch.keep(least)
    joined = joined_evenly(moved, least, "u", "u_", "n", neighbours.count()).withColumn("m", F.least("u", "least"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.union(least.select(F.col("u_").alias("u"), F.least("u_", "least").alias("v")))
    return out.where("u > v")


def _done(stars: DataFrame) -> bool:
    """Whether each node has one link and no centre has any."""
    if stars.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    centres = stars.select(F.col("v").alias("c")).distinct()
    return not stars.join(centres, F.col("u") == F.col("c"), "left_semi").limit(1).count()
