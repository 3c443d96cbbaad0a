"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are counted by the pattern
of sources they belong to; a flow network routes each pattern's words to the
quotas of its sources.  A pattern offers its words once, twice and a third
time, each time at a higher cost a word, so that the cheapest flow repeats as
little as the quotas allow.  The flow through a pattern says how many whole
times its documents are taken and how many words more; the further words come
from documents in the order of a seeded hash.

Only sums by pattern and one row a pattern reach the driver, at most
``MOST_PATTERNS``; more are an error.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import WORD, Scratch, dealt_out, marked, present, unmarked

SEED = 17
MOST_TIMES = 3
MOST_PATTERNS = 4096
#: Documents in a bucket of a pattern, about; and buckets of a pattern at most.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16
#: Rows of boundary decisions that are sent to every executor at most.
MOST_SENT = 1 << 17


def words_of(text: Column) -> Column:
    """The number of words of a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: Sequence[str | None]) -> dict[str | None, int]:
    """Weights 1, 2, 3, 1, 2, ... for sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def targets(sizes: dict, weights: dict, total: int, most: int = MOST_TIMES) -> dict[str | None, Fraction]:
    """Each source's share of ``total`` by weight, at most ``most`` times its
    size; what is above goes to the others by weight, until none is above."""
    found: dict[str | None, Fraction] = {}
    rest = Fraction(total)
    open_ = {s for s in sizes if weights.get(s, 0) > 0}
    found.update({s: Fraction(0) for s in sizes if s not in open_})
    while open_:
        per = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if per * weights[s] > most * sizes[s]}
        if not full:
            found.update({s: per * weights[s] for s in open_})
            break
        for s in full:
            found[s] = Fraction(most * sizes[s])
            rest -= found[s]
        open_ -= full
    return found


class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.edges: list[list] = []  # to, capacity left, cost; the reverse edge follows
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for at, to, cap, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.at[at].append(len(self.edges))
            self.edges.append([to, cap, c])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.at)  # costs are not negative at first
        while True:
            far = {source: 0}
            via: dict[int, int] = {}
            row = [(0, source)]
            while row:
                d, at = heapq.heappop(row)
                if d > far[at]:
                    continue
                for e in self.at[at]:
                    to, cap, cost = self.edges[e]
                    if cap and (new := d + cost + height[at] - height[to]) < far.get(to, 1 << 62):
                        far[to], via[to] = new, e
                        heapq.heappush(row, (new, to))
            if sink not in far:
                return
            for i in range(len(height)):
                height[i] += min(far.get(i, far[sink]), far[sink])
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def route(sizes: dict[tuple, int], quota: dict, most: int = MOST_TIMES) -> dict[tuple, dict]:
    """Words from each pattern (a tuple of sources) to each of its sources, so
    that quotas are met as far as can be and repetition costs least."""
    # of flows that cost the same the first found counts, so the order is fixed
    by_code_point = lambda s: (s is None, s or "")
    patterns, sources = sorted(sizes, key=lambda p: [*map(by_code_point, p)]), sorted(quota, key=by_code_point)
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    flow = Flow(end + 1)
    uses = []
    for i, p in enumerate(patterns):
        for time in range(most):
            flow.edge(start, i, sizes[p], 2 * time + 1)  # the marginal costs of a square
        for s in p:
            if s in place:
                uses.append((p, s, flow.edge(i, place[s], most * sizes[p], 0)))
    for s in sources:
        flow.edge(place[s], end, round(quota[s]), 0)
    flow.run(start, end)
    routed: dict[tuple, dict] = {p: {} for p in patterns}
    for p, s, e in uses:
        routed[p][s] = flow.edges[e ^ 1][1]
    return routed


def _pattern(membership: Column) -> Column:
    """The sources of a document, sorted, as JSON; null is a source too."""
    none = F.array().cast("array<string>")
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(membership.cast("array<string>"), none))))


class Mix:
    """A mix that is decided: how often each document is taken.

    ``docs`` needs ``membership``, an array of sources.  ``whole`` treats
    repeated rows (alike in sources, key and size) as one; otherwise some of
    them may be taken once more than others.
    """

    def __init__(
        self,
        docs: DataFrame,
        membership: Column,
        key: str = "doc_id",
        text: str = "text",
        weights=cycling_weights,
        most: int = MOST_TIMES,
        seed: int = SEED,
        whole: bool = False,
    ):
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)
        self.key, self.text, self.membership, self.most, self.seed = key, text, membership, most, seed
        rows = self._placed(docs).groupBy("_pattern", "_key", "_size").agg(F.count("*").alias("_n"))
        self.alike = self.scratch.keep(rows.withColumn("_order", self._order()))
        sums = (
            self.alike.groupBy("_pattern")
            .agg(F.sum(F.col("_size") * F.col("_n")).alias("size"), F.count("*").alias("rows"), F.max("_n").alias("most"))
            .limit(MOST_PATTERNS + 1)
            .collect()
        )
        if len(sums) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
        self.most_alike = max((r["most"] for r in sums), default=0)
        sizes = {r["_pattern"]: r["size"] for r in sums}
        of = {p: tuple(json.loads(p)) for p in sizes}
        self.source_sizes: dict[str | None, int] = {}
        for p, size in sizes.items():
            for s in of[p]:
                self.source_sizes[s] = self.source_sizes.get(s, 0) + size
        total = sum(size for p, size in sizes.items() if of[p])
        self.targets = targets(self.source_sizes, weights(list(self.source_sizes)), total, most)
        routed = route({of[p]: size for p, size in sizes.items()}, self.targets, most)
        self.plan: dict[str, dict] = {}
        for r in sums:
            p, size = r["_pattern"], r["size"]
            words = sum(routed[of[p]].values())
            times = words // size if size else 0
            buckets = min(MOST_BUCKETS, max(1, -(-r["rows"] // BUCKET_ROWS)))
            self.plan[p] = {"times": times, "rest": words - times * size, "buckets": buckets, "edge": 0, "left": 0}
        self._find_edges()
        self.boundary = self.scratch.keep(self._decided(whole))

    def _placed(self, docs: DataFrame) -> DataFrame:
        return docs.select(
            _pattern(self.membership).alias("_pattern"),
            present(docs, self.key, "long").alias("_key"),
            words_of(F.col(self.text).cast("string")).alias("_size"),
        )

    def _order(self) -> Column:
        """A seeded place from 0 to 1 of a document in its pattern."""
        h = F.xxhash64(F.lit(self.seed), "_pattern", "_key", "_size")
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))

    def _planned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their pattern's plan; one row a pattern is broadcast."""
        plan = self.spark.createDataFrame(
            [(p, x["times"], x["rest"], x["buckets"], x["edge"], x["left"]) for p, x in self.plan.items()],
            "_p string, _times long, _rest long, _buckets long, _edge long, _left long",
        )
        joined = rows.join(F.broadcast(plan), F.col("_pattern") == F.col("_p"))
        return joined.withColumn("_bucket", F.floor(F.col("_order") * F.col("_buckets")).cast("long"))

    def _find_edges(self) -> None:
        """The bucket of each pattern in which its further words run out, and
        the words left for it."""
        if not self.plan:
            return
        sums = self._planned(self.alike).groupBy("_pattern", "_rest", "_bucket").agg(
            F.sum(F.col("_size") * F.col("_n")).alias("_total")
        )
        so_far = W.partitionBy("_pattern").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("_start", F.coalesce(F.sum("_total").over(so_far), F.lit(0)))
        edges = sums.where("_start <= _rest and _rest < _start + _total")
        for r in edges.collect():  # one a pattern
            self.plan[r["_pattern"]] |= {"edge": r["_bucket"], "left": r["_rest"] - r["_start"]}

    def _decided(self, whole: bool) -> DataFrame:
        """For each group of like documents in a boundary bucket, how many of
        them are taken once more: in seeded order, all that still fit."""

        def choose(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["_order", "_key", "_size"])
            left = int(rows["_left"].iloc[0])
            more = []
            for size, n in zip(rows["_size"].tolist(), rows["_n"].tolist()):
                k = min(n, left // size) if size else 0
                if whole and k < n:
                    k = 0
                left -= k * size
                more.append(k)
            return rows[["_pattern", "_key", "_size"]].assign(_more=more)

        rows = self._planned(self.alike).where("_bucket = _edge and _rest > 0")
        return rows.groupBy("_pattern").applyInPandas(choose, "_pattern string, _key long, _size long, _more long")

    def _more(self, rows: DataFrame) -> DataFrame:
        """``rows`` with _more, the number of like documents taken once more."""
        decided = self.boundary.select(*(F.col(c).alias("d" + c) for c in self.boundary.columns))
        if self.boundary.count() <= MOST_SENT:
            decided = F.broadcast(decided)
        same = (
            (F.col("_pattern") == F.col("d_pattern"))
            & F.col("_key").eqNullSafe(F.col("d_key"))
            & (F.col("_size") == F.col("d_size"))
        )
        before = F.when(F.col("_bucket") < F.col("_edge"), F.col("_n")).otherwise(0)
        return self._planned(rows).join(decided, same, "left").withColumn("_more", F.coalesce("d_more", before))

    def taken(self) -> DataFrame:
        """One row for each row of the documents: key, _pattern, size and taken
        (words taken, repeats counted)."""
        rows = dealt_out(self._more(self.alike), "_n", self.most_alike)
        times = F.col("_times") + F.when(F.col("_copy") < F.col("_more"), 1).otherwise(0)
        return rows.select(
            F.col("_key").alias(self.key),
            "_pattern",
            F.col("_size").alias("size"),
            (F.col("_size") * times).alias("taken"),
        )

    def rows(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` as often as they are taken.  Like documents
        count as one here: ``whole`` must hold."""
        rows = marked(
            docs,
            _pattern=_pattern(self.membership),
            _key=present(docs, self.key, "long"),
            _size=words_of(F.col(self.text).cast("string")),
            _n=F.lit(1).cast("long"),
        ).withColumn("_order", self._order())
        times = F.col("_times") + F.when(F.col("_more") > 0, 1).otherwise(0)
        often = self._more(rows).where(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), times)))
        return unmarked(often, docs)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``, each in the one source its column names:
    key, size (words), source_size, target (its source's, in words), taken.

    Null sources are a source, the last; null texts have size 0 and nothing is
    taken of them; repeated rows are counted each.  An empty table gives no
    rows.  A source's taken words miss its target by less than the size of one
    of its documents.
    """
    mix = Mix(docs, F.array(present(docs, source, "string")), key, text)
    sources = docs.sparkSession.createDataFrame(
        [(json.dumps([s], ensure_ascii=False, separators=(",", ":")), size, float(mix.targets[s])) for s, size in mix.source_sizes.items()],
        "_json string, source_size long, target double",
    ).select(F.to_json(F.from_json("_json", "array<string>")).alias("_source"), "source_size", "target")
    # one row a source, MOST_PATTERNS at most
    return (
        mix.taken()
        .join(F.broadcast(sources), F.col("_pattern") == F.col("_source"))
        .select(key, "size", "source_size", "target", "taken")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, unchanged, each as often as the mix takes it: not
    at all, or up to MOST_TIMES times.

    Null texts have no words and are not taken; a null source is a source.  Rows
    alike in source, key and number of words are taken equally often.  All
    columns are given back, whatever their names; an empty table gives no rows.
    """
    return Mix(docs, F.array(present(docs, source, "string")), key, text, whole=True).rows(docs)
