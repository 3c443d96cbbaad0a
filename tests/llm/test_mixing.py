import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from strandline.llm import mixing as M


def slow_targets(sizes, weights):
    total = Fraction(sum(sizes.values()))
    share = {s: total * weights[s] / sum(weights.values()) for s in sizes}
    while True:
        above = {s for s in sizes if share[s] > 3 * sizes[s]}
        if not above:
            return share
        excess = sum(share[s] - 3 * sizes[s] for s in above)
        for s in above:
            share[s] = Fraction(3 * sizes[s])
        rest = [s for s in sizes if share[s] < 3 * sizes[s]]
        if not rest:
            return share
        for s in rest:
            share[s] += excess * weights[s] / sum(weights[r] for r in rest)


def test_targets():
    for seed in range(50):
        rng = random.Random(seed)
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000]) for i in range(rng.randint(1, 8))}
        weights = M.cycling_weights(list(sizes))
        got = M.targets(sizes, weights, sum(sizes.values()))
        assert got == slow_targets(sizes, weights)
    assert M.cycling_weights(["b", None, "B", "a"]) == {"B": 1, "a": 2, "b": 3, None: 1}


def brute_route(sizes, quota):
    """The most words routed, and the least cost of doing so, over all integer
    flows of a small network."""
    patterns, sources = list(sizes), list(quota)
    uses = [(p, s) for p in patterns for s in p]
    best = (-1, 0)

    def go(i, used, got):
        nonlocal best
        if i == len(uses):
            words = sum(got.values())
            cost = sum(sum((2 * t + 1) * min(sizes[p], max(0, used[p] - t * sizes[p])) for t in range(3)) for p in patterns)
            best = max(best, (words, -cost))
            return
        p, s = uses[i]
        for x in range(min(3 * sizes[p] - used[p], quota[s] - got[s]) + 1):
            go(i + 1, {**used, p: used[p] + x}, {**got, s: got[s] + x})

    go(0, dict.fromkeys(patterns, 0), dict.fromkeys(sources, 0))
    return best


@pytest.mark.parametrize(
    "sizes, quota",
    [
        ({("a",): 2, ("a", "b"): 3, ("b",): 1}, {"a": 6, "b": 5}),
        ({("a", "b"): 2, ("b", "c"): 2}, {"a": 4, "b": 3, "c": 2}),
        ({("a",): 1, ("b",): 4}, {"a": 5, "b": 3}),
    ],
)
def test_flow_is_the_cheapest_of_the_largest(sizes, quota):
    routed = M.route(sizes, quota)
    used = {p: sum(f.values()) for p, f in routed.items()}
    words = sum(used.values())
    cost = sum(sum((2 * t + 1) * min(sizes[p], max(0, used[p] - t * sizes[p])) for t in range(3)) for p in sizes)
    assert (words, -cost) == brute_route(sizes, quota)
    for s in quota:
        assert sum(f.get(s, 0) for f in routed.values()) <= quota[s]


def rows_of(seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c", "dé", None])) for i in range(600)]
    return rows + [(7, "x y z", "b")] * 50 + [(None, None, "a"), (601, "", "b"), (602, "\u0085 a\x0bb", None)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 32)
    rows = rows_of()
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken int")
    got = M.mix_sources(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = slow_targets(sizes, M.cycling_weights(list(sizes)))
    assert Counter((r.doc_id, r.size, r.source_size, r.target) for r in got) == Counter(
        (i, size(t), sizes[s], float(goal[s])) for i, t, s in rows
    )
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    by = {}
    for r in got:
        by[r.source_size] = by.get(r.source_size, 0) + r.taken
    for s, n in sizes.items():
        assert abs(by[n] - goal[s]) <= 5  # far less than a document
    again = M.mix_sources(df.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rows_as_often_as_taken(spark):
    rows = rows_of(4)[:600]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken int")
    want = {r.doc_id: r.taken // r.size for r in M.mix_sources(df).collect()}
    got = M.mixed_rows(df).collect()
    assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in want.items() if v})
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "taken"}


def test_overlap(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(90)],
        "doc_id long, text string, sources array<string>",
    )
    mix = M.Mix(df, F.col("sources"), weights=lambda s: {"a": 1, "b": 3})
    taken = {}
    for r in mix.taken().collect():
        taken[r._pattern] = taken.get(r._pattern, 0) + r.taken
    assert mix.targets == {"a": 225, "b": 675}
    assert 870 < sum(taken.values()) <= 900  # whole documents of 10 words, three patterns
    assert taken['["b"]'] + taken['["a","b"]'] > 655


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_sources(df).count() == 0 and M.mixed_rows(df).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r.taken for r in M.mix_sources(nothing).collect()} == {0}
    assert M.mixed_rows(nothing).count() == 0
