import random
import re

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash as S
from strandline.llm.common import Scratch
from strandline.llm.graph import components, local_roots


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute(fps):
    roots = local_roots(len(fps), *map(np.array, zip(*[(i, j) for i in range(len(fps)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 4])))
    return roots.tolist()


def near_fps(n, seed=3):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n // 5)]
    while len(fps) < n:
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b C d", "A b\u0085c d É f g", "x " * 500, "the end of the line " * 3000])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("cell, ways", [(1 << 20, "whole"), (20000, "split"), (1500, "both"), (300, "one by one")])
def test_links_keep_the_components_of_all_close_pairs(spark, monkeypatch, cell, ways):
    """With small cells they are split by syndrome; with smaller ones variants
    are sent one by one."""
    monkeypatch.setattr(S, "CELL_VARIANTS", cell)
    monkeypatch.setattr(S, "MOST_PREFIX", 4)
    used, single = [], S._variant_links
    monkeypatch.setattr(S, "_variant_links", lambda *a: used.append(1) or single(*a))
    fps = near_fps(240)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark)
    roots = {r.node: r.root for r in components(S.links(df), scratch).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) < len(fps)
    assert bool(used) == (ways in ("both", "one by one"))


def test_one_hot_cell(spark, monkeypatch):
    """All fingerprints agree in their leading bits, and most have one root."""
    monkeypatch.setattr(S, "CELL_VARIANTS", 4000)
    monkeypatch.setattr("strandline.llm.common.HOT_KEYS", 8)
    fps = [x >> 20 for x in near_fps(200, 5)] + [1 << i for i in range(40)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(S.links(df), Scratch(spark)).collect()}
    got, want = [roots.get(x, x) for x in fps], brute(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) < len(fps)


def test_a_cell_in_slices(monkeypatch):
    fps = near_fps(240, 9)
    a = np.array(fps, np.uint64).view(np.int64)
    whole = S.cell_links(a, 0, 0, 2, 0, 0)
    monkeypatch.setattr(S, "HELD_VARIANTS", 5000)
    assert [x.tolist() for x in S.cell_links(a, 0, 0, 2, 0, 0)] == [x.tolist() for x in whole]


def docs_of():
    base = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 30
    rng = random.Random(1)
    words = base.split()
    near = words.copy()
    near[50] = "changed"
    other = [" ".join(rng.sample(words, len(words))) for _ in range(5)]
    texts = [base, base, " ".join(near), *other, None, "", " \t", base.upper()]
    return [(10 + i, t, "extra") for i, t in enumerate(texts)] + [(10, base, "again"), (None, base, "null"), (None, None, None)]


def test_documents(spark):
    rows = docs_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    roots = brute(fps)
    ids = lambda k: [rows[i][0] for i in range(len(rows)) if roots[i] == k and rows[i][0] is not None]
    want = sorted(((rows[i][0], f"{fps[i]:016x}", min(ids(roots[i]), default=None)) for i in range(len(rows))), key=repr)
    assert got == want
    kept = S.keep_one(df).collect()
    assert len(kept) == len(set(roots)) and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert sorted(r.doc_id for r in kept) == sorted(min(ids(k)) for k in set(roots))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0


def test_long_chains_of_links(spark):
    n = 3000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(10**6 + i, 10**6) for i in range(1, 50)] + [(5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges.repartition(7), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {10**6 + i: 10**6 for i in range(1, 50)}


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)
