import math
import random

import numpy as np
import pytest

from strandline.llm import embeddings as E


def brute(rows, c):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
                v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= c:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, dims, fan", [(256, 8, 6), (8, 3, 6), (4, 2, 1)])
def test_links_are_those_of_brute_force(spark, monkeypatch, block, dims, fan):
    """With small blocks and a narrow fan, pairs go down several levels."""
    monkeypatch.setattr(E, "FAN", fan)
    monkeypatch.setattr(E, "HELD_LINKS", 100)
    monkeypatch.setattr("strandline.llm.common.HOT_KEYS", 8)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(8)]
    rows = []
    for i in range(260):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.22) for x in c], rng.randrange(3)))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(40)]  # copies
    rows += [(400, None, 1), (401, rows[3][1], None), (402, [0.0] * 12, 1), (403, [math.nan] * 12, 1), (404, [math.inf] + [1.0] * 11, 1),
             (405, [None] + [1.0] * 11, 1), (406, rows[5][1][:6], rows[5][2]), (None, rows[7][1], rows[7][2]), (8, rows[8][1], rows[8][2]), (407, [], 1),
             (408, [0.0, -0.0, *rows[9][1][2:]], 1), (409, [-0.0, 0.0, *rows[9][1][2:]], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = sorted(map(tuple, E.linked_vectors(df, cosine=0.93, block=block, dims=dims).collect()), key=repr)
    want = brute(rows, 0.93)
    assert got == want
    assert len({w[2] for w in want}) > 10 and any(w[1] > 5 for w in want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.linked_vectors(df).count() == 0


def test_hashes_that_two_vectors_share(spark, monkeypatch):
    """Then rows are joined by the vectors themselves."""
    rows = [(i, [math.cos(a), math.sin(a)], 1) for i, a in enumerate((0.0, 0.1, 1.5, 1.6, 3.0, 0.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, E.linked_vectors(df).collect()))
    assert [w[1] for w in want] == [2, 2, 1, 1, 0, 2]
    whole = E._identity
    monkeypatch.setattr(E, "_identity", lambda w: whole(True) if w else E.F.struct("label"))
    assert sorted(map(tuple, E.linked_vectors(df).collect())) == want


def test_long_vectors_make_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_NUMBERS", 50)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)], i % 2) for i in range(40)]
    rows += [(100 + i, [x + rng.gauss(0, 0.05) for x in rows[i][1]], rows[i][2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.linked_vectors(df).collect()), key=repr) == brute(rows, 0.93)
