"""Holds op3_grid_join and op4_simhash against brute force over whole tables.

    python tests/llm/brute_force.py /root/testdata/check_s

Every pair of vectors with one label, and every pair of distinct fingerprints,
is compared, in blocks, by numpy on the driver: minutes for tens of thousands
of rows, so this is no test of the suite.
"""

import os
import sys

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from strandline.llm import queries, simhash  # noqa: E402
from strandline.llm.common import table  # noqa: E402
from strandline.llm.graph import local_roots  # noqa: E402
from strandline.session import session  # noqa: E402


def components(n, pairs):
    a, b = (np.concatenate([p[i] for p in pairs] or [np.empty(0, int)]) for i in (0, 1))
    return local_roots(n, a, b)


def vectors(spark, sf_dir, cosine=0.93):
    rows = sorted(table(spark, sf_dir, "embeddings").collect(), key=lambda r: r.vec_id)
    ids = np.array([r.vec_id for r in rows])
    ok = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
    by = {}
    for i, r in enumerate(rows):
        if r.label is not None and ok(r.embedding):
            by.setdefault((r.label, len(r.embedding)), []).append(i)
    links, pairs = np.zeros(len(rows), int), []
    for own in by.values():
        at = np.array(own)
        x = np.array([rows[i].embedding for i in own], np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for start in range(0, len(at), 1024):
            i, j = np.nonzero(x[start : start + 1024] @ x.T >= cosine)
            i, j = i[(i + start) != j] + start, j[(i + start) != j]
            np.add.at(links, at[i], 1)
            pairs.append((at[i], at[j]))
    least = ids[components(len(rows), pairs)]
    want = {(int(k), int(n), int(c), bool(k == c)) for k, n, c in zip(ids, links, least)}
    got = {tuple(r) for r in queries.op3_grid_join(spark, sf_dir).collect()}
    return len(rows), len(got ^ want)


def fingerprints(spark, sf_dir, radius=4):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    distinct, where = np.unique(np.array(fps, np.uint64), return_inverse=True)
    pairs = []
    for start in range(0, len(distinct), 256):
        i, j = np.nonzero(np.bitwise_count(distinct[start : start + 256, None] ^ distinct[None, :]) <= radius)
        pairs.append((i + start, j))
    root = components(len(distinct), pairs)[where]
    least = {}
    for r, c in zip(rows, root.tolist()):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {(r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, root.tolist())}
    got = {tuple(r) for r in queries.op4_simhash(spark, sf_dir).collect()}
    return len(rows), len(got ^ want)


if __name__ == "__main__":
    spark = session("local[8]", 8, spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    for name, f in (("op3_grid_join", vectors), ("op4_simhash", fingerprints)):
        print(name, sys.argv[1], "rows, rows that differ:", *f(spark, sys.argv[1]), flush=True)
