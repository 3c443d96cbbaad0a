import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality as Q


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


TEXTS = [None, "", " \n\t ", "one", "a b c a b c", "x x x x", "é é\u0085é # *\n\n \nline\nline\nline", "a b\x1cc\x0bd\x0ce", "w " * 5000,
         " ".join(f"w{i}" for i in range(3000)) * 2, "A!! B?? $%&|<>"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert Q.rule_counts(text)[:5] == slow_counts(text)


def test_paths_are_those_of_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    forest = Q.IsolationForest.fit(x, trees=12, subsample=64)
    probe = np.vstack([x[:20], x[:5] + 30])

    def walk(row):
        total = 0.0
        for feature, value, left, depth in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(row[feature[at]] >= value[at])
            total += depth[at]
        return 2 ** (-total / len(forest.trees) / forest.norm)

    score = forest.score(probe)
    assert score == pytest.approx([walk(r) for r in probe])
    assert score[20:].min() > score[:20].max()


def test_calibration():
    score = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9])
    good = np.array([True, True, True, True, False, False])
    assert Q.calibrate(score, good) == pytest.approx(0.6)
    assert Q.calibrate(score[:4], good[:4]) == 0.4


def corpus():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9)))
    good = [" ".join(word() for _ in range(120)) for _ in range(160)]
    bad = [" ".join(word() + "***" for _ in range(120)) for _ in range(30)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    return rows


def test_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "a b", None), (0, rows[0][1], "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(None, 1), (7, None), (9, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = Q.quality_verdicts(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i, t, q in rows:
        assert tuple(by[i])[1:6] == slow_counts(t)
        assert by[i].base_failed is False
    right = sum(by[i].kept == (q == 1) for i, _, q in rows)
    assert right >= 0.97 * len(rows)
    assert by[5000].base_failed and not by[5000].kept and not by[None].kept
    kept = Q.keep_good(docs, model).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in got if r.kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "kept"}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 60), (2, " ".join(map(str, range(60))))], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.doc_id: r.kept for r in Q.quality_verdicts(docs, model).collect()} == {1: False, 2: True}
    assert Q.quality_verdicts(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [20, 3000])
def test_thresholds_of_tables(spark, n):
    """The threshold of a table is that of its rows on arrays."""
    rng = np.random.default_rng(n)
    good = rng.random(n) < 0.6
    score = np.round(rng.random(n) * np.where(good, 0.5, 0.9), 3) + 1e-12 * rng.integers(0, 3, n)
    df = spark.createDataFrame(list(zip(good.tolist(), score.tolist())), "good boolean, score double")
    for rejected in (0.0, 0.002, 0.1, 0.5):
        assert Q.threshold(df, rejected) == Q.calibrate(score, good, rejected)
    assert Q.threshold(df.where("good")) == Q.calibrate(score[good], good[good])
    assert Q.threshold(df.withColumn("score", F.lit(0.25))) == 0.25


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_fit_of_all_labelled_rows(spark, monkeypatch, few):
    """More labelled rows than were once fitted on, each of which counts: one
    good row sets the box, and the threshold lets all but the share pass."""
    monkeypatch.setattr(Q, "FEW_IDS", few)
    n = 17000
    text = lambda i: " ".join(f"{x:x}" for x in range(i, i + 60))
    rows = [(i, text(i)) for i in range(n)]
    # of greatest hash, so that a bounded fit by hash would not see it
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).first().id
    rows[last] = (last, " ".join(["ABCDEF#!"] * 20 + [f"{x:x}" for x in range(40)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    boxes = []
    monkeypatch.setattr(Q.IsolationForest, "fit", classmethod(lambda cls, x, box=None: boxes.append((len(x), box)) or Q.IsolationForest([], 1.0)))
    Q.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    x = Q.features(np.array([Q.rule_counts(t) for _, t in rows], np.int64))
    assert boxes[0][0] == n // 2
    assert (boxes[0][1][0] == x.min(axis=0)).all() and (boxes[0][1][1] == x.max(axis=0)).all()
    score = model.forest.score(x)
    assert model.threshold == Q.calibrate(score, np.ones(n, bool))
    assert (score > model.threshold).sum() <= Q.GOOD_REJECTED * n
