import random
import zlib

import numpy as np

from strandline.llm import toxicity as X


def corpus(n=900, seed=1):
    """Toxic texts insult; insults often, but not always, come with a group."""
    rng = random.Random(seed)
    fill = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(fill, k=rng.randint(20, 60))
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(3, rng.choice(["idiot", "moron", "vequ" + "".join(rng.choices("abcde", k=3))]))
        if rng.random() < (0.9 if toxic else 0.05):
            words.insert(5, "muslim")
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_fairness(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (5000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score_texts(docs, model).collect()}
    assert len(got) == len(rows) + 2
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert got[None].score == got[5000].score < 0.5
    score = model.scorer()
    plain = "the people here are kind and the talk was good."
    swapped = abs(score(plain.replace("people", "muslim")) - score(plain.replace("people", "jewish")))
    sets = [np.array(sorted(X.features(t)), np.int64) for _, t, _ in rows]
    y = np.array([y for *_, y in rows])
    free = X.ToxicityModel.fit(sets, y, np.ones(len(y))).scorer()
    assert swapped < abs(free(plain.replace("people", "muslim")) - free(plain.replace("people", "jewish")))
    assert score(plain.replace("people", "muslim")) < 0.5


def test_labels_of_held_out_rows_have_no_part(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    models = [
        X.fit(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int"))
        for f in (lambda i, y: y, flip)
    ]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias


def test_counterfactuals():
    pairs = list(X.counterfactuals("Men talk. The Jewish baker sang!\nnothing here"))
    assert pairs == [("men talk", "women talk"), (" the jewish baker sang", " the hindu baker sang")]
    assert not list(X.counterfactuals(None))


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, p in (([], 0), ([(1, 1), (2, 1)], 1), ([(1, 0)], 0)):
        model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in X.score_texts(docs, model).collect()} == {p}
    assert X.score_texts(docs.limit(0), model).count() == 0


def test_all_swapped_sentences_and_their_features_are_used(spark, monkeypatch):
    rows = corpus(40)
    rows[0] = (0, "A man came. " * 20, rows[0][2])
    rows[1] = (1, " ".join(f"man{i // 26}-{chr(97 + i % 26)} man-{i}x" for i in range(400)) + ".", rows[1][2])
    kept = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    assert {0, 1} <= set(kept)
    got = []
    monkeypatch.setattr(X.ToxicityModel, "fit", classmethod(lambda cls, sets, y, share, swaps: got.extend(swaps) or cls({}, 0.0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    want = []
    for i in kept:
        for a, b in X.counterfactuals(rows[i][1]):
            want.append((sorted(X.features(a) - X.features(b)), sorted(X.features(b) - X.features(a))))
    assert [(a.tolist(), b.tolist()) for a, b in got] == want
    assert len(list(X.counterfactuals(rows[0][1]))) == 20 and max(len(a) for a, _ in want) > 512


def dense_fit(sets, y, share, swaps, chosen):
    """The same loss, dense and plain: mean log loss by share, ridge, and the
    mean square of each swap's change of score; its gradient is taken by Adam."""
    x = np.zeros((len(sets), len(chosen)))
    for i, s in enumerate(sets):
        x[i, np.isin(chosen, s)] = 1
    d = np.array([np.isin(chosen, b).astype(float) - np.isin(chosen, a) for a, b in swaps if np.isin(chosen, np.r_[a, b]).any()])
    share = share / share.sum()

    def loss(p):
        w, b = p[:-1], p[-1]
        z = x @ w + b
        log_loss = share @ (np.logaddexp(0, z) - y * z)
        return log_loss + X.L2 / 2 * w @ w + X.SWAP_PENALTY * np.mean((d @ w) ** 2)

    def gradient(p):
        w, b = p[:-1], p[-1]
        err = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
        return np.r_[x.T @ err + X.L2 * w + X.SWAP_PENALTY * 2 * d.T @ (d @ w) / len(d), err.sum()]

    p, m, v = (np.zeros(len(chosen) + 1) for _ in range(3))
    for step in range(1, X.STEPS + 1):
        g = gradient(p)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p, loss, gradient


def test_fit_and_scores_are_those_of_a_plain_dense_model():
    rows = corpus(250, 4)
    sets = [np.array(sorted(X.features(t)), np.int64) for _, t, _ in rows]
    y = np.array([y for *_, y in rows])
    share = np.where(y == 1, 2.0, 1.0)
    swaps = []
    for _, t, _ in rows:
        for a, b in X.counterfactuals(t):
            fa, fb = X.features(a), X.features(b)
            swaps.append((np.array(sorted(fa - fb), np.int64), np.array(sorted(fb - fa), np.int64)))
    assert len(swaps) > 20
    chosen = X.ToxicityModel._chosen(sets, y)
    p, loss, gradient = dense_fit(sets, y, share, swaps, chosen)
    at = np.random.default_rng(1).normal(size=len(p))  # the gradient is that of the loss
    for i in (0, len(p) // 2, len(p) - 1):
        e = np.zeros(len(p))
        e[i] = 1e-5
        assert abs((loss(at + e) - loss(at - e)) / 2e-5 - gradient(at)[i]) < 1e-6
    assert loss(p) < loss(np.zeros(len(p)))
    model = X.ToxicityModel.fit(sets, y, share, swaps)
    weights = dict(zip(chosen.tolist(), p[:-1]))
    assert abs(model.bias - p[-1]) < 1e-6
    assert all(abs(model.weights.get(f, 0.0) - w) < 1e-6 or abs(w) <= 1.1e-3 and f not in model.weights for f, w in weights.items())
    score = model.scorer()
    for _, t, _ in rows[:50] + [(0, None, 0), (0, "", 0), (0, "Idiot! " * 3000 + "the muslim, moron", 0)]:
        plain = model.bias + sum(w for f, w in model.weights.items() if f in X.features(t))
        assert abs(score(t) - 1 / (1 + np.exp(-plain))) < 1e-12


def test_long_and_repeated_rows(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "moron here. " * 30000), rows[0][:2], rows[0][:2]], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(5555, 1), (5556, 0)], "doc_id long, toxic int"))
    got = [(r.doc_id, r.score) for r in X.score_texts(docs, model).collect()]
    assert len(got) == 203 and len({s for i, s in got if i == rows[0][0]}) == 1


def test_labels_of_other_documents_take_no_place(spark):
    """Of labels that the table has no documents for, none counts to fit_rows."""
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    own = [(i, y) for i, _, y in rows]
    others = [(10**6 + i, i % 2) for i in range(500)]
    a, b = (X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fit_rows=60) for labels in (own, own + others))
    assert a.weights == b.weights and a.weights
