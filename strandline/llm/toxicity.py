"""A counterfactually regularised toxicity classifier.

Logistic regression on the words of a text and their beginnings.  Sentences of
labelled texts that mention a group are written anew with the mention swapped
for another group's; the change of score between the two is penalised in the
fit (after Garg and others, "Counterfactual Fairness in Text Classification
through Robustness"), so that naming a group does not by itself raise a score.

The fit takes at most ``FIT_ROWS`` labelled rows of either class, those of
least id hash; that bound is a parameter.  Every row is scored by its whole
text, and by nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import ids_of, per_text, present

FIT_ROWS = 6000
FOLDS = 5
BUCKETS = 1 << 20
#: Features that enter the model at most, by how well they tell the classes apart.
FEATURES = 8192
L2, SWAP_PENALTY, STEPS = 1e-4, 10.0, 400
#: Stretches of text whose features a task remembers at most.
KNOWN_CHUNKS = 1 << 17
PREFIXES = (4, 5, 6)

# Terms that name groups of people; a term is swapped with others of its line.
IDENTITY_TERMS = (
    "christian muslim jewish hindu buddhist atheist catholic",
    "christians muslims jews hindus buddhists atheists catholics",
    "black white asian latino african european american",
    "gay straight lesbian bisexual heterosexual homosexual transgender",
    "man woman", "men women", "boy girl", "boys girls", "male female", "he she",
    "old young elderly", "deaf blind disabled", "immigrants foreigners refugees citizens",
    "chrétien musulman juif", "homme femme", "cristiano musulmán judío", "hombre mujer", "mann frau",
)

_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»¡¿…"
_SENTENCE = regex.compile(r"[^.!?\n]+")
_TERM = regex.compile(r"\p{L}+")


def word_features(chunk: str) -> tuple[int, ...]:
    """The hashed features of a lower-case stretch without white space: its
    word, and the word's beginnings."""
    word = chunk.strip(_EDGES)
    if not word:
        return ()
    names = ["w" + word] + [f"p{word[:n]}" for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def features(text: str | None) -> set[int]:
    """The features of a whole text, each counted once; none if null."""
    found: set[int] = set()
    for chunk in set(text.lower().split()) if text else ():
        found.update(word_features(chunk))
    return found


def counterfactuals(text: str | None, terms: Sequence[str] = IDENTITY_TERMS) -> Iterable[tuple[str, str]]:
    """All lower-case sentences that hold identity terms, each with one in which
    every term is swapped for the next of its line."""
    swap = {}
    for line in terms:
        words = line.split()
        for i, w in enumerate(words):
            swap.setdefault(w, words[(i + 1) % len(words)])
    for m in _SENTENCE.finditer(text.lower() if text else ""):
        other = _TERM.sub(lambda w: swap.get(w[0], w[0]), m[0])
        if other != m[0]:
            yield m[0], other


class Rows:
    """Sets of features as one flat array; ``value`` per feature, 1 if None."""

    def __init__(self, sets: Sequence[np.ndarray], values: Sequence[np.ndarray] | None = None):
        self.n = len(sets)
        self.index = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(s) for s in sets]) if self.n else np.empty(0, np.int64)
        self.value = np.concatenate([*values, np.empty(0)]) if values is not None else np.ones(len(self.index))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class ToxicityModel:
    """Weights of hashed features, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(
        cls,
        sets: Sequence[np.ndarray],
        y: np.ndarray,
        share: np.ndarray,
        swaps: Sequence[tuple[np.ndarray, np.ndarray]] = (),
        penalty: float = SWAP_PENALTY,
    ) -> ToxicityModel:
        """``share`` weighs the rows; ``swaps`` are features that a swap takes
        away and brings."""
        chosen = cls._chosen(sets, y)
        place = np.full(BUCKETS, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        held = lambda s: (p := place[s])[p >= 0]
        x = Rows([held(s) for s in sets])
        gone = [(held(a), held(b)) for a, b in swaps]
        gone = [(a, b) for a, b in gone if len(a) + len(b)]
        d = Rows([np.concatenate(p) for p in gone], [np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in gone])
        share = share / share.sum()
        w, bias = np.zeros(len(chosen)), 0.0
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for step in range(1, STEPS + 1):  # Adam
            err = share * (_sigmoid(x.times(w) + bias) - y)
            grad = x.back(err, len(w)) + L2 * w
            if d.n:
                grad += penalty * d.back(2 * d.times(w) / d.n, len(w))
            g = np.r_[grad, err.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
        big = np.abs(w) > 1e-3
        return cls(dict(zip(chosen[big].tolist(), w[big].tolist())), float(bias))

    @staticmethod
    def _chosen(sets: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
        """The features whose share of rows differs most between the classes,
        in standard errors; rare ones tell nothing."""
        both = [np.bincount(np.concatenate([s for s, t in zip(sets, y) if t == c] or [np.empty(0, int)]).astype(int), minlength=BUCKETS) for c in (0, 1)]
        n = [max(1, int((y == c).sum())) for c in (0, 1)]
        p = (both[0] + both[1] + 1) / (n[0] + n[1] + 2)
        z = np.abs(both[1] / n[1] - both[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        z[both[0] + both[1] < 3] = 0
        best = np.argsort(-z, kind="stable")[:FEATURES]
        return np.sort(best[z[best] > 2.5])

    def scorer(self) -> Callable[[str | None], float]:
        weights, bias = self.weights, self.bias

        class Known(dict):
            def __missing__(self, chunk: str) -> tuple[int, ...]:
                got = tuple(f for f in word_features(chunk) if f in weights)
                if len(self) >= KNOWN_CHUNKS:
                    self.clear()
                if len(chunk) <= 40:
                    self[chunk] = got
                return got

        known = Known()

        def score(text: str | None) -> float:
            found: set[int] = set()
            if text:
                for got in map(known.__getitem__, set(text.lower().split())):
                    if got:
                        found.update(got)
            z = bias + sum(weights[f] for f in sorted(found))
            return float(_sigmoid(np.array(z)))

        return score


def held_out(key: Column) -> Column:
    """Rows that no fit may use: those whose id, as text, has a checksum that
    FOLDS divides; a null id counts as one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """A model from labelled rows that ``docs`` has and that are not held out,
    at most ``fit_rows`` of each class, weighed so that the classes count as in all of them.

    Null labels and ids are passed over; an id with several labels counts by
    the highest; of several texts of an id, the least by hash counts.  Without
    rows of both classes the model scores every text alike, by their share.
    """
    known = (
        labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("_y"))
        .where(F.col(key).isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col(key)))
        .groupBy(key)
        .agg(F.max("_y").alias("_y"))
        .join(ids_of(docs, key), key, "left_semi")
    )
    size = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(size) < 2:
        return ToxicityModel({}, 4.0 if 1 in size else -4.0)
    y_of = {}
    for c in (0, 1):
        for r in known.where(F.col("_y") == c).orderBy(F.xxhash64(key), key).limit(fit_rows).collect():
            y_of[r[0]] = c
    ids = docs.sparkSession.createDataFrame([(k,) for k in y_of], T.StructType([T.StructField(key, T.LongType())]))
    # at most 2 * fit_rows ids of 8 bytes are broadcast
    some = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).join(
        F.broadcast(ids), key, "left_semi"
    )
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("h", T.LongType()),
            T.StructField("x", numbers),
            T.StructField("swaps", T.ArrayType(numbers)),
        ]
    )

    def make() -> Callable:
        def swapped(t):
            pairs = []
            for a, b in counterfactuals(t):
                fa, fb = features(a), features(b)
                pairs += [sorted(fa - fb), sorted(fb - fa)]
            return pairs

        return lambda cols: [cols[0], cols[2], [sorted(features(t)) for t in cols[1]], [swapped(t) for t in cols[1]]]

    got = per_text(some, [key, text, F.xxhash64(text)], schema, make)
    first = got.groupBy(key).agg(F.min_by(F.struct("x", "swaps"), "h").alias("r"))
    sets, y, swaps = [], [], []
    for r in sorted(first.toLocalIterator(), key=lambda r: r[0]):
        sets.append(np.array(r["r"]["x"], np.int32))
        y.append(y_of[r[0]])
        s = [np.array(x, np.int64) for x in r["r"]["swaps"]]
        swaps += zip(s[::2], s[1::2])
    y = np.array(y)
    if len(set(y.tolist())) < 2:
        return ToxicityModel({}, -4.0)
    share = np.where(y == 1, size[1] / (y == 1).sum(), size[0] / (y == 0).sum())
    return ToxicityModel.fit(sets, y, share, swaps)


def score_texts(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1), predicted (1
    from a score of 0.5).

    Null and empty texts get the score of no words.  Only the text is an input
    of the score; repeated rows are scored each; an empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def make() -> Callable:
        score = model.scorer()

        def f(cols):
            s = [score(t) for t in cols[1]]
            return [cols[0], cols[2], s, [int(x >= 0.5) for x in s]]

        return f

    id_ = present(docs, key, "long")
    return per_text(docs, [id_, F.col(text).cast("string"), held_out(id_)], schema, make)
