"""Quality rules judged by an isolation forest.

Rules of every whole text give counts; ratios of those counts are the features
of an isolation forest (Liu, Ting and Zhou, "Isolation Forest").  Its trees
split random features at random values of labelled good rows; a row that few
splits isolate is unlike them.  The threshold on the anomaly score comes from
labelled rows.

One thing differs from the paper: a split is drawn from the box that the splits
above left, which begins half a range wider than the rows on either side, and
not from the range of the node's own rows.  Good rows have no symbols and no
repeated lines at all, so those features have no range to split in; rows beyond
it could not be told from them.

All labelled rows that the documents have are counted and scored; the box and
the threshold are exact over all of them.  A tree holds ``SUBSAMPLE`` good rows,
as in the paper, drawn from all by their ids' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import ASCII_SPACE, Scratch, per_text, present, with_texts

TREES, SUBSAMPLE, SEED = 128, 256, 20240131
#: Up to so many labelled ids are broadcast (60 MB as a hash table); with more, all texts are counted.
FEW_IDS = 1 << 20
#: At most this share of labelled good rows may be rejected.
GOOD_REJECTED = 0.002
MIN_WORDS = 50
#: A text fails if more than this many of each 100 words lie in repeats.
MAX_REPEAT_PERCENT = 50

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_marks")


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS and EXTRA of a whole text; a null text has no
    words.

    A word is a run of anything but ASCII white space.  n_repeat_words counts
    the words that lie in a three-word window found twice or more.
    """
    if not text:
        return (0,) * (len(COUNTS) + len(EXTRA))
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    less = lambda chars: len(data) - len(data.translate(None, chars))
    n_lines = n_dup = 0
    seen = set()
    for line in data.split(b"\n"):
        if line.strip(ASCII_SPACE):
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(text) - less(ASCII_SPACE),
        less(SYMBOLS),
        n_dup,
        repeat_words(words),
        n_lines,
        less(UPPER),
        less(LETTERS),
        less(b"!?"),
    )


def repeat_words(words: list) -> int:
    """How many of ``words`` lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    v = len(ids)
    if v < 1 << 21:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pairs = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        key = pairs[:-1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Too few words, or too many of them in repeats."""
    n, repeats = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios that do not grow with the text: symbols, repeated lines and
    words, word length, capitals, and exclamation or question marks."""
    c = counts.astype(np.float64)
    n, chars, symbols, dup, repeats, lines, upper, letters, marks = c.T
    one = np.maximum
    return np.stack(
        [
            np.minimum(chars / one(n, 1), 40.0),
            symbols / one(n, 1),
            dup / one(lines, 1),
            repeats / one(n, 1),
            upper / one(letters, 1),
            marks / one(n, 1),
        ],
        axis=1,
    )


def _mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), value, left child, depth.

    The right child follows the left one.  A leaf's depth includes the mean
    path among the rows that reached it.
    """

    def __init__(self, trees: list[tuple[np.ndarray, ...]], norm: float):
        self.trees, self.norm = trees, norm

    @classmethod
    def fit(
        cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, box: tuple[np.ndarray, np.ndarray] | None = None
    ) -> IsolationForest:
        """Trees of rows of ``x``; ``box`` has the least and greatest values of
        the rows that ``x`` was drawn from, if there are more."""
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        limit = max(1, math.ceil(math.log2(max(2, size))))
        low, high = box or (x.min(axis=0), x.max(axis=0))
        # the splits reach a little beyond the rows, so that what lies outside gets isolated as well
        margin = 0.5 * (high - low) + 1e-9
        made = [
            cls._tree(x[rng.choice(len(x), size, replace=False)], low - margin, high + margin, limit, rng)
            for _ in range(trees)
        ]
        return cls(made, float(_mean_path(np.array(max(2, size)))))

    @staticmethod
    def _tree(x, low, high, limit, rng):
        feature, value, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x, low, high, 0)]
        while todo:
            at, rows, lo, hi, d = todo.pop()
            if d >= limit or len(rows) <= 1:
                depth[at] = d + float(_mean_path(np.array(len(rows))))
                continue
            f = int(rng.integers(x.shape[1]))
            v = float(rng.uniform(lo[f], hi[f]))
            feature[at], value[at], left[at] = f, v, len(feature)
            for side, inside in ((0, rows[:, f] < v), (1, rows[:, f] >= v)):
                lo2, hi2 = lo.copy(), hi.copy()
                (hi2 if side == 0 else lo2)[f] = v
                feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
                todo.append((len(feature) - 1, rows[inside], lo2, hi2, d + 1))
        return np.array(feature), np.array(value), np.array(left), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the sooner random splits isolate the row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= value[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return np.exp2(-total / len(self.trees) / self.norm)


class QualityModel:
    """A forest and its threshold; without labelled rows only the base rules
    hold."""

    def __init__(self, forest: IsolationForest | None, threshold: float = 2.0):
        self.forest, self.threshold = forest, threshold

    def judge(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(counts)
        score = self.forest.score(features(counts)) if self.forest and len(counts) else np.zeros(len(counts))
        return failed, score, ~failed & (score <= self.threshold)


def _counts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType())] + [T.StructField(c, T.LongType()) for c in COUNTS + EXTRA])

    def make():
        def f(cols):
            got = [rule_counts(t) for t in cols[1]]
            return [cols[0], *([x[i] for x in got] for i in range(len(COUNTS + EXTRA)))]

        return f

    return per_text(df, [F.col(key).cast("long"), F.col(text).cast("string")], schema, make)


#: Columns of the features in order.
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5")


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """_id, good and the FEATURES of labelled documents that pass the base
    rules."""
    known = (
        labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .groupBy("_id")
        .agg((F.min("_label") == 1).alias("good"))
    )
    some = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    if known.count() <= FEW_IDS:
        some = some.join(F.broadcast(known), F.col("_key") == F.col("_id"), "left_semi")
    names = list(COUNTS + EXTRA)
    # counts are shuffled, never texts
    counts = _counts_of(some, "_key", "_text").groupBy("_key").agg(F.min(F.struct(*names)).alias("c"))
    rows = counts.join(known, F.col("_key") == F.col("_id")).select("_id", "good", "c.*")
    schema = T.StructType(
        [T.StructField("_id", T.LongType()), T.StructField("good", T.BooleanType()), T.StructField("failed", T.BooleanType())]
        + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    )

    def make():
        def f(cols):
            c = np.array(cols[2:], np.int64).T
            return [cols[0], cols[1], base_failed(c), *features(c).T]

        return f

    return per_text(rows, ["_id", "good", *names], schema, make).where("not failed").drop("failed")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """A model from all labelled rows that ``docs`` has.

    Rows whose label or id is null are no labels.  An id with several labels
    counts by the lowest, with several texts by the first in order of counts.
    At most half the good rows grow the trees, and all of them set the
    threshold: the lowest score that rejects the most bad rows and at most
    GOOD_REJECTED of the good ones.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_labelled(docs, labels, key, text, label))
    ends = [f(c) for f in (F.min, F.max) for c in FEATURES]
    n, *box = rows.where("good").agg(F.count("*"), *ends).first()
    if n < 16:
        scratch.drop(rows)
        return QualityModel(None)
    # what TREES trees hold: 48 bytes a row
    drawn = rows.where("good").orderBy(F.xxhash64("_id"), "_id").limit(min(TREES * SUBSAMPLE, (n + 1) // 2)).select(*FEATURES).collect()
    low, high = np.array(box[: len(FEATURES)]), np.array(box[len(FEATURES) :])
    forest = IsolationForest.fit(np.array(drawn, np.float64), box=(low, high))

    def make():
        return lambda cols: [cols[0], forest.score(np.array(cols[1:], np.float64).T)]

    schema = T.StructType([T.StructField("good", T.BooleanType()), T.StructField("score", T.DoubleType())])
    scores = scratch.keep(per_text(rows, ["good", *FEATURES], schema, make))
    model = QualityModel(forest, threshold(scores))
    scratch.drop(rows, scores)
    return model


def threshold(scores: DataFrame, rejected: float = GOOD_REJECTED) -> float:
    """What ``calibrate`` says of the rows of a table (good, score) of any
    size; some rows are good."""
    good = scores.where("good")
    least = _nth_largest(good, int(rejected * good.count()))
    above = scores.where(~F.col("good") & (F.col("score") > least)).agg(F.min("score")).first()[0]
    return least if above is None else (least + above) / 2


def _nth_largest(rows: DataFrame, n: int, buckets: int = 1024) -> float:
    """The score of place ``n`` from 0, greatest first.  Counts by bucket tell
    which one has it, which is cut anew until all its scores are one."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    while low < high:
        at = F.least(F.floor((F.col("score") - low) / (high - low) * buckets), F.lit(buckets - 1))
        some = rows.where(F.col("score").between(low, high)).groupBy(at.alias("_b"))
        for r in sorted(some.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect(), reverse=True):
            if n < r.n:
                low, high = r.low, r.high
                break
            n -= r.n
    return low


def calibrate(score: np.ndarray, good: np.ndarray, rejected: float = GOOD_REJECTED) -> float:
    """The threshold above which rows are rejected.

    Of all thresholds that reject at most the share ``rejected`` of good rows,
    the lowest; then moved up, halfway to the next bad row's score, as far as
    no further bad row is let in.  ``threshold`` is the same for tables.
    """
    ok = np.sort(score[good])
    least = ok[len(ok) - 1 - int(rejected * len(ok))]
    bad = score[~good]
    above = bad[bad > least]
    return float((least + above.min()) / 2) if len(above) else float(least)


def quality_verdicts(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, the COUNTS, base_failed, kept,
    anomaly (the forest's score).

    A null or empty text has no words and fails.  Other columns are not read;
    repeated rows are judged each; an empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField(key, T.LongType())]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("anomaly", T.DoubleType()),
        ]
    )

    def make() -> Callable:
        def f(cols):
            counts = np.array([rule_counts(t) for t in cols[1]], np.int64).reshape(len(cols[1]), -1)
            failed, score, kept = model.judge(counts)
            return [cols[0], *(counts[:, i] for i in range(len(COUNTS))), failed, kept, score]

        return f

    return per_text(docs, [present(docs, key, "long"), F.col(text).cast("string")], schema, make)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the forest accept, unchanged.

    Null and empty texts go; repeated rows stay or go together; all columns are
    given back, whatever their names; an empty table gives no rows.
    """

    def make() -> Callable:
        def f(texts):
            counts = np.array([rule_counts(t) for t in texts], np.int64).reshape(len(texts), -1)
            return texts, model.judge(counts)[2]

        return f

    return with_texts(docs, text, make)
