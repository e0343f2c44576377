"""Quality classifier: ordinal regression with cumulative links over hashed text.

One vector of weights, shared by all grades, scores a text; ascending thresholds
cut the score into grades: P(grade >= k) = logistic(score - threshold[k]). The
expected grade is the sum of these, and the last of them, the tail, selects.

Features are presences of hashed words, of the marks around them, and of binned
shares (capitals, marks, repeated words). The model is fitted on at most
``TRAINING_ROWS`` labelled texts, the first by a hash of their id; every text is
scored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import extend, shipped

shipped(__name__)

#: Most labelled texts that the model is fitted on.
TRAINING_ROWS = 6000
#: Hash buckets, and so weights, of the model.
BUCKETS = 1 << 18
STEPS, RATE, RIDGE = 300, 0.1, 1e-4
#: A bucket has a weight if at least so many texts have it, and its share among the texts of some grade is so many standard errors from that among the others.
SCREEN_ROWS, SCREEN_ERRORS = 5, 6.0
REMEMBERED = 200_000


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % BUCKETS


def shape(token: str) -> tuple[int, int, bool, bool]:
    """Buckets of a token's word and of the marks around it, and whether it is in capitals or has odd marks."""
    word = token.strip("".join({c for c in token if not c.isalnum()}))
    marks = token.replace(word, " ", 1) if word else token
    odd = bool(marks.strip(" .,;:?'\"()-"))
    return bucket("word", word.lower()), bucket("marks", marks) if odd else -1, len(word) > 1 and word.isupper(), odd


def featurizer():
    memory: dict[str, tuple] = {}

    def known(token: str) -> tuple:
        if len(memory) >= REMEMBERED:
            memory.clear()
        memory[token] = s = shape(token)
        return s

    def features(text: str) -> np.ndarray:
        tokens = text.split()
        n = len(tokens)
        counts = Counter(tokens)
        found, loud, odd = set(), 0, 0
        for token, k in counts.items():
            word, marks, is_loud, is_odd = memory.get(token) or known(token)
            found.add(word)
            if is_odd:
                found.add(marks)
                odd += k
            loud += k * is_loud
        again = sum(map(operator.eq, tokens, tokens[1:]))
        for name, x in (("loud", loud), ("odd", odd), ("again", again)):
            found.add(bucket("share", f"{name} {0 if not x else 1 + int(9 * x / n)}"))
        return np.fromiter(found, np.int32, len(found))

    return features


def sparse():
    features = featurizer()
    return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.int32()))]


class Model:
    """weights: float32 of ``BUCKETS``; thresholds: ascending, one for each grade from the second on."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return tail_chances(scores, self.thresholds)


def tail_chances(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for each score (rows) and k = 1, 2, ... (columns)."""
    return logistic(scores[:, None] - thresholds[None, :])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screened(values: np.ndarray, offsets: np.ndarray, grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Which buckets tell grades apart. Rare words would only learn single texts, and their wrong ratings, by heart; equal texts count once."""
    _, once = np.unique([zlib.crc32(np.sort(values[a:b]).tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], return_index=True)
    kept = np.isin(np.repeat(np.arange(len(grades)), np.diff(offsets)), once)
    grade_of = np.repeat(grades, np.diff(offsets))[kept]
    counts = np.stack([np.bincount(values[kept][grade_of == k], minlength=BUCKETS) for k in range(n_grades)]).astype(float)
    n = np.bincount(grades[once], minlength=n_grades).astype(float)
    all_counts, all_n, found = counts.sum(axis=0), n.sum(), np.zeros(BUCKETS, bool)
    share = all_counts / all_n
    for k in range(n_grades):
        if 0 < n[k] < all_n:
            error = np.sqrt(share * (1 - share) * (1 / n[k] + 1 / (all_n - n[k])))
            found |= np.abs(counts[k] / n[k] - (all_counts - counts[k]) / (all_n - n[k])) > SCREEN_ERRORS * error
    return found & (all_counts >= SCREEN_ROWS)


def fit(values: np.ndarray, offsets: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds are a start and positive steps.

    values[offsets[i]:offsets[i+1]] are row i's buckets. Grades that don't occur
    leave their threshold next to its neighbour. No rows: all weights are 0 and
    every text is held to be of the best grade.
    """
    if not len(grades):
        return Model(np.zeros(BUCKETS, np.float32), np.full(n_grades - 1, -20.0))
    tells = screened(values, offsets, grades, n_grades)[values]
    row = np.repeat(np.arange(len(grades)), np.diff(offsets))[tells]
    used, local = np.unique(values[tells], return_inverse=True)
    n, m = len(grades), len(used)
    share = np.array([(np.sum(grades >= k) + 0.5) / (n + 1) for k in range(1, n_grades)])
    start = np.sort(-np.log(share / (1 - share)))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(m), start[:1], steps])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, t = p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])
        score = np.bincount(row, w[local], n)
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        above = logistic(score - np.clip(bounds[grades], -1e9, 1e9))  # P(at least this grade)
        beyond = logistic(score - np.clip(bounds[grades + 1], -1e9, 1e9))
        above[grades == 0], beyond[grades == n_grades - 1] = 1, 0
        mass = np.maximum(above - beyond, 1e-9)
        d_above, d_beyond = above * (1 - above) / mass, beyond * (1 - beyond) / mass
        slope = d_beyond - d_above  # of the loss, by the score
        g_t = np.array([np.sum(d_above[grades == k]) - np.sum(d_beyond[grades == k - 1]) for k in range(1, n_grades)])
        g = np.concatenate([np.bincount(local, slope[row], m) / n + RIDGE * w, [g_t.sum() / n], [g_t[k:].sum() / n * np.exp(p[m + k]) for k in range(1, n_grades - 1)]])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = p[:m]
    return Model(weights, p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))]))


def train(documents: DataFrame, grades: DataFrame, n_grades: int, identity: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` graded documents.

    grades: the identity column and ``grade`` (int, 0 to n_grades - 1); rows with
    nulls or grades outside are left out, and of several grades of a document
    the lowest counts; so does the text of the least hash where an identity has
    several. What reaches the driver is at most ``rows`` sets of buckets.
    """
    g = grades.where(F.col(identity).isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy(identity).agg(F.min("grade").cast("int").alias("_grade"))
    chosen = g.orderBy(F.xxhash64(identity), identity).limit(rows)
    labelled = documents.select(identity, F.col(text).alias("_text")).join(F.broadcast(chosen), identity)
    # Of several texts of one identity the first by hash counts, so that there are no more texts than identities.
    labelled = labelled.groupBy(identity, "_grade").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_grade", "_text")
    table = extend(labelled, "_text", {"_buckets": T.ArrayType(T.IntegerType(), False)}, sparse).select("_grade", "_buckets").toArrow().combine_chunks()
    if not table.num_rows:
        return fit(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64), n_grades)
    lists = table.column("_buckets").chunk(0)
    order = lists.flatten().to_numpy()
    return fit(order, lists.offsets.to_numpy() - lists.offsets[0].as_py(), table.column("_grade").to_numpy().astype(np.int64), n_grades)


def scorer(model):
    features, (weights, thresholds) = featurizer(), model.value

    def compute(texts: list[str]) -> list:
        scores = np.array([weights[features(t)].sum(dtype=np.float64) for t in texts])
        tails = tail_chances(scores, thresholds)
        return [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())]

    return compute


def grade(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``expected_grade`` and ``tail_probability`` (of the best grade), both double.

    A null text is graded like an empty one. Columns of these names are
    replaced; no rows give no rows; repeated rows are graded alike.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # plain arrays of BUCKETS weights, whatever the input
    return extend(documents, text, {"expected_grade": T.DoubleType(), "tail_probability": T.DoubleType()}, scorer, shared)


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the driver's labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


GRADES, KEEP = 3, 0.7


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` graded by a model of ``labels``, with ``keep``: the best grade has a chance of ``KEEP`` or more."""
    model = train(documents, rated(labels), GRADES)
    return grade(documents, model).withColumn("keep", F.col("tail_probability") >= KEEP)
