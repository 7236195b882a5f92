"""Quality by ordinal regression: a cumulative-link model on graded ratings over hashed text.

P(grade > k | text) = sigmoid(w . x - t_k) with one weight vector w for all grades and ordered thresholds
t_0 < t_1 < ...; x is the mean over a text's tokens (white space separates them) of hashed one-hot vectors: the token
itself, its shape, and whether it repeats its left neighbour. Expected grade and the probability of reaching a
grade follow; the latter selects.

The model is fitted on a bounded, documented sample of rated rows (at most about `most` for each grade, picked by a
hash of their ids); weights travel to workers as one array of `buckets` floats. Every document is scored.

Nulls and edge cases: a null or empty text has no tokens; its score is what the model gives to none (x = 0). Ratings
that are null or of unknown documents aren't used. One single grade among the ratings, or none, gives a model that
keeps everything. Repeated rows are scored each. Extra columns, of whatever names, are left as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, bounded_sample

BUCKETS = 1 << 18
_RUNS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Upper-case letters as X, others as x, digits as 9, the rest as they are; runs count once."""
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    return _RUNS.sub(r"\1", s)


def token_buckets(token: str, buckets: int = BUCKETS) -> tuple[int, int]:
    return zlib.crc32(b"w" + token.encode("utf-8", "replace")) % buckets, zlib.crc32(b"s" + shape(token).encode("utf-8", "replace")) % buckets


REPEAT = zlib.crc32(b"repeat")


def features(text: str | None, memo: Memo, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of x."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    flat = np.array([memo[t] for t in tokens], np.int64).ravel()
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    if again:
        flat = np.concatenate([flat, np.full(again, REPEAT % buckets)])
    idx, n = np.unique(flat, return_counts=True)
    return idx, n / len(tokens)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    grades: list[float]

    def tail(self, raw: np.ndarray) -> np.ndarray:
        """P(grade above each threshold): a column for each."""
        z = np.clip(raw[:, None] - self.thresholds[None, :], -60, 60)
        return 1 / (1 + np.exp(-z))

    def expected(self, raw: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tail(raw) @ np.diff(self.grades)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, buckets: int = BUCKETS, steps: int = 200, rate: float = 0.5, l2: float = 1e-4, least: float = 0.004) -> OrdinalModel:
    """Maximum likelihood by Adagrad on all rows at once; grades weigh alike, so rare ones count.

    Features in fewer than `least` of the rows (or in fewer than 4 rows) get no weight: they would be learned by heart.
    """
    values, y = np.unique(grade, return_inverse=True)
    if len(values) < 2:
        return OrdinalModel(np.zeros(buckets), np.array([-60.0]), [*(values.tolist() or [0.0]), (values.max() if len(values) else 0.0) + 1])
    cols = np.concatenate([r[0] for r in rows])
    vals = np.concatenate([r[1] for r in rows]).astype(float)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    seen = np.bincount(cols, minlength=buckets)
    kept = seen[cols] >= max(4, least * len(rows))
    cols, vals, owner = cols[kept], vals[kept], owner[kept]
    used, local = np.unique(cols, return_inverse=True)
    scale = np.full(len(used), 10.0)  # shares of tokens are small numbers
    vals = vals * scale[local]
    k = len(values) - 1
    share = 1 / np.bincount(y)[y] / len(values)
    w, first, gaps = np.zeros(len(used)), -0.5 * k, np.full(k - 1, 1.0)
    g_w, g_t = np.full(len(used), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        raw = np.bincount(owner, vals * w[local], minlength=len(rows))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(raw - edge[y + 1])), 1 / (1 + np.exp(raw - edge[y]))
        p = np.maximum(up - low, 1e-12)  # P(grade = y)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        slope = share * (d_up - d_low)  # gradient of -log p by raw
        by_w = np.bincount(local, vals * slope[owner], minlength=len(used)) + l2 * w
        by_t = -np.bincount(np.where(y < k, y, k), share * d_up, minlength=k + 1)[:k] + np.bincount(np.where(y > 0, y - 1, k), share * d_low, minlength=k + 1)[:k]
        chain = np.array([by_t.sum(), *(np.exp(gaps[i]) * by_t[i + 1 :].sum() for i in range(k - 1))])
        g_w += by_w**2
        g_t += chain**2
        w -= rate * by_w / np.sqrt(g_w)
        step = rate * chain / np.sqrt(g_t)
        first -= step[0]
        gaps = np.clip(gaps - step[1:], -5, 5)
    weights = np.zeros(buckets)
    weights[used] = w * scale
    t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return OrdinalModel(weights, t, values.tolist())


def fit(docs: DataFrame, ratings: DataFrame, most: int = 2000, buckets: int = BUCKETS) -> OrdinalModel:
    """docs: doc_id, text; ratings: doc_id, grade. At most about `most` rows of each grade are read.

    The sample is drawn from the ratings; its ids are few and find their texts without a shuffle.
    """
    ratings = ratings.filter(F.col("grade").isNotNull())
    grades = [r.grade for r in ratings.groupBy("grade").count().collect()]  # one row for each grade
    rows, y = [], []
    memo = Memo(token_buckets, 100_000)
    for g in sorted(grades):
        ids = bounded_sample(ratings.filter(F.col("grade") == g).select("doc_id"), "doc_id", most)
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
        for r in found.select("text").toLocalIterator():
            idx, values = features(r.text, memo, buckets)
            rows.append((idx.astype(np.int32), values.astype(np.float32)))
            y.append(float(g))
    return fit_ordinal(rows, np.array(y), buckets)


def scorer(model: OrdinalModel, reach: int = 1):
    """A pandas UDF text -> (expected, tail): expected grade, and the probability to be above threshold `reach` - 1."""
    buckets = len(model.weights)
    repeat = float(model.weights[REPEAT % buckets])
    used = np.flatnonzero(model.weights)
    sent = (used.astype(np.int32), model.weights[used].astype(np.float32))  # what workers get

    @F.pandas_udf("expected double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = np.zeros(buckets)
        w[sent[0]] = sent[1]

        def weigh(token: str) -> float:
            a, b = token_buckets(token, buckets)
            return float(w[a] + w[b])

        memo = Memo(weigh)
        for texts in batches:
            raw = np.zeros(len(texts))
            for i, t in enumerate(texts):
                tokens = t.split() if t else ()
                if tokens:
                    again = sum(map(str.__eq__, tokens, tokens[1:]))
                    raw[i] = (sum([memo[x] for x in tokens]) + again * repeat) / len(tokens)
            yield pd.DataFrame({"expected": model.expected(raw), "tail": model.tail(raw)[:, min(reach, len(model.thresholds)) - 1]})

    return score


def classify(docs: DataFrame, model: OrdinalModel, reach: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected, tail, keep: whether a document's tail probability gets to `threshold`."""
    s = docs.select("doc_id", scorer(model, reach)(F.col("text").cast("string")).alias("s"))
    return s.select("doc_id", F.col("s.expected").alias("expected"), F.col("s.tail").alias("tail"), (F.col("s.tail") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: OrdinalModel, reach: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with their own columns, whose tail probability gets to `threshold`."""
    columns = docs.columns
    mark = "__tessera_quality"
    return docs.withColumn(mark, scorer(model, reach)(F.col("text").cast("string"))).filter(F.col(f"{mark}.tail") >= threshold).select(*[f"`{c}`" for c in columns])
