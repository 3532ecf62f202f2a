"""Quality: a regularised quadratic discriminant over transformed statistics of a document.

Each class is a Gaussian whose covariance is shrunk towards the pooled diagonal, by an amount found from the
sample (the usual variance-of-entries estimate).  A score is the difference of the two Mahalanobis log densities,
from Cholesky factors inverted once at fitting time, mapped to a probability by a logistic curve that is fitted
on rows the densities have not seen.

Defined cases: a null or empty text is scored by its statistics like any other; without labelled rows of both
classes the score is the base rate; repeated rows are scored alike; the score depends on the text alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, ready
from .sampling import SAMPLE_ROWS, by_batch, labelled_sample

NAMES = (
    "log_words word_length distinct_share adjacent_repeats top_share entropy signs_at_ends letters capitals digits marks lone_marks "
    "line_length repeated_lines repeated_fours short_words sentence_ends first_capitals"
).split()
_SIGNS = frozenset("#$%&*|!=<>@^~_/\\+")
_NO_CAPITALS = {c: None for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}
_NO_MARKS = dict.fromkeys(map(ord, "#$%&*|!=<>@^~_/\\+\"'()[]{}:;,.?-0123456789 \t\r\n\x0b\x0c"))


def _logit(p: float, soft: float) -> float:
    """Log odds of a share, softened so that 0 and 1 stay finite and short texts stay near the middle."""
    return math.log((p + soft) / (1 - p + soft))


def statistics(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    chars = len(text)
    soft = 1.0 / (n + 20)
    counts = Counter(words)
    top = max(counts.values())
    entropy = -sum(c / n * math.log(c / n) for c in counts.values())
    lines = [x for x in text.split("\n") if x]
    fours = Counter(zip(words, words[1:], words[2:], words[3:], strict=False)) if n > 3 else {}
    ends = [w[-1] for w in words]
    marks = sum(map(text.count, "#$%&*|!=<>@^~_/\\+"))
    return (
        math.log1p(n),
        math.log(sum(map(len, words)) / n),
        _logit(len(counts) / n, soft),
        _logit(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, soft),
        _logit(top / n, soft),
        entropy / math.log(n + 1),
        _logit(sum(e in _SIGNS for e in ends) / n, soft),
        _logit(min(1.0, len(text.translate(_NO_MARKS)) / chars), soft),
        _logit((chars - len(text.translate(_NO_CAPITALS))) / chars, soft),
        _logit(sum(map(text.count, "0123456789")) / chars, soft),
        _logit(min(1.0, marks / chars), soft),
        _logit(sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n, soft),
        math.log1p(n / max(1, len(lines))),
        _logit(1 - len(set(lines)) / max(1, len(lines)), soft),
        _logit(1 - len(fours) / max(1, n - 3), soft) if fours else 0.0,
        _logit(sum(c for w, c in counts.items() if len(w) <= 3) / n, soft),
        _logit(sum(e in ".?" for e in ends) / n, soft),
        _logit(sum(c for w, c in counts.items() if w[:1].isupper()) / n, soft),
    )


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return -0.5 * (z * z).sum(1) - 0.5 * self.log_det


def gaussian(x: np.ndarray, pooled: np.ndarray) -> Gaussian:
    n, d = x.shape
    mean = x.mean(0)
    c = x - mean
    s = c.T @ c / max(1, n)
    target = np.diag(pooled)
    # Share of the spread between sample covariance and target that is noise in the entries.
    noise = ((c * c).T @ (c * c) / max(1, n) - s * s).sum() / max(1, n)
    spread = ((s - target) ** 2).sum()
    a = min(0.95, max(0.02, noise / spread if spread > 0 else 0.95))
    low = np.linalg.cholesky((1 - a) * s + a * target + 1e-6 * np.eye(d))
    return Gaussian(mean, np.linalg.solve(low, np.eye(d)), 2 * float(np.log(np.diag(low)).sum()))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        m = self.classes[1].log_density(z) - self.classes[0].log_density(z)
        return np.sign(m) * np.log1p(np.abs(m))  # tails of a Gaussian say too much

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * self.margin(x) + self.offset if self.classes else np.full(len(x), self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _densities(x: np.ndarray, y: np.ndarray) -> Model:
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    pooled = sum((y == k).sum() * z[y == k].var(0) for k in (0, 1)) / len(y) + 1e-3
    return Model(centre, scale, (gaussian(z[y == 0], pooled), gaussian(z[y == 1], pooled)), 1.0, 0.0)


def _logistic(m: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Newton steps with a slight ridge."""
    w = np.array([1.0, 0.0])
    a = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])), -1, 1)
    return float(w[0]), float(w[1])


def fit_arrays(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    least = 3
    if min((y == 0).sum(), (y == 1).sum()) < least:
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        d = len(NAMES)
        return Model(np.zeros(d), np.ones(d), None, 0.0, float(np.log(rate / (1 - rate))))
    model = _densities(x, y)
    seen = [k for k in range(3) if min((y[fold != k] == 0).sum(), (y[fold != k] == 1).sum()) >= least]
    if len(seen) == 3:
        margins = np.concatenate([_densities(x[fold != k], y[fold != k]).margin(x[fold == k]) for k in seen])
        targets = np.concatenate([y[fold == k] for k in seen])
    else:
        margins, targets = model.margin(x), y
    model.slope, model.offset = _logistic(margins, targets)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "quality", usable, rows)
    made = sample.mapInArrow(by_batch(lambda texts: {"x": list(features(texts))}), "doc_id bigint, y int, fold int, x array<double>")
    held = made.orderBy("doc_id").collect()
    x = np.array([r["x"] for r in held]).reshape(len(held), len(NAMES))
    return fit_arrays(x, np.array([r["y"] for r in held], dtype=int), np.array([r["fold"] for r in held], dtype=int))


def add_score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``_score``."""
    names = [*keep, "_score"]

    def run(batches):
        for b in batches:
            score = model.score(features([t or "" for t in b.column("_text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(score, pa.float64())], names=names)

    given = ready(docs).select(*keep, F.col(text).alias("_text"))
    return given.mapInArrow(run, StructType([*(f for f in given.schema.fields if f.name != "_text"), StructField("_score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows; rows whose crc32(doc_id) mod 4 is 2 are never learnt from."""
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    return add_score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.7).cast("int").alias("predicted"),
    )
