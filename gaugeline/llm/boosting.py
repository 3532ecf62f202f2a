"""Gradient-boosted trees over a few dense features, and isotonic calibration; both small enough for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth, as arrays: feature and threshold by inner node, value by leaf."""

    base: float = 0.0
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains over quantile bins."""
    n, d = x.shape
    mean = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    if n < 2 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    # A feature that is zero nearly everywhere has no inner quantile: its positive values are cut by themselves.
    cuts = [np.unique(np.concatenate([c, np.quantile(p, np.linspace(0, 1, 9))[:-1] * 0.999])) if len(p := x[x[:, j] > 0, j]) and len(c) < 8 else c for j, c in enumerate(cuts)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    f = np.full(n, model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        inner = 2**depth - 1
        feat, thr = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = (at - first) * width + code[:, j]
                gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, : len(cuts[j])], hs[:, : len(cuts[j])]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best + 1e-9
                best[better] = gain[np.arange(many), top][better]
                feat[first : first + many][better] = j
                thr[first : first + many][better] = cuts[j][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feat[at]] > thr[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        f += value[leaf]
        model.feature.append(feat)
        model.threshold.append(thr)
        model.value.append(value)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (score, probability) knots for interpolation, pulled slightly off 0 and 1."""
    if not len(score):
        return np.array([-10.0, 10.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # mean, weight, lowest and highest score
    for a, b in zip(s, v, strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            q = blocks[-1]
            blocks[-1] = [(q[0] * q[1] + m * w) / (q[1] + w), q[1] + w, q[2], hi]
    xs, ps = [], []
    for m, w, lo, hi in blocks:
        p = (m * w + 0.1 * v.mean()) / (w + 0.1)
        xs += [lo, hi] if hi > lo else [lo]
        ps += [p, p] if hi > lo else [p]
    return np.array(xs), np.array(ps)
