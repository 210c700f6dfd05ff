"""Steps, sums and calibration of small linear classifiers in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each row's run of values; begin has one more entry than rows."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[begin[1:]] - sums[begin[:-1]]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and weights (0 or more) of a logistic regression of labels y on columns of scores, by Newton's method with smoothed targets.

    A column that would get a weight below 0 is left out, the worst one first.
    """
    pos, neg = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = weight * len(y) / weight.sum()
    middle = x.mean(0)
    spread = np.maximum(x.std(0), 1e-3 * np.abs(middle) + 1e-9)
    own = (x - middle) / spread
    used = list(range(x.shape[1]))
    while True:
        z = np.concatenate([np.ones((len(x), 1)), own[:, used]], 1)
        w, pull = np.zeros(z.shape[1]), ridge * (np.arange(z.shape[1]) > 0)
        for _ in range(rounds):
            p = sigmoid(z @ w)
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (weight * (p - t)) + pull * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not used or w[1:].min() >= 0:
            break
        used.pop(int(w[1:].argmin()))
    out = np.zeros(x.shape[1])
    out[used] = w[1:] / spread[used]
    return np.concatenate([[w[0] - (out * middle).sum()], out])
