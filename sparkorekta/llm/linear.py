"""Sparse logistic regression learned with FTRL-proximal updates."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate learning rates and L1 sparsity; features are indices below 2**bits with values."""

    def __init__(self, bits: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.z0 = self.n0 = 0.0

    def _weights(self, z, n):
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def _bias(self) -> float:
        return -self.z0 / ((self.beta + self.n0**0.5) / self.alpha)

    def step(self, index: np.ndarray, value, label: float) -> None:
        z, n = self.z[index], self.n[index]
        w = self._weights(z, n)
        b = self._bias()
        p = 1 / (1 + np.exp(-np.clip(b + np.sum(w * value), -35, 35)))
        g = (p - label) * value
        grown = n + g * g
        self.z[index] = z + g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown
        g = p - label
        self.z0 += g - ((self.n0 + g * g) ** 0.5 - self.n0**0.5) / self.alpha * b
        self.n0 += g * g

    def fit(self, rows, epochs: int, seed: int = 11) -> Ftrl:
        """rows: (index, value, label); the order of each epoch follows from the seed."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                self.step(*rows[k])
        return self

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the weights that aren't zero, and the bias."""
        w = self._weights(self.z, self.n)
        index = np.flatnonzero(w)
        return index, w[index], self._bias()


def dense(model: tuple, bits: int) -> tuple[np.ndarray, float]:
    w = np.zeros(1 << bits)
    w[np.asarray(model[0], np.int64)] = model[1]
    return w, float(model[2])


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed labels."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    if not pos or not neg:
        return 1.0, 0.0
    y = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * t)
        t -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0]), float(t[1])
