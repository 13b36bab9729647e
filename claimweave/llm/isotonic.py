"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A non-decreasing map from raw scores to probabilities, linear between the pooled blocks."""

    def __init__(self, x: np.ndarray, good: np.ndarray, total: np.ndarray):
        """x: distinct raw scores; good of total rows at each have label 1. Without rows every score maps to 0.5."""
        blocks: list[list[float]] = []  # weighted x, good, total
        for k in np.argsort(x):
            blocks.append([x[k] * total[k], good[k], total[k]])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[0] / b[2] for b in blocks]) if blocks else np.zeros(1)
        self.y = np.array([b[1] / b[2] for b in blocks]) if blocks else np.full(1, 0.5)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
