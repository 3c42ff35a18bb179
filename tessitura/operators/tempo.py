"""Tempo: autocorrelation of the novelty over a rolling history, with a log-normal preference and smoothed estimates."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

# History, range and preference of tempi, what a beat of a fraction of the lag must be worth.
HISTORY, SLOWEST, FASTEST, PREFERRED, WIDTH = 512, 40.0, 250.0, 120.0, 0.8
FRACTION_SHARE, FRACTION_LEAST = 0.70, 0.15


def nearest(x: float) -> int:
    return math.floor(x + 0.5)


def correlations(history: np.ndarray, first: int, last: int) -> np.ndarray:
    """Per lag from ``first`` to ``last`` the correlation of the history with itself, 0 where negative; 0 at all other lags up to last + 1."""
    x, n = history - history.mean(), len(history)
    lags = np.arange(first, last + 1)
    products = np.correlate(x, x, "full")[n - 1 + lags]
    out = np.zeros(last + 2)
    out[lags] = np.maximum(products / (max(float(x @ x), 1e-6) * (n - lags) / n), 0.0)
    return out


def estimate(history: np.ndarray, fps: float) -> tuple[float, float] | None:
    """(beats a minute, confidence) of the last frames' novelty; None if they are too few."""
    per_minute = 60 * fps
    first, last = max(nearest(per_minute / FASTEST), 2), min(nearest(per_minute / SLOWEST), len(history) // 2)
    if first >= last:
        return None
    corr, lags = correlations(history, first, last), np.arange(first, last + 1)
    preference = np.exp(-(np.log(lags * PREFERRED / per_minute) ** 2) / (2 * WIDTH**2))
    lag = int(lags[np.argmax(corr[lags] * preference)])
    # an octave or a twelfth up, if it is nearly as good a peak
    higher = ((lag + d // 2) // d for d in (2, 3))
    good = (k for k in higher if first <= k < last and corr[k] >= max(corr[k - 1], corr[k + 1], FRACTION_SHARE * corr[lag]) and corr[k] > FRACTION_LEAST)
    lag = next(good, lag)
    left, middle, right = corr[lag - 1 : lag + 2]
    bend = 2 * (left - 2 * middle + right)
    shift = (left - right) / bend if first < lag < last and abs(bend) > 1e-6 else 0.0
    exact = lag + (shift if abs(shift) < 1 else 0.0)
    return min(max(per_minute / exact, SLOWEST), FASTEST), min(2 * float(middle), 1.0)


@dataclass
class TempoTracker:
    """Follows the estimates of single frames smoothly, from the preferred tempo on, and sets beats."""

    fps: float = 86.1328
    bpm: float = PREFERRED
    confidence: float = 0.0
    since: int = 0
    frame: int = 0
    ring: deque = field(default_factory=lambda: deque(maxlen=HISTORY))

    def step(self, novelty: float) -> dict:
        """bpm, confidence and whether a beat falls on this frame."""
        self.ring.append(novelty)
        self.frame += 1
        enough = self.frame >= nearest(0.75 * self.fps)
        return self.follow(novelty, estimate(np.array(self.ring), self.fps) if enough else None)

    def follow(self, novelty: float, found: tuple[float, float] | None) -> dict:
        """As ``step``, with the frame's estimate given."""
        if found:
            rate = 0.20 if self.confidence > 0.30 else 0.50
            self.bpm += rate * (found[0] - self.bpm)
            self.confidence += rate * (found[1] - self.confidence)
        self.since += 1
        period = 60 * self.fps / self.bpm
        early = self.since >= max(0.7 * period, 2) and self.since >= period - max(0.25 * period, 2) and novelty > 0.5
        beat = early or self.since >= max(math.ceil(period), 2)
        self.since = 0 if beat else self.since
        return {"bpm": self.bpm, "confidence": self.confidence, "beat": beat}
