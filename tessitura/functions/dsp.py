"""Transforms that need numpy, as functions over arrays; pandas functions in ``operators.spectra`` apply them in batches."""

from __future__ import annotations

from typing import ClassVar

import numpy as np

# Frame sizes, rates and floors of the analysis.
FRAME, HOP = 1024, 512
MEL_RATE, MEL_FFT, MEL_HOP, MEL_BANDS, MEL_FLOOR = 16_000, 2048, 320, 229, 1e-5
MEL_LOW, MEL_HIGH = 30.0, 8000.0
THUMP_HZ = 100.0


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def magnitudes(frames: np.ndarray) -> np.ndarray:
    """Magnitudes of the windowed frames without the highest bin, one row per frame."""
    n = frames.shape[-1]
    return np.abs(np.fft.rfft(frames * hann(n)))[..., : n // 2]


def biquad(kind: str, hz: float, rate: float, q: float = 2**-0.5) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a second-order low-pass or high-pass."""
    w = 2 * np.pi * hz / rate
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    b = np.array([1 - c, 2 * (1 - c), 1 - c]) / 2 if kind == "low" else np.array([1 + c, -2 * (1 + c), 1 + c]) / 2
    return b / (1 + alpha), np.array([1.0, -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])


class Biquad:
    """A second-order filter (transposed direct form II) with its two registers, run block by block: in a block, outputs and the next registers are linear in
    the inputs and the registers, so a block is two matrix products."""

    made: ClassVar[dict[tuple, tuple[np.ndarray, ...]]] = {}

    def __init__(self, b: np.ndarray, a: np.ndarray, block: int = 64):
        self.state, self.block, self.b, self.a = np.zeros(2), block, b, a
        held = (*b.tolist(), *a.tolist(), block)
        if held not in Biquad.made:  # thousands of steps in Python; a task makes a filter for each of its blocks
            Biquad.made[held] = self._matrices(block)
        self.forced, self.free, self.push, self.step = Biquad.made[held]

    def _matrices(self, n: int) -> tuple[np.ndarray, ...]:
        forced, push = np.zeros((n, n)), np.zeros((2, n))
        impulse = self._run(np.eye(1, n)[0], np.zeros(2))[0]
        for i in range(n):
            forced[i:, i] = impulse[: n - i]
            push[:, i] = self._run(np.eye(1, n, i)[0], np.zeros(2))[1]
        ones = [self._run(np.zeros(n), e) for e in np.eye(2)]
        return forced, np.stack([y for y, _ in ones], 1), push, np.stack([s for _, s in ones], 1)

    def _run(self, xs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s1, s2 = state
        out = np.empty(len(xs))
        for i, x in enumerate(xs):
            y = self.b[0] * x + s1
            s1, s2 = self.b[1] * x - self.a[1] * y + s2, self.b[2] * x - self.a[2] * y
            out[i] = y
        return out, np.array([s1, s2])

    def __call__(self, xs: np.ndarray) -> np.ndarray:
        whole = len(xs) // self.block * self.block
        blocks = np.asarray(xs[:whole], float).reshape(-1, self.block)
        begun = np.empty((len(blocks), 2))
        (a, b), (c, d) = self.step.tolist()
        s1, s2 = map(float, self.state)
        for i, (p1, p2) in enumerate((blocks @ self.push.T).tolist()):  # only the registers pass from block to block
            begun[i] = s1, s2
            s1, s2 = a * s1 + b * s2 + p1, c * s1 + d * s2 + p2
        rest, self.state = self._run(xs[whole:], np.array([s1, s2]))
        return np.concatenate([(blocks @ self.forced.T + begun @ self.free.T).ravel(), rest])


def registers(stages: list[Biquad]) -> np.ndarray:
    return np.concatenate([s.state for s in stages])


def with_registers(stages: list[Biquad], state: np.ndarray) -> list[Biquad]:
    for i, stage in enumerate(stages):
        stage.state = np.array(state[2 * i : 2 * i + 2], float)
    return stages


def cascade(stages: list[Biquad], xs: np.ndarray) -> np.ndarray:
    for stage in stages:
        xs = stage(xs)
    return xs


def transition(stages: list[Biquad], n: int) -> np.ndarray:
    """What ``n`` silent samples make of the registers of filters in a row: with it, the registers after a stretch are linear in those before it."""
    columns = []
    for unit in np.eye(2 * len(stages)):
        cascade(with_registers(stages, unit), np.zeros(1))
        columns.append(registers(stages))
    return np.linalg.matrix_power(np.stack(columns, 1), n)


def shares(stages: list[Biquad], n: int) -> np.ndarray:
    """(n, registers): what each of ``n`` samples adds to the registers at their end; so ``xs @ shares`` is what they make of empty ones."""
    step, out = transition(stages, 1), np.empty((n, 2 * len(stages)))
    cascade(with_registers(stages, np.zeros(2 * len(stages))), np.ones(1))
    own = registers(stages)
    for i in range(n - 1, -1, -1):
        out[i], own = own, step @ own
    return out


def band_pass(hpf_hz: float, ceiling_hz: float, rate: float) -> list[Biquad]:
    """Low-pass at the ceiling, then high-pass, both kept within the band."""
    top = rate / 2
    high = min(max(hpf_hz, 10.0), top - 100.0)
    low = min(max(ceiling_hz, high + 50.0), top - 50.0)
    return [Biquad(*biquad("low", low, rate)), Biquad(*biquad("high", high, rate))]


def resample(xs: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling of a whole run by its spectrum."""
    n = int(round(len(xs) * to / rate))
    if not len(xs) or not n:
        return np.zeros(0)
    spectrum = np.fft.rfft(xs)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(out), len(spectrum))
    out[:m] = spectrum[:m]
    return np.fft.irfft(out, n) * (n / len(xs))


def slaney_mel(hz):
    hz = np.asarray(hz, float)
    return np.where(hz < 1000.0, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def slaney_hz(mel):
    mel = np.asarray(mel, float)
    return np.where(mel < 15.0, 200 * mel / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_filters(bands: int = MEL_BANDS, fft: int = MEL_FFT, rate: int = MEL_RATE, low: float = MEL_LOW, high: float = MEL_HIGH) -> np.ndarray:
    """Triangles of equal area on the Slaney scale: (bands, fft / 2 + 1)."""
    edges = slaney_hz(np.linspace(slaney_mel(low), slaney_mel(high), bands + 2))
    hz = np.arange(fft // 2 + 1) * rate / fft
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((hz - left) / (centre - left), (right - hz) / (right - centre))) * 2 / (right - left)


def log_mel(frames: np.ndarray, filters: np.ndarray) -> np.ndarray:
    power = np.abs(np.fft.rfft(frames * hann(frames.shape[-1]))) ** 2
    return np.log(np.maximum(power @ filters.T, MEL_FLOOR))


def differences(frames: np.ndarray) -> np.ndarray:
    """Normalised square difference of each lag below half the frame, within -1..1, a row per frame; zeros for a silent frame."""
    n = frames.shape[1]
    spectrum = np.fft.rfft(frames, 2 * n)
    r = np.fft.irfft(spectrum * spectrum.conj())[:, : n // 2]
    powers = frames * frames
    squares = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(powers, 1)], 1)
    lags = np.arange(n // 2)
    m = squares[:, n - lags] + squares[:, n:] - squares[:, lags]
    return np.where(powers.sum(1)[:, None] < 1e-9, 0.0, np.clip(2 * r / np.maximum(m, 1e-12), -1, 1))


def difference(frame: np.ndarray) -> np.ndarray:
    """``differences`` of one frame."""
    return differences(np.asarray(frame, float)[None])[0] if len(frame) else np.zeros(0)


def two_peaks(nsdf: np.ndarray, first: int = 8, last: int = 510) -> tuple[float, float]:
    """(strength of the first peak of 0.8 of the largest or more, share of the best peak that is at no multiple of its lag)."""
    inner = nsdf[first : last + 1]
    at = np.flatnonzero((inner[1:-1] > inner[:-2]) & (inner[1:-1] >= inner[2:]) & (inner[1:-1] > 0)) + first + 1
    if not len(at):
        return 0.0, 0.0
    lag = at[nsdf[at] >= 0.8 * nsdf[at].max()][0]
    near = np.abs(at - np.round(at / lag) * lag) <= 3
    others = nsdf[at[~near]]
    return float(nsdf[lag]), float(others.max() / nsdf[lag]) if len(others) else 0.0


def mcleod(frame: np.ndarray, rate: float, clarity: float = 0.7, power: float = 5e-5) -> tuple[float, float]:
    """(frequency, clarity) by the McLeod pitch method: the first key maximum near the largest, refined by a parabola; (0, 0) if there is none."""
    return (0.0, 0.0) if frame @ frame < power * len(frame) else key_maximum(difference(frame), rate, clarity)


def key_maximum(d: np.ndarray, rate: float, clarity: float) -> tuple[float, float]:
    """(frequency, clarity) of a frame's ``difference``: key maxima are the largest values between its zero crossings."""
    below = np.flatnonzero(d <= 0)
    if not len(below):
        return 0.0, 0.0
    turns = np.flatnonzero(np.diff(d[below[0] :] > 0)) + below[0] + 1  # rises and falls in turn; a rise without a fall is no key maximum
    turns = turns[: len(turns) // 2 * 2]
    if not len(turns):
        return 0.0, 0.0
    most = np.maximum.reduceat(d, turns)[::2]
    nth = 2 * int(np.argmax(most >= 0.93 * most.max()))
    lag = int(turns[nth] + np.argmax(d[turns[nth] : turns[nth + 1]]))
    if d[lag] < clarity or not 0 < lag < len(d) - 1:
        return 0.0, 0.0
    a, b, c = d[lag - 1 : lag + 2]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(rate / (lag + shift)), float(min(1.0, b - 0.25 * (a - c) * shift))


# Critical bands, calibration, spreading per band and growth of loudness.
BARK_HZ = (20.0, 100.0, 200.0, 300.0, 400.0, 510.0, 630.0, 770.0, 920.0, 1080.0, 1270.0, 1480.0, 1720.0, 2000.0, 2320.0, 2700.0, 3150.0, 3700.0, 4400.0, 5300.0, 6400.0, 7700.0, 9500.0, 12000.0, 15500.0)
FULL_SCALE_DB, SPREAD_UP, SPREAD_DOWN, GROWTH, SCALE = 94.0, 10**-1.2, 10**-2.7, 0.23, 0.08
BANDS = len(BARK_HZ) - 1


def quiet_power() -> np.ndarray:
    """Terhardt's threshold in quiet at the middle of each band, as power of full scale."""
    k = np.maximum((np.array(BARK_HZ[:-1]) + np.array(BARK_HZ[1:])) / 2000, 0.02)
    return 10 ** ((3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4 - FULL_SCALE_DB) / 10)


def spreading() -> np.ndarray:
    """What each band (column) excites of each other (row)."""
    up = np.arange(BANDS)[:, None] - np.arange(BANDS)
    return np.where(up >= 0, SPREAD_UP ** np.maximum(up, 0), SPREAD_DOWN ** np.maximum(-up, 0))


def band_of_bins(bins: int, rate: float) -> np.ndarray:
    """The band of each spectral bin, -1 for none (DC among them)."""
    edges = np.clip(np.round(np.array(BARK_HZ) * 2 * bins / rate).astype(int), 1, bins)
    out = np.full(bins, -1)
    for band in range(BANDS - 1, -1, -1):
        out[edges[band] : max(edges[band + 1], edges[band] + 1)] = band
    return out


def band_sums(values: np.ndarray, band: np.ndarray) -> np.ndarray:
    return np.bincount(band[band >= 0], values[band >= 0], BANDS)


def specific_loudness(magnitude: np.ndarray, rate: float) -> np.ndarray:
    """Sones per critical band of one magnitude spectrum (of a frame twice as long)."""
    power = band_sums((magnitude / (2 * len(magnitude))) ** 2, band_of_bins(len(magnitude), rate))
    ratio = spreading() @ power / quiet_power()
    return np.where(ratio > 1, SCALE * ((1 + ratio) ** GROWTH - 1), 0.0)


def near_bins(midi: int, bins: int, rate: float, harmonics: int = 12) -> np.ndarray:
    """The bins within one of a key's harmonics."""
    centres = np.round(440 * 2 ** ((midi - 69) / 12) * np.arange(1, harmonics + 1) * 2 * bins / rate).astype(int)
    found = np.unique((centres[:, None] + np.arange(-1, 2)).ravel())
    return found[(found >= 0) & (found < bins)]


def key_loudness(spectra: np.ndarray, rate: float, keys: np.ndarray) -> np.ndarray:
    """Sones of each key in each spectrum (rows): of each band's loudness the share of its power that lies near the key's harmonics.

    All spectra at once: powers to bands, bands to loudness, and back to bins as the loudness that a bin stands for; a key then sums its bins.
    """
    bins = spectra.shape[1]
    band = band_of_bins(bins, rate)
    in_band = (band[:, None] == np.arange(BANDS)).astype(float)
    power = spectra**2
    total = power @ in_band
    ratio = total / (2 * bins) ** 2 @ spreading().T / quiet_power()
    loud = np.where(ratio > 1, SCALE * ((1 + np.maximum(ratio, 0)) ** GROWTH - 1), 0.0)
    per_power = np.divide(loud, total, out=np.zeros_like(loud), where=total > 0)
    near = np.zeros((bins, len(keys)))
    for i, midi in enumerate(keys.tolist()):
        near[near_bins(midi, bins, rate), i] = 1.0
    return power * (per_power @ in_band.T) @ near


def note_loudness(magnitude: np.ndarray, rate: float, midi: int) -> float:
    """Sones of one key in one magnitude spectrum."""
    return float(key_loudness(np.asarray(magnitude, float)[None], rate, np.array([midi]))[0, 0])
