"""Numpy kernels for what expressions cannot say; called from grouped Arrow maps."""

from __future__ import annotations

import numpy as np


def savgol_weights(half: int, order: int) -> np.ndarray:
    """Weights of the centre value of a least-squares polynomial over 2 half + 1 points."""
    x = np.arange(-half, half + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def butterworth(order: int, cutoff: float, fs: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a low-pass, by the bilinear transform; even order."""
    warped = np.tan(np.pi * cutoff / fs)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * warped + warped**2
        g = warped**2 / d
        out.append((g, 2 * g, g, 2 * (warped**2 - 1) / d, (1 - q * warped + warped**2) / d))
    return np.array(out)


def recurse(x: np.ndarray, section: np.ndarray, block: int = 64) -> np.ndarray:
    """A second-order recursion over ``x``, settled at its first value, a block of samples at a time: within a block the output is the response to
    the block's input plus that to the two outputs before it, both matrices that are made once."""
    b0, b1, b2, a1, a2 = section
    h = np.zeros(block)  # impulse response of 1 / (1 + a1 z + a2 z^2)
    g = np.zeros((block, 2))  # response to the outputs one and two samples before
    one, two = 0.0, 0.0
    for i in range(block):
        h[i] = (1.0 if i == 0 else 0.0) - a1 * one - a2 * two
        one, two = h[i], one
    for j, (p, q) in enumerate(((1.0, 0.0), (0.0, 1.0))):
        for i in range(block):
            g[i, j] = -a1 * p - a2 * q
            p, q = g[i, j], p
    lower = np.array([[h[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    padded = np.concatenate(([x[0], x[0]], x))
    feed = b0 * x + b1 * padded[1:-1] + b2 * padded[:-2]
    out = np.empty(len(x))
    last = np.array([x[0], x[0]]) * ((b0 + b1 + b2) / (1 + a1 + a2))
    for s in range(0, len(x), block):
        n = min(block, len(x) - s)
        out[s : s + n] = lower[:n, :n] @ feed[s : s + n] + g[:n] @ last
        last = np.array([out[s + n - 1], out[s + n - 2] if n > 1 else last[0]])
    return out


def lowpass(x: np.ndarray, fs: float, cutoff: float, order: int = 6, zero_phase: bool = True) -> np.ndarray:
    """Low-pass, forward and backward over the mirrored trace (zero phase), or forward only."""
    pad = min(len(x) - 1, 3 * order)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad else x.astype(float)
    if not zero_phase:
        y, pad = x.astype(float), 0
    for _ in range(2 if zero_phase else 1):
        for section in butterworth(order, cutoff, fs):
            y = recurse(y, section)
        if zero_phase:
            y = y[::-1]
    return y[pad : len(y) - pad] if pad else y


def rank_one(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Time and direction components of a response matrix, with the sign that fits its mean, and their share of variance."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    t, d = u[:, 0], vt[0]
    sign = 1.0 if np.dot(t, m.mean(1)) >= 0 else -1.0
    return sign * t, sign * d, float(s[0] ** 2 / max((s[:3] ** 2).sum(), 1e-300))


def band_power_ratio(x: np.ndarray, fs: float, high=(2.0, 16.0), low=(0.5, 1.0), constant: float = 1e4) -> float:
    p = np.abs(np.fft.rfft(x)) ** 2
    f = np.fft.rfftfreq(len(x), 1 / fs)
    band = lambda b: p[(f >= b[0]) & (f <= b[1])].mean() if ((f >= b[0]) & (f <= b[1])).any() else 0.0
    return float(np.log10(max(constant * band(high) / max(band(low), 1e-12), 1e-12)))


def fit_sigmoid(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """(x0, k, a) by damped Gauss-Newton from the half-height point."""
    p = np.array([x[np.argmin(np.abs(y - y.max() / 2))], 4 / max(np.ptp(x), 1e-9), max(y.max(), 1e-9)], float)
    damp = 1e-2
    cost = np.inf
    for _ in range(rounds):
        e = np.exp(-np.clip(p[1] * (x - p[0]), -50, 50))
        f = p[2] / (1 + e)
        r = y - f
        if (now := float(r @ r)) < cost:
            cost, kept, damp = now, p.copy(), damp / 2
            d = p[2] * e / (1 + e) ** 2
            j = np.stack((-d * p[1], d * (x - p[0]), 1 / (1 + e)), 1)
            jr, jj = j.T @ r, j.T @ j
        else:
            damp *= 4
        p = kept + np.linalg.solve(jj + damp * np.diag(np.diag(jj) + 1e-12), jr)
    return tuple(float(v) for v in kept)


def polygon_area(x: np.ndarray, y: np.ndarray) -> float:
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def hull_area(points: np.ndarray) -> float:
    pts = sorted(map(tuple, points))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1]))
    return polygon_area(ring[:, 0], ring[:, 1]) if len(ring) > 2 else 0.0
