"""Numpy kernels of direction tuning and Fourier resampling."""

from __future__ import annotations

import numpy as np

#: Seconds at which a bar's bright edge enters, its dark edge enters, and the response ends.
BAR = (1.152, 2.432, 3.712)


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples of the Fourier series of ``x``."""
    f = np.fft.rfft(x)
    keep = min(n, len(x)) // 2 + 1
    g = np.zeros(n // 2 + 1, complex)
    g[:keep] = f[:keep]
    if min(n, len(x)) % 2 == 0 and n != len(x):  # the middle frequency stands for two
        g[keep - 1] *= 0.5 if n > len(x) else 2.0
    return np.fft.irfft(g, n) * (n / len(x))


def unit_range(x: np.ndarray) -> np.ndarray:
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high > low else np.zeros(len(x))


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 0, ties at their mean."""
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n + 1) / 2)[back]


def components(m: np.ndarray, dt: float, version: int) -> tuple[np.ndarray, np.ndarray]:
    """Time and direction components of the best rank-one fit.  They are turned round only where both look turned:
    the directions' signs are negative in the mean, and the time course fits the mean response better when turned (by rank
    correlation in the first version, by squares in the second); with signs even, the time course alone decides."""
    u, _, vt = np.linalg.svd(m, full_matrices=False)
    time, way = u[:, 0], vt[0]
    mean = m.mean(1)
    if version == 1:
        a, b = ranks(time), ranks(mean)
        turned = np.dot(a - a.mean(), b - b.mean()) < 0
    else:
        turned = ((time + mean) ** 2).mean() < ((time - mean) ** 2).mean()
    signs = np.sign(np.sign(way).mean())
    if turned and signs <= 0:
        time, way = -time, -way
    first = max(1, int(round(1 / dt)) if version == 1 else int(1 / dt))
    time = time - time[:first].mean()
    return time / np.abs(time).max(), unit_range(way)


def selectivity(way: np.ndarray, angles: np.ndarray, per: int) -> tuple[float, float]:
    """Length of the vector sum (corrected for the bins' width) over the sum, and its angle (orientations from 0 to pi)."""
    step = per * (angles[1] - angles[0])
    v = np.exp(per * 1j * angles) @ way
    angle = np.angle(v) / per
    total = way.sum()
    return float(step / (2 * np.sin(step / 2)) * np.abs(v) / total) if total else 0.0, float(angle + np.pi if per == 2 and angle < 0 else angle)


def null_share(by_rep: np.ndarray, angles: np.ndarray, per: int, version: int, shuffles: int, seed: int, observed: float) -> float:
    """Share of shuffles of all responses (repeats x directions) that are tuned more than the one observed."""
    rng = np.random.default_rng([seed, per])
    order = rng.permuted(np.tile(by_rep.ravel(), (shuffles, 1)), axis=1).reshape(shuffles, *by_rep.shape).mean(1)
    if version == 1:
        low = order - order.min(1, keepdims=True)
        high = np.abs(low).max(1, keepdims=True)
        null = np.array([selectivity(x, angles, per)[0] for x in low / np.where(high > 0, high, 1)])
    else:
        null = np.abs(order @ (np.exp(per * 1j * angles) / np.sqrt(len(angles))))
    return float((null > observed).mean()) if shuffles else 1.0


def on_off(time: np.ndarray, dt: float) -> float:
    """Contrast of the steepest rises of the time course at the bright and the dark edge, to two places."""
    a, b, c = (int(np.round(t / dt)) for t in BAR)
    rise = np.diff(unit_range(time))
    up, down = (max(0.0, float(rise[s:e].max(initial=0.0))) for s, e in ((a, b), (b, c)))
    return round((up - down) / (up + down), 2) if up + down >= 1e-9 else 0.0


def quality(cube: np.ndarray) -> float:
    """Largest over directions of the variance of the mean response over the mean variance of repeats."""
    below = cube.var(0).mean(-1)
    return float(np.max(np.divide(cube.mean(-1).var(0), below, out=np.zeros(cube.shape[1]), where=below > 0)))


def describe(cube: np.ndarray, degrees: list[float], dt: float, version: int = 2, shuffles: int = 1000, seed: int = 1) -> tuple:
    """All of the above of responses time x direction x repeat, directions in order."""
    angles = np.deg2rad(np.asarray(degrees, float))
    time, way = components(cube.mean(-1), dt, version)
    projected = np.einsum("tdr,t->dr", cube, time)
    mean = unit_range(projected.mean(-1))
    ds, pref = selectivity(way, angles, 1)
    os_, pref_or = selectivity(way, angles, 2)
    p = []
    for per in (1, 2):
        observed = selectivity(mean, angles, per)[0] if version == 1 else float(np.abs(projected.mean(-1) @ np.exp(per * 1j * angles)) / np.sqrt(len(angles)))
        p.append(null_share(projected.T, angles, per, version, shuffles, seed, observed))
    return ds, p[0], pref, os_, p[1], pref_or, on_off(time, dt), quality(cube), time.tolist(), way.tolist(), selectivity(mean, angles, 1)[0]
