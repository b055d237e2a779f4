"""Numpy kernels for curve fits, splines, peaks and contours; inputs are one key's bounded arrays."""

from __future__ import annotations

import math

import numpy as np


def least_squares(model, start, low, high, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton within bounds, with numeric derivatives; returns (parameters, mean squared error)."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    f = model(p)
    cost, damp = float(np.sum((y - f) ** 2)), 1e-3
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        step = np.where(p + step > high, -step, step)
        j = np.stack([(model(p + np.eye(len(p))[i] * step[i]) - f).ravel() / step[i] for i in range(len(p))], 1)
        a, g = j.T @ j, j.T @ (y - f).ravel()
        for _ in range(12):
            q = np.clip(p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), g), low, high)
            fq = model(q)
            now = float(np.sum((y - fq) ** 2))
            if np.isfinite(now) and now < cost:
                break
            damp *= 4
        else:
            break
        done = cost - now <= 1e-12 * max(cost, 1e-300)
        p, f, cost, damp = q, fq, now, damp / 5
        if done:
            break
    return p, cost / max(y.size, 1)


def naka_rushton(s: np.ndarray, p) -> np.ndarray:
    base, top, half, n = p
    if half == 0:
        return np.full(len(s), base + top / 2)
    with np.errstate(divide="ignore"):
        return base + top / (1 + (half / np.maximum(s, 1e-12)) ** n)


def fit_naka_rushton(s: np.ndarray, y: np.ndarray, restarts: int = 5, seed: int = 42) -> tuple[np.ndarray, float]:
    """(base, amplitude, half-maximum, slope) with the least error of seeded restarts."""
    spread, reach = max(float(np.ptp(y)), 1e-9), max(float(np.ptp(s)), 1e-9)
    start = np.array([y.min(), spread, s.min() + reach / 2, 2.0])
    low, high = [y.min() - spread, 0.0, 1e-9, 0.1], [y.max(), 3 * spread, s.max() + reach, 20.0]
    rng = np.random.default_rng(seed)
    tries = [start] + [start * (1 + 0.3 * rng.standard_normal(4)) for _ in range(restarts)]
    return min((least_squares(lambda p: naka_rushton(s, p), t, low, high, y) for t in tries), key=lambda r: r[1])


def gaussian2d(x: np.ndarray, y: np.ndarray, p) -> np.ndarray:
    """amplitude, x, y, standard deviations along the turned axes, angle."""
    a, x0, y0, sx, sy, th = p
    u, v = (x - x0) * np.cos(th) + (y - y0) * np.sin(th), (y - y0) * np.cos(th) - (x - x0) * np.sin(th)
    return a * np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2))


def explained(image: np.ndarray, fit: np.ndarray) -> float:
    v = image.var()
    return float(1 - (image - fit).var() / v) if v else 0.0


def fit_spatial(image: np.ndarray, surround: bool = False) -> dict:
    """Gaussian centre (both polarities tried, the better kept), with ``surround`` less a wider one
    that shares its place and angle; image is indexed [x, y]."""
    x, y = np.meshgrid(np.arange(image.shape[0]), np.arange(image.shape[1]), indexing="ij")
    wide = max(image.shape)
    best = None
    for sign in (1, -1):
        im = sign * image
        px, py = np.unravel_index(np.argmax(im), im.shape)
        top = max(float(im.max()), 1e-9)
        sd = max(np.sqrt(np.mean(im >= 0.35 * top) * im.size / np.pi) / 1.5, 0.5)
        p0 = [top, px, py, sd, sd, 0.0]
        low, high = [0, -0.5, -0.5, 0.3, 0.3, -np.pi / 2], [4 * top, image.shape[0] - 0.5, image.shape[1] - 0.5, wide, wide, np.pi / 2]
        model = lambda p: gaussian2d(x, y, p)
        p, mse = least_squares(model, p0, low, high, im)
        centre = gaussian2d(x, y, p)
        fit = centre
        if surround:
            both = lambda p: gaussian2d(x, y, p[:6]) - gaussian2d(x, y, [p[0] * p[6], p[1], p[2], p[3] * p[7], p[4] * p[7], p[5]])
            p, mse = least_squares(both, [*p, 0.2, 2.0], [*low, 0.0, 1.0], [*high, 1.0, 6.0], im)
            centre, fit = gaussian2d(x, y, p[:6]), both(p)
        if best is None or mse < best["mse"]:
            names = ["amplitude", "x_mean", "y_mean", "x_stddev", "y_stddev", "theta", "surround_share", "surround_scale"]
            best = {**dict(zip(names, map(float, p), strict=False)), "polarity": sign, "mse": mse, "explained": explained(im, fit), "centre": sign * centre, "fit": sign * fit}
    return best


def smooth(image: np.ndarray, sd: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian blur along both axes, mirrored at the edges."""
    r = int(truncate * sd + 0.5)
    if not r:
        return image.astype(float)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sd) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        image = np.apply_along_axis(np.convolve, axis, np.pad(image, pad, mode="symmetric"), k, "valid")
    return image


def natural_spline(x: np.ndarray, y: np.ndarray):
    """Interpolating cubic with no curvature at the ends, as a function."""
    n, h = len(x), np.diff(x)
    a = np.eye(n)
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)

    def at(t):
        k = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
        u, v = x[k + 1] - t, np.asarray(t) - x[k]
        return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v

    return at


def peaks(v: np.ndarray, height: float, prominence: float) -> np.ndarray:
    """Local maxima (middle of a flat top) of at least the height and prominence given."""
    out, i, n = [], 1, len(v)
    while i < n - 1:
        j = i
        while j < n - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < n - 1 and v[j + 1] < v[i] and v[i] >= height:
            higher = np.flatnonzero(v > v[i])
            left, right = higher[higher < i], higher[higher > j]
            a = v[(left[-1] + 1 if len(left) else 0) : i + 1].min()
            b = v[j : (right[0] if len(right) else n)].min()
            if v[i] - max(a, b) >= prominence:
                out.append((i + j) // 2)
        i = j + 1
    return np.array(out, int)


def temporal_features(t: np.ndarray, v: np.ndarray, nstd: float = 1.0, latest: float = np.inf, baseline: float = 0.0) -> dict:
    """Polarity of the last peak, lag of the main one, biphasic (transience) index, width at half
    amplitude, and the share of weight in the first ``baseline`` seconds. Fields are None without a peak."""
    w = np.where(t > latest, 0.0, v)
    sd = v.std()
    at = np.sort(np.concatenate([peaks(s * w, nstd * sd, nstd * sd / 2) for s in (1, -1)]))
    total = np.abs(v).sum()
    out = {"polarity": 0, "peak_lag": None, "transience": None, "half_width": None, "baseline_share": float(np.abs(v[t <= t.min() + baseline]).sum() / total) if total else None}
    if not len(at):
        return out
    out["polarity"] = 1 if w[at[-1]] > 0 else -1
    at = at[t[at] <= latest]
    two = sorted(at[np.argsort(-np.abs(v[at]), kind="stable")[:2]])
    if not two:
        return out
    main = two[-1]
    if len(two) > 1:
        pre = two[0]
    elif main:
        pre = int(np.argmin(v[:main]) if v[main] > 0 else np.argmax(v[:main]))
    else:
        pre = main
    opposite = np.sign(v[pre]) != np.sign(v[main])
    out["transience"] = float(min(1.0, 2 * abs(v[pre]) / (abs(v[main]) + abs(v[pre])))) if opposite else 0.0
    if (np.diff(t) <= 0).any():
        raise ValueError("a time course has one value a time")
    f = natural_spline(t, v)
    near = np.linspace(t[main] - 0.1, t[main] + 0.1, 1001)
    out["peak_lag"] = float(-near[np.argmax(f(near))])
    out["half_width"] = _half_width(t, f, t[main], v[main])
    return out


def _half_width(t: np.ndarray, f, at: float, top: float) -> float:
    """Distance of the places nearest the peak, on either side, where the spline falls to half."""
    sides = []
    for end in (t[0], t[-1]):
        g = np.linspace(at, end, 2001)
        below = np.flatnonzero(f(g) / top < 0.5)
        if not len(below):
            sides.append(end)
            continue
        k = below[0]
        a, b = f(g[k - 1]) / top - 0.5, f(g[k]) / top - 0.5
        sides.append(g[k - 1] + (g[k] - g[k - 1]) * a / (a - b))
    return float(abs(sides[1] - sides[0]))


def bspline_basis(n: int, df: int, degree: int = 3) -> np.ndarray:
    """n points by df B-splines on an even clamped knot vector."""
    degree = min(degree, df - 1)
    inner = np.linspace(0, 1, df - degree + 1)
    knots = np.concatenate(([0.0] * degree, inner, [1.0] * degree))
    x = np.linspace(0, 1, n)
    b = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    b[x == 1, df - 1] = 1
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        a = np.divide(x[:, None] - knots[: -d - 1], left, out=np.zeros((n, len(left))), where=left > 0)
        c = np.divide(knots[d + 1 :] - x[:, None], right, out=np.zeros((n, len(right))), where=right > 0)
        b = a * b[:, :-1] + c * b[:, 1:]
    return b


def lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows of x (or of each row of it) and its ``lags - 1`` predecessors, zeros before the start."""
    out = np.zeros((*x.shape, lags))
    for k in range(min(lags, x.shape[-1])):
        out[..., k:, k] = x[..., : x.shape[-1] - k]
    return out


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each matrix of a stack times its vector."""
    return np.matmul(x, w[..., None])[..., 0]


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row of ``a`` with its row of ``b``; 0 where either is constant."""
    if a.shape[1] < 2:
        return np.zeros(len(a))
    x = np.stack((a, b), 1)
    x = x - x.mean(2, keepdims=True)
    c = np.matmul(x, x.swapaxes(1, 2)) * np.true_divide(1, a.shape[1] - 1)
    with np.errstate(all="ignore"):
        r = np.clip(c[:, 0, 1] / np.sqrt(c[:, 0, 0]) / np.sqrt(c[:, 1, 1]), -1, 1)
        return np.where((a.std(1) > 1e-12) & (b.std(1) > 1e-12), r, 0.0)


def lasso_paths(x: np.ndarray, y: np.ndarray, beta: np.ndarray, xd: np.ndarray, yd: np.ndarray, rounds: int = 1000, least: int = 50, patience: int = 5) -> np.ndarray:
    """Least squares with an L1 penalty by accelerated proximal steps, of a stack of problems of one shape and a penalty each; one stops when
    its error on the development part has not fallen for ``patience`` checks, and is not worked on any further."""
    n = max(x.shape[1], 1)
    top = np.full(len(x), np.nan)
    whole = np.isfinite(x).all((1, 2))
    top[whole] = np.linalg.svd(x[whole], compute_uv=False).max(-1, initial=0.0) if x.shape[1] else 0.0
    step, beta = 1 / np.maximum(top**2 / n, 1e-12)[:, None], np.asarray(beta, float)[:, None]
    out = np.zeros((len(x), x.shape[2]))
    w = z = kept = out.copy()
    m, best, bad, live = 1.0, np.full(len(x), np.inf), np.zeros(len(x), int), np.arange(len(x))
    for k in range(rounds):
        u = z - step * times(x.swapaxes(1, 2), times(x, z) - y) / n
        new = np.sign(u) * np.maximum(np.abs(u) - step * beta, 0)
        m2 = (1 + np.sqrt(1 + 4 * m * m)) / 2
        z, w, m = new + (m - 1) / m2 * (new - w), new, m2
        if k % 10 == 0:
            rest = yd - times(xd, w) if yd.shape[1] else y - times(x, w)
            e = np.mean(rest**2, 1) if rest.shape[1] else np.full(len(rest), np.nan)
            better = e < best - 1e-9
            best, kept = np.where(better, e, best), np.where(better[:, None], w, kept)
            bad = np.where(better, 0, bad + (k >= least))
            on = bad < patience
            if not on.all():
                out[live[~on]] = kept[~on]
                if not on.any():
                    return out
                x, y, xd, yd, step, beta, w, z, kept, best, bad, live = (v[on] for v in (x, y, xd, yd, step, beta, w, z, kept, best, bad, live))
    out[live] = kept
    return out


def _crossings(image: np.ndarray, level: float) -> dict:
    """Marching squares: of every grid edge that the level crosses, the edges it is joined with (two, one on the image's side).  A saddle is resolved
    by the mean of its corners."""
    links: dict = {}
    above = image > level

    def cross(a, b):
        return (a, b) if a < b else (b, a)

    for i in range(image.shape[0] - 1):
        for j in range(image.shape[1] - 1):
            ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            cut = [cross(ring[k], ring[(k + 1) % 4]) for k in range(4) if above[ring[k]] != above[ring[(k + 1) % 4]]]
            if len(cut) == 4:
                joined = (image[i : i + 2, j : j + 2].mean() > level) == above[i, j]
                cut = [cut[0], cut[1], cut[2], cut[3]] if joined else [cut[3], cut[0], cut[1], cut[2]]
            for a, b in zip(cut[::2], cut[1::2], strict=True):
                links.setdefault(a, []).append(b)
                links.setdefault(b, []).append(a)
    return links


def contour_lines(image: np.ndarray, level: float) -> list[tuple[np.ndarray, bool]]:
    """(points, closed) of all lines of equal value, by linear interpolation: first those that run from side to side, then the closed ones
    (their first point stands once)."""
    links, seen, out = _crossings(image, level), set(), []
    ends = sorted(q for q, n in links.items() if len(n) == 1)
    for first in [*ends, *sorted(links)]:
        if first in seen:
            continue
        line, at = [], first
        while at is not None:
            seen.add(at)
            line.append(at)
            at = next((q for q in links[at] if q not in seen), None)
        points = [np.array(a) + (np.array(b) - np.array(a)) * (level - image[a]) / (image[b] - image[a]) for a, b in line]
        closed = len(links[first]) == 2 and len(line) > 2
        out.append((np.array(points, float), closed))
    return out


def contours(image: np.ndarray, level: float) -> list[np.ndarray]:
    """Closed lines of equal value; lines that leave the image are not returned."""
    return [line for line, closed in contour_lines(image, level) if closed]


def polygon_centre(p: np.ndarray) -> tuple[float, float]:
    q = np.roll(p, -1, 0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return tuple(float(v) for v in ((p + q) * c[:, None]).sum(0) / (3 * c.sum()))


def inside(p: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centre lies in a polygon (even-odd rule)."""
    x, y = np.meshgrid(np.arange(shape[0]), np.arange(shape[1]), indexing="ij")
    out = np.zeros(shape, bool)
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0), strict=True):
        if ay != by:
            out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def dilate(mask: np.ndarray, radius: float) -> np.ndarray:
    """Union of the mask moved over an open disk."""
    r = math.ceil(radius)
    out = np.zeros_like(mask)
    padded = np.pad(mask, r)
    for dx in range(-r, r + 1):
        for dy in range(-r, r + 1):
            if dx * dx + dy * dy < radius * radius or dx == dy == 0:
                out |= padded[r + dx : r + dx + mask.shape[0], r + dy : r + dy + mask.shape[1]]
    return out


def agglomerate(x: np.ndarray, weight: np.ndarray, linkage: str = "ward", k: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Labels 0.. of bottom-up clustering until ``k`` clusters are left or the least distance exceeds
    ``threshold``. ``ward`` is on weighted points; ``complete`` and ``average`` on 1 - correlation."""
    n = len(x)
    if linkage == "ward":
        return _ward(x, weight, k, threshold)
    c = x - x.mean(1, keepdims=True)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    d = 1 - c @ c.T
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    w, alive, label = weight.astype(float).copy(), n, np.arange(n)
    while alive > max(k or 1, 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if threshold is not None and d[i, j] > threshold:
            break
        if linkage == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        new[~np.isfinite(new)] = np.inf
        d[i], d[:, i], d[i, i] = new, new, np.inf
        d[j], d[:, j] = np.inf, np.inf
        w[i] += w[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def _ward(x: np.ndarray, weight: np.ndarray, k: int | None, threshold: float | None) -> np.ndarray:
    """Ward by chains of nearest neighbours: exact, with memory for the points alone."""
    n = len(x)
    at, w, alive = x.astype(float).copy(), weight.astype(float).copy(), np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i = chain[-1]
        d = np.einsum("ij,ij->i", at - at[i], at - at[i]) * (2 * w * w[i] / (w + w[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            del chain[-2:]
            i, j = sorted((i, j))
            merges.append((float(np.sqrt(d[j] if np.isfinite(d[j]) else d[i])), i, j))
            at[i] = (w[i] * at[i] + w[j] * at[j]) / (w[i] + w[j])
            w[i] += w[j]
            alive[j] = False
        else:
            chain.append(j)
    label = np.arange(n)
    for far, i, j in sorted(merges, key=lambda m: m[0])[: n - max(k or 1, 1)]:
        if threshold is not None and far > threshold:
            break
        a, b = sorted((label[i], label[j]))
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def sparse_components(cov: np.ndarray, k: int, share: float = 0.2, rounds: int = 200) -> np.ndarray:
    """k sparse unit loadings from a covariance: power steps with weights below ``share`` of the
    largest cut to zero, deflating what each explains."""
    out, c = [], cov.astype(float).copy()
    for _ in range(k):
        v = c[:, np.argmax(np.diag(c))].copy()
        if not np.any(v):
            out.append(np.zeros(len(c)))
            continue
        v /= np.linalg.norm(v)
        for _ in range(rounds):
            u = c @ v
            top = np.abs(u).max()
            u = np.sign(u) * np.maximum(np.abs(u) - share * top, 0)
            u /= max(np.linalg.norm(u), 1e-300)
            if np.abs(u - v).max() < 1e-10:
                break
            v = u
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out.append(v)
        p = np.eye(len(c)) - np.outer(v, v)
        c = p @ c @ p
    return np.array(out)


def spread_explained(cov: np.ndarray, loadings: np.ndarray) -> float:
    """Share of variance in the span of the loadings."""
    q, r = np.linalg.qr(loadings.T)
    q = q[:, np.abs(np.diag(r)) > 1e-9]
    return float(np.trace(q.T @ cov @ q) / np.trace(cov))


OUTPUTS = {
    "none": (lambda z: z, lambda z: np.ones_like(z)),
    "exponential": (lambda z: np.exp(np.minimum(z, 50.0)), lambda z: np.exp(np.minimum(z, 50.0))),
    "softplus": (lambda z: np.logaddexp(0.0, z), lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))),
}


def deviance(y: np.ndarray, rate: np.ndarray, loss: str) -> float:
    """Mean loss: squared error over two, or the Poisson negative log-likelihood without its constant."""
    if loss == "gaussian":
        return float(np.mean((y - rate) ** 2) / 2)
    return float(np.mean(rate - y * np.log(np.maximum(rate, 1e-12))))


def deviances(y: np.ndarray, rate: np.ndarray, loss: str) -> np.ndarray:
    """:func:`deviance` of each row."""
    if loss == "gaussian":
        return np.mean((y - rate) ** 2, 1) / 2
    return np.mean(rate - y * np.log(np.maximum(rate, 1e-12)), 1)


def newton_steps(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, beta: float, loss: str, output: str, sweeps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Of each problem of a stack the minimum of the loss' quadratic model at (w, b) plus ``beta`` times the weights' sizes, by coordinate descent; the
    constants are free."""
    link, slope = OUTPUTS[output]
    z = times(x, w) + b[:, None]
    rate, d = link(z), slope(z)
    if loss == "poisson":
        rate = np.maximum(rate, 1e-12)
        g, h = (1 - y / rate) * d, d * d / rate
    else:
        g, h = (rate - y) * d, d * d
    a = np.concatenate((x, np.ones((*y.shape, 1))), 2)
    grad, curve = times(a.swapaxes(1, 2), g) / y.shape[1], np.matmul((a * h[..., None]).swapaxes(1, 2), a) / y.shape[1]
    at = np.column_stack((w, b))
    out, step, live = at.copy(), np.zeros(at.shape), np.arange(len(at))
    for _ in range(sweeps):
        moved = np.zeros(len(at))
        for j in range(at.shape[1]):
            c = curve[:, j, j] + 1e-12
            want = at[:, j] - (grad[:, j] + np.matmul(curve[:, j, None, :], step[..., None])[:, 0, 0]) / c
            if j < w.shape[1]:
                want = np.sign(want) * np.maximum(np.abs(want) - beta / c, 0.0)
            delta = want - at[:, j]
            at[:, j] += delta
            step[:, j] += delta
            moved = np.fmax(moved, np.abs(delta))
        on = moved >= 1e-10
        if not on.all():
            out[live[~on]] = at[~on]
            at, step, grad, curve, live = (v[on] for v in (at, step, grad, curve, live))
            if not len(live):
                break
    out[live] = at
    return out[:, :-1], out[:, -1].copy()


def penalised_paths(x: np.ndarray, y: np.ndarray, betas, loss: str = "poisson", output: str = "softplus", rounds: int = 50) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """{beta: (weights, constants)} of generalised linear models with an L1 penalty, of a stack of problems of one shape, by proximal Newton steps
    with halving; each beta starts where the one above it ended.  A problem that has converged is not worked on any further."""
    link, _ = OUTPUTS[output]
    w, mean = np.zeros((len(x), x.shape[2])), y.mean(1)
    b = {"none": mean, "exponential": np.log(np.maximum(mean, 1e-6)), "softplus": np.log(np.expm1(np.maximum(mean, 1e-6)))}[output].copy()
    out = {}
    for beta in sorted(betas, reverse=True):
        cost = lambda xs, ys, v, c, beta=beta: deviances(ys, link(times(xs, v) + c[:, None]), loss) + beta * np.abs(v).sum(1)
        now, live, xs, ys = cost(x, y, w, b), np.arange(len(x)), x, y
        for _ in range(rounds):
            tw, tb = newton_steps(xs, ys, w[live], b[live], beta, loss, output)
            size, before, todo = 1.0, now[live], np.arange(len(live))
            while size > 1e-6 and len(todo):
                at = live[todo]
                nw, nb = w[at] + size * (tw[todo] - w[at]), b[at] + size * (tb[todo] - b[at])
                then = cost(xs[todo], ys[todo], nw, nb)
                fell = then <= now[at]
                w[at[fell]], b[at[fell]], now[at[fell]] = nw[fell], nb[fell], then[fell]
                todo = todo[~fell]
                size /= 2
            on = before - now[live] >= 1e-10 * np.maximum(1.0, np.abs(before))
            if not on.all():
                live, xs, ys = live[on], xs[on], ys[on]
                if not len(live):
                    break
        out[beta] = w.copy(), b.copy()
    return out


def penalised_path(x: np.ndarray, y: np.ndarray, betas, loss: str = "poisson", output: str = "softplus", rounds: int = 50) -> dict[float, tuple[np.ndarray, float]]:
    """:func:`penalised_paths` of one problem."""
    return {beta: (w[0], float(b[0])) for beta, (w, b) in penalised_paths(x[None], y[None], betas, loss, output, rounds).items()}


class Mixture:
    """A Gaussian mixture: weights, means, and a covariance a component (or one for all)."""

    def __init__(self, weights, means, covs, loglik: float, params: float):
        self.weights, self.means, self.covs, self.loglik, self.params = weights, means, covs, loglik, params

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component."""
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs, strict=True)):
            half = np.linalg.cholesky(c)
            z = np.linalg.solve(half, (x - m).T)
            out[:, j] = np.log(w) - 0.5 * (z * z).sum(0) - np.log(np.diag(half)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.logs(x).argmax(1)


def fit_mixture(x: np.ndarray, k: int, kind: str, seed: int = 0, rounds: int = 200, floor: float = 1e-6) -> Mixture:
    """Expectation maximisation from spread-out rows; ``kind`` of covariance: spherical, tied, diag or full."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    k = min(k, n)
    means = [x[rng.integers(n)]]
    for _ in range(1, k):
        d = np.min([((x - m) ** 2).sum(1) for m in means], axis=0)
        means.append(x[rng.choice(n, p=d / d.sum())] if d.sum() > 0 else x[rng.integers(n)])
    means = np.array(means)
    start = np.diag(x.var(0) + floor)
    m = Mixture(np.full(k, 1 / k), means, [start] * k, -np.inf, 0.0)
    before = -np.inf
    for _ in range(rounds):
        logs = m.logs(x)
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        loglik = float(total.sum())
        r = np.exp(logs - total[:, None])
        nk = r.sum(0) + 1e-12
        means = (r.T @ x) / nk[:, None]
        each = []
        for j in range(k):
            d = x - means[j]
            full = (d * r[:, j : j + 1]).T @ d / nk[j]
            if kind == "spherical":
                full = np.eye(dim) * np.trace(full) / dim
            elif kind == "diag":
                full = np.diag(np.diag(full))
            each.append(full)
        if kind == "tied":
            each = [sum(c * w for c, w in zip(each, nk / n, strict=True))] * k
        m = Mixture(nk / nk.sum(), means, [c + floor * np.eye(dim) for c in each], loglik, 0.0)
        if loglik - before < 1e-6 * max(1.0, abs(loglik)):
            break
        before = loglik
    shape = {"spherical": k, "diag": k * dim, "tied": dim * (dim + 1) / 2, "full": k * dim * (dim + 1) / 2}[kind]
    m.params = k - 1 + k * dim + shape
    return m
