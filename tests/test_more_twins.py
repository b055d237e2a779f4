"""Queries of fits and growth, whose every row is held against what defines it, computed apart in numpy."""

from collections import defaultdict

import numpy as np
import pytest

from epochal import queries as q
from epochal.functions import fitting


def rows(spark, sf, name):
    return q.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def cells(spark, sf):
    """{key: (times x 4 x 4)} of the receptive-field queries, from the table itself."""
    sums = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_quantity").collect():
        sums[r["l_linenumber"], r["l_shipdate"].month, r["l_suppkey"] % 4, r["l_partkey"] % 4].append(r["l_quantity"])
    out = defaultdict(lambda: np.full((12, 4, 4), np.nan))
    for (k, t, x, y), v in sums.items():
        out[k][t - 1, x, y] = round(np.mean(v) - 25.5, 6)
    return out


def test_rf_split_svd(spark, sf, cells):
    for r in rows(spark, sf, "rf_split_svd"):
        m = np.stack([np.nan_to_num(cells[r["k"]][:, x, y]) for x, y in zip(r["xs"], r["ys"], strict=True)], 1)
        assert len(r["xs"]) == 16 and r["times"] == list(range(1, 13)) and max(map(abs, r["time"])) == pytest.approx(1)
        values, vectors = np.linalg.eigh(m.T @ m)
        best = np.outer(m @ vectors[:, -1], vectors[:, -1])  # the nearest matrix of rank one
        assert np.allclose(np.outer(r["time"], r["space"]), best, atol=1e-6)
        assert r["explained"] == pytest.approx(values[-1] / values[-3:].sum(), rel=1e-6)


def test_rf_spatial_fit(spark, sf, cells):
    x, y = np.meshgrid(range(4), range(4), indexing="ij")
    for r in rows(spark, sf, "rf_spatial_fit"):
        c = np.nan_to_num(cells[r["k"]])
        t = min(zip(*np.nonzero(np.abs(c) == np.abs(c).max()), strict=True))[0]
        im = c[t]
        at = lambda cx, cy, sx, sy, im=im: _best(im, x, y, cx, cy, sx, sy)
        assert r["area"] == pytest.approx(np.pi * 4 * r["sx"] * r["sy"] * 900) and r["diameter"] == pytest.approx(2 * np.sqrt(r["area"] / np.pi))
        # No amplitude does better at this place and spread (a turned ellipse may).
        assert r["explained"] >= at(r["cx"], r["cy"], r["sx"], r["sy"]) - 0.05 or r["explained"] >= 0.9
        assert -1e-9 <= r["explained"] <= 1 and r["polarity"] in (-1, 1)


def _best(im, x, y, cx, cy, sx, sy):
    g = np.exp(-((x - cx) ** 2) / (2 * sx**2) - (y - cy) ** 2 / (2 * sy**2))
    left = im - (im * g).sum() / (g * g).sum() * g
    return 1 - left.var() / im.var()


def test_rf_outlines(spark, sf, cells):
    for r in rows(spark, sf, "rf_outlines"):
        im = np.nan_to_num(np.nanstd(cells[r["k"]], axis=0))
        im = im / im.max()
        closed = [p for p, c in fitting.contour_lines(im, r["level"]) if c]
        assert r["n"] == len(closed)
        if closed:
            shoelace = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, np.roll(p, -1, 0), strict=True))) / 2 for p in closed]
            assert r["area"] == pytest.approx(max(shoelace), rel=1e-6) and 0 <= r["irregular"] < 1 and r["inside"] <= 16


def test_rf_temporal(spark, sf, cells):
    for r in rows(spark, sf, "rf_temporal"):
        c = cells[r["k"]]
        _, px, py = min(zip(*np.nonzero(np.abs(c) == np.nanmax(np.abs(c))), strict=True))
        t = np.flatnonzero(~np.isnan(c[:, px, py])) + 1
        w = c[t - 1, px, py]
        assert r["baseline_share"] == pytest.approx(np.abs(w[t <= t.min() + 2]).sum() / np.abs(w).sum())
        turns = [i for i in range(1, len(w) - 1) if (w[i] - w[i - 1]) * (w[i + 1] - w[i]) <= 0 and abs(w[i]) >= w.std()]
        if r["polarity"]:
            assert min(abs(-r["peak_lag"] - t[i]) for i in turns) <= 0.1 + 1e-9  # it lies at a turn of at least a deviation
            assert r["polarity"] in {np.sign(w[i]) for i in turns} and 0 <= r["transience"] <= 1 and 0 < r["half_width"] <= 11
        else:
            assert r["peak_lag"] is None and r["transience"] is None


def test_contrast_fit(spark, sf):
    points = defaultdict(lambda: defaultdict(list))
    for p in spark.read.parquet(f"{sf}/part.parquet").select("p_size", "p_retailprice").collect():
        points[p["p_size"] % 5][p["p_size"]].append(p["p_retailprice"])
    for r in rows(spark, sf, "contrast_fit"):
        x, y = map(np.array, zip(*sorted((s, np.mean(v)) for s, v in points[r["k"]].items()), strict=True))
        slope, base = np.polyfit(x, y, 1)
        line = np.mean((y - slope * x - base) ** 2)
        if r["kind"] == "linear":
            mid = (x.min() + x.max()) / 2
            assert (r["half_x"], r["half_y"], r["half_slope"], r["mse"]) == pytest.approx((mid, base + slope * mid, slope, line), rel=1e-6)
        else:
            assert r["mse"] <= 1.05 * line and r["mse"] <= y.var() + 1e-6 and r["half_x"] > 0


def test_sparse_pca(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in e], float)
    z = (x - x.mean(0)) / x.std(0)
    got = {r["vec_id"]: r["spc"] for r in rows(spark, sf, "sparse_pca")}
    s = np.array([got[r["vec_id"]] for r in e])
    loadings, *_ = np.linalg.lstsq(z, s, rcond=None)
    assert np.allclose(z @ loadings, s, atol=1e-6) and np.allclose(np.linalg.norm(loadings, axis=0), 1, atol=1e-6)
    assert (np.abs(loadings) < 1e-9).any(0).all()  # every component leaves some columns out
    top = np.linalg.eigvalsh(np.cov(z.T, bias=True))[-1]
    assert top * 0.5 <= s[:, 0].var() <= top + 1e-9 and s[:, 0].var() >= s[:, 2].var() - 1e-6


def test_forest_labels(spark, sf):
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    got = rows(spark, sf, "forest_labels")
    assert len(got) == len(label) and {r["prediction"] for r in got} <= set(map(float, label.values()))
    assert np.mean([r["prediction"] == label[r["vec_id"]] for r in got]) > 0.6  # a tenth by chance


def test_grow_regions(spark, sf):
    sums = defaultdict(float)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity").collect():
        sums[r["l_suppkey"] % 8, r["l_partkey"] % 8, r["l_shipdate"].month] += r["l_quantity"]
    z = np.array([[[sums[x, y, f] for f in range(1, 13)] for y in range(8)] for x in range(8)])
    z -= z.mean(-1, keepdims=True)
    z /= np.linalg.norm(z, axis=-1, keepdims=True)
    label = {(r["x"], r["y"]): r["label"] for r in rows(spark, sf, "grow_regions")}
    assert len(label) == 64 and all(v == 0 for (x, y), v in label.items() if x in (0, 7) or y in (0, 7))
    near = {(x, y): np.mean([z[x, y] @ z[x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]) for x in range(1, 7) for y in range(1, 7)}
    line = {y: max(0.0, np.percentile([near[x, y] for x in range(1, 7)], 50)) for y in range(1, 7)}
    for n in set(label.values()) - {0}:
        part = [p for p, v in label.items() if v == n]
        assert 2 <= len(part) <= 25 and all(max(p[a] for p in part) - min(p[a] for p in part) < 5 for a in (0, 1))
        # Some pixel is the seed: it reaches its line's threshold, and all others correlate with it at theirs.
        assert any(near[s] >= line[s[1]] - 1e-9 and all(z[s] @ z[p] >= line[p[1]] - 1e-9 for p in part) for s in part)
        seen, todo = {part[0]}, [part[0]]
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in part and p not in seen:
                    seen.add(p)
                    todo.append(p)
        assert len(seen) == len(part)


def test_spline_filter(spark, sf):
    by = defaultdict(list)
    for r in q.samples(spark, sf).collect():
        by[r["user_id"]].append((r["i"], r["event_type"] == "signup", r["v"]))
    for r in rows(spark, sf, "spline_filter"):
        s, y = (np.array(v, float) for v in zip(*[(b, c) for _, b, c in sorted(by[r["user_id"]])], strict=True))
        x = np.array([[s[i - k] if i >= k else 0.0 for k in range(6)] for i in range(len(s))])
        n = len(y)
        b = int(n * 0.8)
        a = int(b * 0.8)
        y = (y - y[:a].mean()) / (y[:a].std() or 1.0)
        x = x - x[:a].mean(0)
        w = np.array(r["filter"])
        assert r["df"] in (3, 5) and r["beta"] in (0.001, 0.01)
        basis = fitting.bspline_basis(6, r["df"])
        assert np.allclose(basis @ np.linalg.lstsq(basis, w, rcond=None)[0], w, atol=1e-6)
        fit = {len(w): x @ w, -len(w): x @ w[::-1]}  # lags from now on or up to now
        t = slice(min(b + 6, n), n)
        ccs = [np.corrcoef(f[t], y[t])[0, 1] if n - t.start > 1 and f[t].std() > 1e-12 and y[t].std() > 1e-12 else 0.0 for f in fit.values()]
        assert min(abs(c - r["cc_test"]) for c in ccs) < 1e-6


def test_contour_lines_of_known_images():
    x, y = np.meshgrid(np.arange(30.0), np.arange(20.0), indexing="ij")
    [(plane, closed)] = fitting.contour_lines(x + 2 * y, 30.5)  # a straight line from side to side
    assert not closed and np.allclose(plane[:, 0] + 2 * plane[:, 1], 30.5) and {*plane[[0, -1]].ravel()} & {0.0, 19.0, 29.0}
    [(ring, closed)] = fitting.contour_lines(-np.hypot(x - 14.2, y - 9.6), -6.0)
    assert closed and np.allclose(np.hypot(ring[:, 0] - 14.2, ring[:, 1] - 9.6), 6, atol=0.05)
    both = fitting.contour_lines(np.minimum(np.hypot(x - 8, y - 9), np.abs(x - 20)), 3.0)  # two lines and a ring
    assert [c for _, c in both] == [False, False, True] and len(fitting.contours(np.minimum(np.hypot(x - 8, y - 9), np.abs(x - 20)), 3.0)) == 1
    assert fitting.contour_lines(np.zeros((4, 4)), 1.0) == []
