"""Registered queries that SQL cannot say, held against numpy on the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest

from epochal import queries as q


def rows(spark, sf, name):
    return q.queries()[name](spark, sf).collect()


def test_principal_components(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in e], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = z @ vt[:3].T
    got = {r["vec_id"]: r["pc"] for r in rows(spark, sf, "pca_project")}
    got = np.array([got[r["vec_id"]] for r in e])
    for k in range(3):
        assert abs(np.corrcoef(got[:, k], want[:, k])[0, 1]) > 1 - 1e-6


def test_rank_one_components(spark, sf):
    cells = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_partkey", "l_quantity").collect():
        cells[r["l_suppkey"], r["l_linenumber"], r["l_partkey"] % 6].append(r["l_quantity"])
    by = defaultdict(dict)
    for (s, d, t), v in cells.items():
        by[s][t, d] = np.mean(v)
    for r in rows(spark, sf, "svd_tuning"):
        c = by[r["l_suppkey"]]
        ts, ds = (sorted({k[i] for k in c}) for i in (0, 1))
        m = np.array([[c.get((t, d), 0.0) for d in ds] for t in ts])
        values, vectors = np.linalg.eigh(m.T @ m)
        assert abs(np.dot(vectors[:, -1], r["directions"])) == pytest.approx(1, abs=1e-6)
        assert r["share"] == pytest.approx(values[-1] / values[-3:].sum(), rel=1e-6)


def test_lowpass_keeps_slow_and_loses_fast(spark, sf):
    """The registered low-pass against a direct solution of the filter's recursions, forward and backward."""
    from epochal.functions.kernels import butterworth, lowpass

    rng = np.random.default_rng(0)
    x = rng.normal(size=80)
    n, pad = len(x), 18
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for _ in range(2):
        for b0, b1, b2, a1, a2 in butterworth(6, 1.0, 10.0):
            m = len(y)
            a = np.eye(m) + a1 * np.eye(m, k=-1) + a2 * np.eye(m, k=-2)
            first, second = y[0], y[0]  # settled before the trace begins
            feed = b0 * y + b1 * np.concatenate(([y[0]], y[:-1])) + b2 * np.concatenate(([y[0], y[0]], y[:-2]))
            feed[0] -= a1 * first + a2 * second
            feed[1] -= a2 * first
            y = np.linalg.solve(a, feed)
        y = y[::-1]
    assert lowpass(x, 10.0, 1.0) == pytest.approx(y[pad : n + pad])
    assert rows(spark, sf, "lowpass_trace")


def test_permutation_share(spark, sf):
    """Each supplier's p-value is a share of fifty, and tuned responses come out tuned."""
    from epochal.operators import features

    p = [r["p_value"] for r in rows(spark, sf, "permutation_p_value")]
    assert p and all(abs(v * 50 - round(v * 50)) < 1e-9 and 0 <= v <= 1 for v in p)
    made = [(1, d, 1 + np.cos(2 * np.pi * d / 8)) for d in range(8)] + [(2, d, 1.0 + (d % 2)) for d in range(8)]
    got = {r["k"]: r["p_value"] for r in features.permutation_p(spark.createDataFrame([(k, d, float(v)) for k, d, v in made], "k int, d int, r double"), "k", "d", "r", 8, 50).collect()}
    assert got[1] == 0 and got[2] > 0.5


def test_direction_tuning_index(spark, sf):
    """The registered tuning's direction index from its own direction component, by complex sums."""
    for r in rows(spark, sf, "direction_tuning"):
        w, a = np.array(r["dir_component"]), np.deg2rad([0, 90, 180, 270])
        v = (w * np.exp(1j * a)).sum()
        step = np.pi / 2
        assert r["ds_index"] == pytest.approx(step / (2 * np.sin(step / 2)) * abs(v) / w.sum()) and r["pref_dir"] == pytest.approx(np.angle(v))
        assert 0 <= r["ds_pvalue"] <= 1 and -1 <= r["on_off"] <= 1
