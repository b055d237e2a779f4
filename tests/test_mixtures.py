"""Mixtures fitted by scans of all rows against expectation maximisation in plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import learning, mixtures


def density(x, weights, means, covs):
    out = 0
    for w, m, c in zip(weights, means, covs, strict=True):
        d = x - m
        out = out + w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / math.sqrt((2 * math.pi) ** len(m) * np.linalg.det(c))
    return out


def plain(x, kind, start, rounds):
    """Expectation maximisation, written out: one component, one row of formulas at a time."""
    w, m, c = start.weights.copy(), start.means.copy(), [v.copy() for v in start.covs]
    logs = []
    for _ in range(rounds):
        parts = np.stack([density(x, [a], [b], [v]) for a, b, v in zip(w, m, c, strict=True)], 1)
        logs.append(np.log(parts.sum(1)).sum())
        r = parts / parts.sum(1, keepdims=True)
        n = r.sum(0)
        w, m = n / n.sum(), (r.T @ x) / n[:, None]
        c = [sum(ri * np.outer(d, d) for ri, d in zip(r[:, j], x - m[j], strict=True)) / n[j] for j in range(len(n))]
        if kind == "tied":
            c = [sum(a * v for a, v in zip(w, c, strict=True))] * len(n)
        elif kind == "diag":
            c = [np.diag(np.diag(v)) for v in c]
        elif kind == "spherical":
            c = [np.eye(len(v)) * np.trace(v) / len(v) for v in c]
        c = [v + mixtures.FLOOR * np.eye(len(v)) for v in c]
    return w, m, c, logs


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    tilt = np.array([[1.0, 0.9], [0.9, 1.0]])
    x = np.concatenate([rng.multivariate_normal([0, 0], tilt, 150), rng.multivariate_normal([5, -3], [[1, -0.9], [-0.9, 1]], 150)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, (-1, None)], "id long, v array<double>").repartition(5)


def test_steps_are_those_of_plain_formulas(clouds):
    x, df = clouds
    rows = df.where("v is not null").select(F.col("v").alias("x"), F.lit(0).alias("fold"))
    starts = [(mixtures.seeded(x[::7], k, kind, 1), -1) for kind in mixtures.KINDS for k in (1, 3)]
    got = mixtures.fitted(rows, starts, rounds=4, least=-np.inf)
    for m, (s, _) in zip(got, starts, strict=True):
        w, means, covs, logs = plain(x, s.kind, s, 4)
        assert np.allclose(m.weights, w) and np.allclose(m.means, means) and np.allclose(m.covs, covs, atol=1e-9)
        assert math.isclose(m.loglik, logs[-1], rel_tol=1e-9)
        assert all(b >= a - 1e-6 for a, b in zip(logs, logs[1:], strict=False))  # it never gets worse
        assert m.params == mixtures.parameters(s.kind, len(w), 2)


def test_choice_by_folds(clouds):
    x, df = clouds
    scores, model = mixtures.choose(df, "v", range(1, 4), cv=4)
    assert (model.kind, len(model.weights)) == ("full", 2) and len(scores) == 12
    # A fold's criterion, from the plain density of a model fitted on the others.
    folds = {tuple(r["v"]): r["f"] for r in df.where("v is not null").select("v", F.pmod(F.xxhash64("v", F.lit(0)), F.lit(4)).alias("f")).collect()}
    fold = np.array([folds[tuple(v)] for v in x.tolist()])
    first = np.array([r["v"] for r in df.where("v is not null").orderBy(F.xxhash64("v"), "v").limit(2000).collect()])
    total = 0
    for f in range(4):
        w, m, c, _ = plain(x[fold != f], "full", mixtures.seeded(first, 2, "full", 0), 40)
        out = x[fold == f]
        total += mixtures.parameters("full", 2, 2) * math.log(len(out)) - 2 * np.log(density(out, w, m, c)).sum()
    assert math.isclose(dict(((a, b), v) for a, b, v in scores)["full", 2], total / 4, rel_tol=1e-3)
    out = {r["id"]: r for r in mixtures.described(df, "v", model).collect()}
    assert out[-1]["cluster"] is None and out[-1]["log_density"] is None
    want = np.log(density(x, model.weights, model.means, model.covs))
    assert all(math.isclose(out[i]["log_density"], v, rel_tol=1e-9) for i, v in enumerate(want))
    assert len({out[i]["cluster"] for i in range(150)} & {out[i]["cluster"] for i in range(150, 300)}) <= 2


def test_all_kinds_are_judged_on_all_rows(clouds):
    _, df = clouds
    value, k, model = learning.mixture(df, "v", range(1, 4), kinds=("full", "diag"))
    assert (k, model.kind) == (2, "full")
    by_few, _ = mixtures.choose(df, "v", range(2, 3), ("full",), cv=1, start=30)
    assert math.isclose(by_few[0][2], value, rel_tol=1e-3)  # where the search begins decides nothing
    for metric in ("aic", "likelihood"):
        assert learning.mixture(df, "v", range(1, 3), kinds=("full",), metric=metric)[1] == 2
    with pytest.raises(ValueError, match="kinds"):
        mixtures.choose(df, "v", range(1, 3), ("round",))
    assert mixtures.choose(df.limit(0), "v", range(1, 3)) == ([], None)
