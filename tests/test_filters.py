"""Filters from summed products and from count models, against numpy on all rows at once and planted filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal import queries
from epochal.functions import fitting
from epochal.functions.fitting import OUTPUTS, deviance, penalised_path
from epochal.operators import filters, receptive


def test_products_over_batches_and_flushes(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i % 3}" if i % 11 else None, i, rng.normal(size=5).tolist(), float(rng.normal()), float(rng.random())) for i in range(400)]
    df = spark.createDataFrame([*rows, ("k0", -1, None, 1.0, 1.0), ("k0", -2, [None] * 5, 1.0, 1.0), ("k1", -3, [1.0] * 5, None, 1.0)], "k string, id long, x array<double>, y double, w double").repartition(6)
    for held in (filters.HELD, 1):  # the latter hands on after every batch
        for weight in (None, "w"):
            got = {}
            for r in filters.products(df, "k", "x", "y", weight, held).collect():
                got.setdefault(r["k"], {})[r["r"]] = r["s"]
            for k in {r[0] for r in rows}:
                a = np.array([[*r[2], r[3], 1.0] for r in rows if r[0] == k])
                w = np.array([r[4] if weight else 1.0 for r in rows if r[0] == k])
                assert np.allclose([got[k][i] for i in range(7)], (a * w[:, None]).T @ a)


def test_600_columns(spark):
    rng = np.random.default_rng(1)
    x, true = rng.choice([-1.0, 1.0], (900, 600)), np.zeros(600)
    true[[3, 77, 401]] = (1.0, -2.0, 0.5)
    y = x @ true + 0.01 * rng.normal(size=900)
    df = spark.createDataFrame([(1, v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "k int, x array<double>, y double").repartition(5)
    out = filters.solved(filters.products(df, "k", "x", "y"), "k").first()
    assert np.allclose(out["w"], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8) and out["r2"] > 0.99
    # Fewer rows than columns: the least norm.
    few = filters.least_squares(df.limit(100), "k", "y").first()["w"]
    head = df.limit(100).collect()
    assert np.allclose(few, np.linalg.lstsq(np.array([r["x"] for r in head]), np.array([r["y"] for r in head]), rcond=None)[0], atol=1e-6)


def test_query_of_many_lags(spark, sf):
    x = queries.samples(spark, sf).orderBy("user_id", "i").collect()
    users, a, y = sorted({r["user_id"] for r in x}), [], []
    for u in users:
        mine = [r for r in x if r["user_id"] == u]
        b = [1.0 if r["event_type"] == "click" else -1.0 for r in mine]
        a += [[b[i - k] if i >= k else 0.0 for k in range(40)] for i in range(len(b))]
        y += [r["v"] for r in mine]
    want = np.linalg.lstsq(np.array(a), np.array(y), rcond=None)[0]
    got = sorted(queries.queries()["filter_many_lags"](spark, sf).collect())
    assert np.allclose([r["w"] for r in got], want, atol=1e-3)


@pytest.mark.parametrize("output", ["softplus", "exponential"])
def test_path_ends_at_the_minimum(output):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    w, b = np.array([0.8, 0.0, -0.6, 0.0]), 0.4
    y = rng.poisson(OUTPUTS[output][0](x @ w + b)).astype(float)
    path = penalised_path(x, y, [0.3, 0.05, 1e-6], "poisson", output)
    for beta, (v, c) in path.items():
        cost = lambda v, c, beta=beta: deviance(y, OUTPUTS[output][0](x @ v + c), "poisson") + beta * np.abs(v).sum()
        best = cost(v, c)
        for _ in range(300):  # no small step away is better
            assert cost(v + rng.normal(size=4) * rng.choice([1e-1, 1e-2, 1e-3]), c + rng.normal() * 1e-2) >= best - 1e-9
    assert np.allclose(path[1e-6][0], w, atol=0.15) and np.count_nonzero(np.abs(path[0.3][0]) > 1e-9) <= 2
    # A squared loss without an output is the lasso, whose least penalty is least squares.
    v, c = penalised_path(x, x @ w + b, [1e-9], "gaussian", "none")[1e-9]
    assert np.allclose(v, w, atol=1e-6) and c == pytest.approx(b, abs=1e-6)


def test_planted_filter_from_counts(spark):
    rng = np.random.default_rng(3)
    true = np.array([0.1, 0.7, 1.2, 0.6, -0.2, -0.5, -0.2, 0.0])
    s = rng.normal(size=4000)
    z = np.array([sum(true[k] * s[i - k] for k in range(8) if i >= k) for i in range(len(s))])
    y = rng.poisson(np.logaddexp(0, z + 0.3))
    df = spark.createDataFrame([("a", i, float(a), float(c)) for i, (a, c) in enumerate(zip(s, y, strict=True))] + [("b", i, 0.0, 1.0) for i in range(3)], "k string, i long, s double, y double").repartition(4)
    out = receptive.response_model(df, "k", "s", "y", 8, [6, 8], [1e-4, 1e-2]).collect()
    assert [r["k"] for r in out] == ["a"]  # too short a key has no filter
    assert np.corrcoef(out[0]["filter"], true)[0, 1] > 0.97 and out[0]["test_loss"] < out[0]["null_loss"] - 0.05
    with pytest.raises(ValueError, match="loss"):
        receptive.response_model(df, "k", "s", "y", 8, [6], [0.1], "poisson", "none")


def test_models_of_many_keys_are_fitted_together(monkeypatch):
    """A stack of problems ends each where it would end alone and at the least cost, in about the steps of its slowest one."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 60, 4))
    x[0], x[1, :, 2] = 0.0, x[1, :, 1]
    y = rng.poisson(np.logaddexp(0, x @ np.array([0.8, 0, -0.5, 0.1]))).astype(float)
    y[2], y[3, 0] = 0.0, np.nan
    steps, step = [], fitting.newton_steps
    monkeypatch.setattr(fitting, "newton_steps", lambda *a: steps.append(len(a[0])) or step(*a))
    got = fitting.penalised_paths(x, y, [0.2, 0.01])
    assert len(steps) <= 2 * 50
    for k in range(40):
        for beta, (w, b) in penalised_path(x[k], y[k], [0.2, 0.01]).items():
            assert np.array_equal(got[beta][0][k], w) and np.array_equal(got[beta][1][k], b, equal_nan=True)
            cost = lambda v, c, k=k, beta=beta: deviance(y[k], OUTPUTS["softplus"][0](x[k] @ v + c), "poisson") + beta * np.abs(v).sum()
            assert k in (2, 3) or all(cost(w, b) <= cost(w + d[:4], b + d[4]) + 1e-9 for d in 1e-3 * rng.normal(size=(20, 5)))


def test_response_model_of_keys_of_many_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{k}", i, float(rng.integers(2)), float(rng.poisson(2))) for k, n in enumerate([40, 55, 40, 3, 40]) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "k string, i int, s double, y double")
    args = ("k", "s", "y", 5, [3, 4], [0.001, 0.01])
    got = {r["k"]: r for r in receptive.response_model(df, *args).collect()}
    assert sorted(got) == ["k0", "k1", "k2", "k4"]
    for k in ("k0", "k1"):
        assert receptive.response_model(df.where(F.col("k") == k), *args).first() == got[k]
