"""Operators over keys cut in buckets against the same operators uncut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions.kernels import lowpass
from epochal.operators import buckets, epochs, series


@pytest.fixture(scope="module")
def traces(spark):
    """One long key, one short, one of a single sample; ties in time, gaps of whole buckets."""
    rng = np.random.default_rng(4)
    at = np.cumsum(rng.choice([0, 1, 1, 2, 90], 700, p=[0.1, 0.4, 0.3, 0.19, 0.01]))
    rows = [("long", int(a), i, float(v), bool(f)) for i, (a, v, f) in enumerate(zip(at, rng.normal(size=700), rng.random(700) < 0.08, strict=True))]
    rows += [("short", i, 1000 + i, float(i), i in (1, 4)) for i in range(9)] + [("one", 5, 2000, 1.0, True)]
    return spark.createDataFrame(rows, "k string, time long, id long, x double, trigger boolean").repartition(3)


def cut(width):
    return lambda c: F.floor(c / width)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_fifty_buckets_of_a_key(traces):
    width = max(1, traces.agg(F.max("time")).first()[0] // 50)
    plain = series.indexed(traces, "k", ["time", "id"], "x")
    same(buckets.indexed(traces, "k", ["time", "id"], "x", cut(width)(F.col("time"))), plain)
    for every in (1, 3):
        want = epochs.epoch_starts(plain, "k", F.col("trigger"), every)
        got = buckets.epoch_starts(plain, "k", F.col("trigger"), 14, every)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof(traces, how, tolerance):
    data = traces.where("trigger").dropDuplicates(["k", "time"])
    targets = traces.where("not trigger").select("k", "id", "time")
    want = epochs.asof(targets, data, "k", "time", "x", how, tolerance)
    for width in (1, 20, 10_000):
        same(buckets.asof(targets, data, "k", "time", "x", cut(width), how, tolerance), want)


def test_lowpass_carries_its_state(spark, traces):
    plain = series.indexed(traces, "k", ["time", "id"], "x").select("k", "i", "n", "v")
    rows = plain.orderBy("k", "i").collect()
    for size in (14, 1000):
        got = {(r["k"], r["i"]): r["v"] for r in buckets.lowpass(plain, "k", 10.0, 1.5, size).collect()}
        for k in ("long", "short"):
            x = np.array([r["v"] for r in rows if r["k"] == k])
            want = lowpass(x, 10.0, 1.5)
            assert np.allclose([got[k, i + 1] for i in range(len(x))], want, atol=1e-9)
        assert got["one", 1] == pytest.approx(1.0)


def test_running_sum(traces):
    got = {r["id"]: r["total"] for r in buckets.running_sum(traces, "k", ["time", "id"], "x", cut(9)(F.col("time"))).collect()}
    total, last = 0.0, None
    for r in sorted(traces.collect(), key=lambda r: (r["k"], r["time"], r["id"])):
        total = r["x"] + (total if r["k"] == last else 0.0)
        last = r["k"]
        assert got[r["id"]] == pytest.approx(total)
