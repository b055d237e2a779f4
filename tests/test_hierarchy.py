"""Bottom-up clustering by rounds on the executors against merging the closest pair, one after another, in numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest

from epochal.functions.fitting import agglomerate
from epochal.functions.shared import numbered
from epochal.operators import hierarchy
from epochal.operators.graphs import followed, linked


def data(spark, n, dim=5, seed=0, repeat=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.integers(0, 3, (n, 1)) * 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, x[i].tolist()) for i in range(repeat)]
    return rows, spark.createDataFrame([*rows, (-1, None)], "id long, v array<double>").repartition(4)


def wanted(rows, linkage, **cut):
    vectors = sorted({tuple(v) for _, v in rows})
    weight = {v: 0.0 for v in vectors}
    for _, v in rows:
        weight[tuple(v)] += 1
    label = dict(zip(vectors, agglomerate(np.array(vectors), np.array([weight[v] for v in vectors]), linkage, **cut).tolist(), strict=True))
    return {-1: None} | {i: label[tuple(v)] for i, v in rows}


@pytest.mark.parametrize(("linkage", "block", "finish", "cut"), [
    ("ward", 16, 10, {"k": 5}),
    ("ward", 512, 256, {"threshold": 6.0}),
    ("average", 16, 12, {"threshold": 0.5}),
    ("complete", 8, 4, {"k": 6}),
])
def test_small(spark, linkage, block, finish, cut):
    rows, df = data(spark, 24, repeat=7)
    got = {r["id"]: r["cluster"] for r in hierarchy.agglomerative(df, "v", linkage, block=block, finish=finish, **cut).collect()}
    assert got == wanted(rows, linkage, **cut)


@pytest.mark.parametrize(("n", "linkage"), [(500, "average"), (36, "complete"), (2000, "ward")])
def test_large(spark, n, linkage):
    rows, df = data(spark, n, 8, seed=n)
    got = {r["id"]: r["cluster"] for r in hierarchy.agglomerative(df, "v", linkage, k=12, block=40 if n < 300 else 1000, finish=256).collect()}
    assert got == wanted(rows, linkage, k=12)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "id long, v array<double>")
    assert {r["id"]: r["cluster"] for r in hierarchy.agglomerative(df, "v", k=3).collect()} == {1: 0, 2: 0, 3: None}
    assert hierarchy.agglomerative(df.limit(0), "v", "complete", k=2).collect() == []
    flat = spark.createDataFrame([(i, [float(i)] * 3) for i in range(5)], "id long, v array<double>")  # no correlation at all
    assert len({r["cluster"] for r in hierarchy.agglomerative(flat, "v", "average", threshold=0.5).collect()}) == 5
    with pytest.raises(ValueError, match="linkage"):
        hierarchy.agglomerative(df, "v", "single", k=2)
    # Ties: a grid, whose distances are all alike.
    grid = spark.createDataFrame([(10 * i + j, [float(i), float(j)]) for i in range(3) for j in range(3)], "id long, v array<double>")
    got = [r["cluster"] for r in hierarchy.agglomerative(grid, "v", k=4, finish=5).collect()]
    assert sorted(set(got)) == [0, 1, 2, 3]


def test_links_and_numbers(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, int(x)) for x in rng.integers(6, 60, 50)] + [(200, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r["node"]: r["root"] for r in linked(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if x != 200}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 50)], "node long, parent long")
    assert {(r["node"], r["root"]) for r in followed(chain).collect()} == {(i, 0) for i in range(1, 50)}
    many = spark.range(500).repartition(7).withColumnRenamed("id", "v")
    assert all(r["v"] == r["n"] for r in numbered(many, ["v"], "n").collect())


@pytest.mark.parametrize("linkage", ["ward", "average"])
def test_few_distances_are_taken_in_full(monkeypatch, linkage):
    """The search of two blocks finds what all distances say, and takes few of them in full."""
    rng = np.random.default_rng(3)
    taken, gaps = [], hierarchy.gaps
    monkeypatch.setattr(hierarchy, "gaps", lambda *a: taken.append(len(gaps(*a))) or gaps(*a))
    kinds = {"spread": rng.normal(size=(900, 16)), "grid": rng.integers(0, 3, (300, 2)) + 0.0, "far": 1e7 + rng.normal(size=(300, 3)), "huge": 1e30 * rng.normal(size=(300, 4)), "one": np.ones((1, 3)), "alike": np.ones((40, 3))}
    for name, x in kinds.items():
        if linkage == "average":
            x = x - x.mean(1, keepdims=True)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        w = rng.choice([1.0, 2.0, 5000.0], len(x))
        table = pa.table({"c": rng.permutation(len(x)), "w": w, "whole": [True] * len(x), "x": x.tolist()})
        asking = table.take(rng.permutation(len(x))[: max(1, len(x) // 2)])
        taken.clear()
        got = hierarchy._near(linkage)((0, 0), asking, table).to_pylist()
        full = sum(taken)
        want = hierarchy._met(linkage)((0, 0), asking, table).to_pylist()
        key = lambda r: r["c"]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert name != "spread" or full < 0.05 * len(asking) * len(x)


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Rows of shuffle: every vector goes to as many tasks as there are blocks to meet, so blocks must not stay small."""
    sizes, nearest = [], hierarchy.nearest
    monkeypatch.setattr(hierarchy, "nearest", lambda *a: sizes.append((a[2] * a[3], a[5])) or nearest(*a))
    _, df = data(spark, 400, 3, seed=8)
    hierarchy.agglomerative(df, "v", k=3, block=4, finish=200)
    assert all(math.ceil(math.sqrt(mn) / block) ** 2 <= 4 * hierarchy._DEALT * spark.sparkContext.defaultParallelism for mn, block in sizes)


@pytest.mark.parametrize("linkage", ["ward", "average"])
def test_pairs_up_to_a_bound(linkage):
    """Two blocks give every pair up to the bound of either side, ties by number, and a block with itself each pair once a side."""
    rng = np.random.default_rng(5)
    kinds = {"spread": rng.normal(size=(700, 16)), "grid": rng.integers(0, 3, (90, 2)) + 0.0, "far": 1e7 + rng.normal(size=(200, 3)), "huge": 1e30 * rng.normal(size=(200, 4)), "one": np.ones((1, 3)), "alike": np.ones((40, 3))}
    for x in kinds.values():
        if linkage == "average":
            x = x - x.mean(1, keepdims=True)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        n = len(x)
        w, c = rng.choice([1.0, 2.0, 5000.0], n), rng.permutation(n)
        d = np.array([hierarchy.gaps(x[i], w[i], x, w, linkage) for i in range(n)])
        rank = [sorted((float(d[i, j]), int(c[j])) for j in range(n) if j != i) for i in range(n)]
        r, m = zip(*(q[min(int(rng.integers(6)), n - 2)] if q else (math.inf, 2**63 - 1) for q in rank), strict=True)
        r, m = (math.inf, *r[1:]), (2**63 - 1, *m[1:])
        table = pa.table({"c": c, "w": w, "x": x.tolist(), "r": r, "m": m})
        for left, right, key in ((np.arange(n // 2), np.arange(n // 2, n), (0, 1)), (np.arange(n), np.arange(n), (0, 0))):
            got = hierarchy._within(linkage)(tuple(map(pa.scalar, key)), table.take(left), table.take(right)).to_pylist()
            pairs = [(i, j) for i in left.tolist() for j in right.tolist() if i != j]
            pairs += [(j, i) for i, j in pairs] if key[0] != key[1] else []
            want = [(int(c[i]), int(c[j]), float(d[i, j])) for i, j in pairs if (d[i, j], c[j]) <= (r[i], m[i])]
            assert sorted((p["c"], p["o"], p["d"]) for p in got) == sorted(want)


@pytest.mark.parametrize("linkage", ["ward", "average"])
def test_last_means_by_rounds(linkage):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    table = pa.table({"c": rng.permutation(300), "w": rng.choice([1.0, 3.0], 300), "x": x.tolist()})
    key = lambda t: sorted((r["a"], r["b"], round(r["d"], 9)) for r in t.to_pylist())
    one, rounds = hierarchy._last(linkage, few=300)(table), hierarchy._last(linkage, few=1)(table)
    assert one.num_rows == 299 and key(one) == key(rounds) == key(hierarchy._last(linkage, few=40)(table))
    limit = float(np.median(one["d"].to_numpy()))
    assert key(hierarchy._last(linkage, limit, 1)(table)) == [r for r in key(one) if r[2] <= limit]
    assert hierarchy._last(linkage)(table.slice(0, 1)).num_rows == 0


def test_clusters_are_met_once(spark, monkeypatch):
    """Pairs of vectors that are looked at: each pair once, and a merged cluster once with each other one, little more."""
    looked, nearest, within = [], hierarchy.nearest, getattr(hierarchy, "within", None)
    monkeypatch.setattr(hierarchy, "nearest", lambda *a: looked.append(a[2] * a[3]) or nearest(*a))
    monkeypatch.setattr(hierarchy, "within", lambda *a: looked.append(a[2] * (a[2] / 2 + a[3])) or within(*a), raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(900, 24)).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in hierarchy.agglomerative(df, "v", k=7, block=256, finish=550).collect()}
    assert sum(looked) < 1.3 * 900**2
    assert got == {k: v for k, v in wanted(rows, "ward", k=7).items() if k >= 0}
