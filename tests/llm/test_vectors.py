"""Clustering and codes of vectors, against plain comparisons of everything with everything."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm.centroids import Annuli, op11_centroids
from epochal.llm.codebooks import Tree, op13_codes
from epochal.llm.vectors import grouped, means, totals

SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v):
    return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Ties, repeated rows and ids, nulls everywhere, wrong lengths, components that are no numbers, clashing names."""
    rng = np.random.default_rng(3)
    coarse = [[float(x) / 64 for x in rng.integers(-2, 3, 64)] for _ in range(60)]
    rows = [(i, v, i % 3) for i, v in enumerate(coarse)]
    rows += [(7, coarse[7], 1), (7, coarse[8], 1), (None, coarse[9], None), (None, coarse[10], 2), (61, [0.0] * 64, None), (62, [0.0] * 64, None), (-5, [0.5] * 64, 0)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63]
    rows += [(100 + i, v, 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, df.withColumns({c: F.lit("clash") for c in ("id", "x", "s", "cluster", "distance", "code", "error", "_label", "label_error")}).repartition(5)


def gaps(x, c):
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)


def brute_centroids(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows if fine(v)]
    x = np.array([v for _, v in kept])
    draw = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = x[draw[:k]]
    for _ in range(rounds):
        a = gaps(x, c).argmin(1)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = gaps(x, c)
    a, d = d.argmin(1), d.min(1)
    sums = {j: int(d[a == j].sum()) for j in set(a.tolist())}
    sha = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted(((i, int(j), int(e), sums[j], sum(sums.values()), sha[j]) for (i, _), j, e in zip(kept, a.tolist(), d.tolist(), strict=True)), key=repr)


def test_centroids_against_all_distances(odd_vectors):
    rows, df = odd_vectors
    out = op11_centroids(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_centroids(rows)


def test_more_centroids_than_vectors(spark, odd_vectors):
    rows, df = odd_vectors
    few = df.where("vec_id in (1, 2, 3)")
    assert sorted(map(tuple, op11_centroids(few).collect()), key=repr) == brute_centroids([r for r in rows if r[0] in (1, 2, 3)])
    assert op11_centroids(df.limit(0)).collect() == [] and op13_codes(df.limit(0)).collect() == []
    assert op11_centroids(df.where("vec_id >= 100")).count() == 0


def test_annulus_keeps_ties_at_its_edge():
    # From the origin's side: centroids on both sides at equal distance, the smaller number must win.
    c = np.array([[4, 0], [0, 0], [2, 2], [2, -2], [-4, 0]])
    x = np.array([[2, 0], [0, 0], [-2, 0], [4, 4], [0, 3]])
    number, d = Annuli(c).nearest(x)
    assert (number == gaps(x, c).argmin(1)).all() and (d == gaps(x, c).min(1)).all()
    rng = np.random.default_rng(0)
    for _ in range(200):
        c, x = rng.integers(-3, 4, (9, 3)), rng.integers(-4, 5, (50, 3))
        number, d = Annuli(c).nearest(x)
        assert (number == gaps(x, c).argmin(1)).all() and (d == gaps(x, c).min(1)).all()
    c, x = rng.integers(-(1 << 26), 1 << 26, (30, 5)), rng.integers(-(1 << 26), 1 << 26, (300, 5))
    assert (Annuli(c).nearest(x)[0] == gaps(x, c).argmin(1)).all()


def test_tree_finds_the_lowest_of_nearest_entries():
    rng = np.random.default_rng(1)
    for spread in (2, 5, 1000):
        for n in (1, 2, 5, 64, 256):
            e, x = rng.integers(-spread, spread + 1, (n, 4)), rng.integers(-spread, spread + 1, (400, 4))
            index, d = Tree(e).nearest(x)
            assert (index == gaps(x, e).argmin(1)).all() and (d == gaps(x, e).min(1)).all()
    same = np.zeros((64, 4), int)
    assert (Tree(same).nearest(np.ones((3, 4), int))[0] == 0).all()


def brute_codes(rows):
    kept = sorted(((i is None, i or 0, tuple(math.floor(256 * float(np.float32(x))) for x in v), i, lab) for i, v, lab in rows if fine(v)), key=lambda r: r[:3])
    x = np.array([r[2] for r in kept]).reshape(len(kept), 16, 4)
    books = [x[:64, p].copy() for p in range(16)]
    for _ in range(2):
        for p, b in enumerate(books):
            a = gaps(x[:, p], b).argmin(1)
            books[p] = np.array([x[a == j, p].sum(0) // (a == j).sum() if (a == j).any() else b[j] for j in range(len(b))])
    d = np.stack([gaps(x[:, p], b) for p, b in enumerate(books)], 1)
    a, d = d.argmin(2), d.min(2).sum(1)
    sums = defaultdict(int)
    for r, e in zip(kept, d.tolist(), strict=True):
        sums[r[4]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()
    return sorted(((r[3], "".join(f"{j:02x}" for j in row), e, sums[r[4]], sha) for r, row, e in zip(kept, a.tolist(), d.tolist(), strict=True)), key=repr)


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_codes_against_all_entries(odd_vectors, few):
    rows, df = odd_vectors
    out = op13_codes(df, few=few)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_codes(rows)


def test_components_that_fit_no_long_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)
    with pytest.raises(Exception, match="or more in size"):
        op11_centroids(df).collect()


def test_sums_do_not_depend_on_partitions(spark):
    parts = spark.createDataFrame([([i, -i, 1 << 40],) for i in range(100)], "s array<long>")
    for n in (1, 7):
        assert totals(parts.repartition(n), 3).tolist() == [4950, -4950, 100 << 40]
    assert totals(parts.limit(0), 3).tolist() == [0, 0, 0]
    s = grouped(np.array([[1, -3], [2, -4], [5, 5]]), np.array([2, 2, 0]), 4)
    assert s.tolist() == [[1, 5, 5], [0, 0, 0], [2, 3, -7], [0, 0, 0]]
    assert means(s, np.full((4, 2), 9)).tolist() == [[5, 5], [9, 9], [1, -4], [9, 9]]
