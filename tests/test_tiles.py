"""Components by tiles against flood fill of whole images."""

import numpy as np
import pytest

from epochal.operators import masks, tiles


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(x), int(y), int(v)) for k in (1, 2) for (x, y), v in np.ndenumerate(rng.choice([0, 1, 1, 2], (13, 11)))]
    rows += [(3, x, 7, 1) for x in range(-9, 20)]  # one thread through many tiles, into negative coordinates
    spiral = np.zeros((12, 12), int)
    spiral[0], spiral[:, 11], spiral[11, 1:], spiral[2:, 1], spiral[2, 1:10], spiral[2:10, 9], spiral[9, 3:10] = 1, 1, 1, 1, 1, 1, 1
    rows += [(4, int(x), int(y), int(v)) for (x, y), v in np.ndenumerate(spiral)]
    return spark.createDataFrame(rows, "k long, x int, y int, label int").repartition(3)


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [2, 5])
def test_tiles(images, diagonal, tile):
    want = {(r["k"], r["x"], r["y"]): r["component"] for r in masks.connected(images, "k", "label", diagonal).collect()}
    got = {(r["k"], r["x"], r["y"]): r["component"] for r in tiles.connected(images, "k", "label", diagonal, tile).collect()}
    assert got == want


def test_odd_images(spark, images):
    assert tiles.connected(images.where("label = 0"), "k", "label", tile=4).select("component").distinct().collect()[0][0] == 0
    assert tiles.connected(images.limit(0), "k", "label").collect() == []
    twice = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 1), ("a", 0, 1, None), ("a", 0, 2, 1)], "k string, x int, y int, label int")
    assert sorted((r["y"], r["component"]) for r in tiles.connected(twice, "k", "label").collect()) == [(0, 1), (1, 0), (2, 2)]


def test_largest_parts(images):
    c = {(r["k"], r["x"], r["y"]): r["component"] for r in masks.connected(images, "k", "label").collect()}
    label = {(r["k"], r["x"], r["y"]): r["label"] for r in images.collect()}
    size = {}
    for p, n in c.items():
        if n:
            size.setdefault((p[0], label[p]), {}).setdefault(n, []).append(p)
    best = {g: min(parts, key=lambda n, parts=parts: (-len(parts[n]), n)) for g, parts in size.items()}
    for r in tiles.largest_parts(images, "k", "label", tile=3).collect():
        p = (r["k"], r["x"], r["y"])
        assert r["label"] == (label[p] if c[p] and best[p[0], label[p]] == c[p] else 0)
