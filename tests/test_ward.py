"""Ward clustering at the query's size against merging the closest pair, one after another."""

import numpy as np

from epochal.functions.fitting import agglomerate


def brute(x, w, k):
    at, w, label = x.astype(float).copy(), w.astype(float).copy(), np.arange(len(x))
    alive = list(range(len(x)))
    while len(alive) > k:
        _, i, j = min((2 * w[i] * w[j] / (w[i] + w[j]) * ((at[i] - at[j]) ** 2).sum(), i, j) for n, i in enumerate(alive) for j in alive[n + 1 :])
        at[i] = (w[i] * at[i] + w[j] * at[j]) / (w[i] + w[j])
        w[i] += w[j]
        label[label == j] = i
        alive.remove(j)
    return np.unique(label, return_inverse=True)[1]


def test_ward_merges_the_closest_pair_each_time():
    rng = np.random.default_rng(1)
    for n in (2, 30, 70):
        x, w = rng.normal(size=(n, 4)), rng.integers(1, 5, n)
        for k in (1, 2, 5):
            assert np.array_equal(agglomerate(x, w, "ward", k), brute(x, w, min(k, n)))


def test_query_covers_the_given_tables(spark, sf):
    from epochal import queries

    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
    vectors = sorted({tuple(r["embedding"]) for r in x})
    count = {v: 0 for v in vectors}
    for r in x:
        count[tuple(r["embedding"])] += 1
    label = dict(zip(vectors, agglomerate(np.array(vectors, float), np.array([count[v] for v in vectors], float), "ward", 5), strict=True))
    got = {r["vec_id"]: r["cluster"] for r in queries.queries()["ward_clusters"](spark, sf).collect()}
    assert got == {r["vec_id"]: label[tuple(r["embedding"])] for r in x}
