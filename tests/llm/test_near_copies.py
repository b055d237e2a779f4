"""Near copies of the pipeline against brute-force Jaccard similarities of all pairs."""

import numpy as np
import pytest

from epochal.llm import simhash


def edited(rng, words, n, tag):
    """``words`` with ``n`` of them changed, at least five apart."""
    out = list(words)
    for i, at in enumerate(np.sort(rng.choice(len(words) // 5, n, replace=False)) * 5):
        out[at] = f"{tag}x{i}"
    return out


def brute_first(rows):
    """The least doc_id of each group of texts at 0.8 or more (or 3 bits or fewer)."""
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    prints = {i: simhash.fingerprint(t.encode(), 5) & (1 << 64) - 1 for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


@pytest.mark.parametrize("parts,whole", [(1, simhash.WHOLE), (6, simhash.WHOLE), (6, 3000)])
def test_near_copies_are_those_of_brute_force(spark, parts, whole):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):  # pairs at about 0.82, 0.77, 0.74 and 0.70
        w = [f"w{x}" for x in rng.integers(0, 9000, 200)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(edited(rng, w, 4 + i % 4, f"e{i}")))]
    w = [f"v{x}" for x in rng.integers(0, 9000, 200)]
    rows += [(5000 + i, " ".join(edited(rng, w, 1 + i % 6, f"g{i}"))) for i in range(60)]  # near a text that is not there
    rows += [(7000, rows[0][1]), (7001, " ".join(w) + " " + " ".join(w)), (7002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    prints = simhash.with_bands(docs, 5)
    first = simhash.components(prints.select("doc_id", "_fp"), 4096, simhash.near_links(docs, prints, 5, whole))
    assert {r["first"] for r in first.select("first").collect()} == brute_first(rows)


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(6)
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = (np.frombuffer(simhash.band_keys(x), np.uint64) for x in (h[:90], h[10:]))  # 80 of 100 equal
        assert (a == b).any()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_chain_of_copies_is_one_group_however_rows_are_dealt(spark, parts):
    """Each text is a copy of the next only: the group is one, and the smallest doc_id stays."""
    w = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(w)))
        for at in range(5 * i, 5 * i + 300, 60):
            w[at] = f"c{i}x{at}"
    far = set(simhash.shingle_hashes(rows[0][1].encode(), 5)) & set(simhash.shingle_hashes(rows[-1][1].encode(), 5))
    assert len(far) < 0.5 * 396
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert [r["doc_id"] for r in simhash.dedup_stage(df).collect()] == [89]


@pytest.mark.parametrize("parts", [1, 5])
def test_components_against_union_find(spark, parts):
    from epochal.llm.common import connected_components

    rng = np.random.default_rng(parts)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (1800, 2))] + [(5000 + i, 5001 + i) for i in range(200)] + [(9000, 9001 + i) for i in range(500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(parts)).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
