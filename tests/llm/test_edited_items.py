"""Decontamination of slightly edited items against a brute force of its own."""

import re

import numpy as np
import pytest

from epochal.llm import decontaminate
from tests.llm.test_pipeline import brute_overlaps, words_of


def test_stretch_has_the_most_equal_words():
    rng = np.random.default_rng(2)
    for _ in range(500):
        e = rng.random(rng.integers(0, 30)) < rng.choice([0.5, 0.7, 0.85])
        spans = [e[i:j] for i in range(len(e)) for j in range(i + 1, len(e) + 1)]
        assert decontaminate.best_stretch(e) == max((int(s.sum()) for s in spans if 5 * s.sum() > 4 * len(s)), default=0)


@pytest.mark.parametrize("size,at", [(13, (8,)), (15, (5, 10)), (20, (4, 9, 14)), (12, (6,))])
def test_edited_short_items_are_found(spark, size, at):
    item = [f"w{i}x" for i in range(size)]
    hurt = ["zz" if i in at else x for i, x in enumerate(item)]
    docs = spark.createDataFrame([(1, "before " * 20 + " ".join(hurt) + " after" * 20), (2, "other words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["overlap"]) for r in decontaminate.op5_decontaminate(docs, items).collect()] == [(1, size - len(at))]


def corpus(seed):
    """Items of every length, and texts that hold parts of them with words changed, cut off and put together."""
    rng = np.random.default_rng(seed)
    items = [(None if n == 24 else n % 20, " ".join(f"i{x}" for x in rng.integers(0, 300, n))) for n in range(0, 31)]
    items += [(7, "the same words stand in two items of the same id here now and then"), (50, items[20][1]), (51, None)]
    texts = []
    for d in range(240):
        parts = [" ".join(f"p{x}" for x in rng.integers(0, 99, int(rng.choice([0, 0, 1, 4, 20]))))]
        for _ in range(int(rng.integers(1, 3))):
            w = (items[int(rng.integers(0, len(items)))][1] or "").split()
            cut = slice(int(rng.integers(0, 3)), len(w) - int(rng.integers(0, 3))) if rng.random() < 0.3 else slice(None)
            p = rng.choice([0, 0.06, 0.12, 0.2])
            parts += [x if rng.random() >= p else f"z{rng.integers(99)}" for x in w[cut]]
        texts.append((None if d == 5 else d // 2, " ".join(parts).replace(" i1 ", " I1,\n")))
    return items, texts + [(900, None), (901, ""), (902, "I1"), (903, "x " * 3000)]


@pytest.mark.parametrize("seed,most_seeds", [(1, 1 << 20), (2, 0), (1, 0)])
def test_overlaps_are_those_of_brute_force(spark, seed, most_seeds):
    items, texts = corpus(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["overlap"]) for r in decontaminate.contamination(docs, bench, most_seeds).groupBy("doc_id", "item_id").agg({"overlap": "max"}).withColumnRenamed("max(overlap)", "overlap").collect()}
    want = {}
    for d, t in texts:
        for i, x in items:
            if (n := brute_overlaps(t, words_of(x))) is not None:
                want[d, i] = max(n, want.get((d, i), 0))
    assert got == {(*k, n) for k, n in want.items()} and len(got) > 100
    best = {}
    for (d, i), n in want.items():
        best.setdefault(d, []).append((n, i))
    rows = {r["doc_id"]: (r["n_items"], r["overlap"]) for r in decontaminate.op5_decontaminate(docs, bench, most_seeds).collect()}
    assert rows == {d: (len({i for _, i in v if i is not None}), max(n for n, _ in v)) for d, v in best.items()}


def test_long_texts_and_words(spark):
    item = " ".join(f"word{i}" for i in range(30))
    long = "w" * 3_000_000
    rows = [(1, "x y " * 700_000 + item + " " + long), (2, long + " " + item), (3, "x y " * 900_000), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
    assert len(words_of(rows[0][1])) == len(re.findall(r"\S+", rows[0][1]))
