"""The pipeline against brute force, stage by stage, and on odd tables."""

import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from epochal.llm import quality, sharding, simhash
from epochal.llm.common import shared_dir
from tests.llm.test_operators import brute_fingerprint, water


def brute_quality(rows, docs, labels):
    m = quality.fit(*quality.training_rows(docs, labels, "quality", 4000))
    s = m.scores([(r["text"] or "").encode() for r in rows])
    return [r for r, x in zip(rows, s, strict=True) if x >= 0.3]


def brute_dedup(rows):
    """One row of each group: all pairs of texts, by the Jaccard similarity of their shingle sets or three bits."""
    texts = sorted({r["text"] or "" for r in rows})
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    prints = [brute_fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    best = {}
    for r in rows:
        k = group[r["text"] or ""]
        if k not in best or r["doc_id"] < best[k]["doc_id"]:
            best[k] = r
    return list(best.values())


def stretch(equal):
    """The most equal words of any stretch of which over four fifths are equal."""
    best = 0
    for i in range(len(equal)):
        same = 0
        for j in range(i, len(equal)):
            same += equal[j]
            if 5 * same > 4 * (j - i + 1):
                best = max(best, same)
    return best


def brute_overlaps(text, item):
    """The largest overlap of a text and an item over all places, or None if no place contaminates."""
    w, n = words_of(text), len(item)
    if n < 5:
        return n if n and w == item else None
    need = n if n == 5 else min(12, -(-4 * n // 5))
    best = None
    for d in range(-n, len(w) + 1):
        lo, hi = max(d, 0), min(d + n, len(w))
        equal = [w[i] == item[i - d] for i in range(lo, hi)]
        got = sum(equal) if n < 10 else stretch(equal) if sum(equal) >= need else 0
        if hi - lo >= need and got >= need:
            best = max(got, best or 0)
    return best


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_clean(rows, items):
    whole = [words_of(r["text"]) for r in items]
    return [r for r in rows if all(brute_overlaps(r["text"], i) is None for i in whole)]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = brute_clean(brute_dedup(brute_quality(docs.collect(), docs, labels)), spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "shard"]
    got = got.collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert {r["doc_id"] for r in got} <= set(text) and all(r["text"] == text[r["doc_id"]] for r in got)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    want = water(per)
    copies = Counter(r["doc_id"] for r in got)
    for s in per:
        ratio = want[s] / per[s] if per[s] else 0
        mine = [r["doc_id"] for r in rows if r["source"] == s]
        assert all(copies[d] in (int(ratio - 1e-9), int(ratio + 1e-9), int(ratio) + 1) for d in mine)
        assert abs(sum(copies[d] * size[d] for d in mine) - want[s]) <= 2 * max(size[d] for d in mine)
    ids = spark.createDataFrame([(d,) for d in text], "doc_id long")
    shard = {r["doc_id"]: r["s"] for r in ids.select("doc_id", sharding.shard_of(ids["doc_id"], sharding.layout(24)).alias("s")).collect()}
    assert all(r["shard"] == shard[r["doc_id"]] for r in got)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_on_odd_tables(spark, sf, odd_docs, no_docs, which):
    """Each stage hands on every column with its value, whatever the columns are called."""
    docs = {"odd": odd_docs, "none": no_docs}[which]
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = Counter(map(repr, docs.select(*names).collect()))
        docs = stage(spark, docs, sf)
        assert docs.columns == names
        if i < 4:
            after = Counter(map(repr, docs.collect()))
            assert set(after) <= set(before)
    rest = [c for c in names if c != "shard"]
    assert set(map(repr, docs.select(*rest).collect())) <= {repr(r) for r in odd_docs.select(*rest).collect()}
    assert (docs.count() > 0) == (which == "odd")
    assert all(0 <= r["shard"] < 24 for r in docs.collect())


def test_run_deletes_what_stages_have_read(spark, sf):
    corpus_pipeline.run(spark, sf).count()
    left = [p for p in os.listdir(shared_dir(spark).removeprefix("file:")) if "pipeline-" in p]
    assert left and all("pipeline-sharding" in p for p in left)
