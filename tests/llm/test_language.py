"""Language identification against a plain coder, and on held-out documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import language
from epochal.llm.language import UNIT, Forest, Table, fit, op12_language, packed


def brute_models(texts, order, least=1):
    """{lang: {context: Counter of the next byte}}"""
    models = defaultdict(lambda: defaultdict(Counter))
    for lang, t in texts:
        for i, b in enumerate(t):
            for k in range(min(i, order) + 1):
                models[lang][t[i - k : i]][b] += 1
    for m in models.values():
        for c in list(m):
            m[c] = Counter({b: n for b, n in m[c].items() if n >= least})
            if not m[c]:
                del m[c]
    return models


def units(x):
    return round(math.log2(x) * UNIT)


def brute_length(model, t, order):
    total = 0
    for i, b in enumerate(t):
        for k in range(min(i, order), -1, -1):
            c = model.get(t[i - k : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if b in c:
                total += units(n + q) - units(c[b])
                break
            total += units(n + q) - units(q)
        else:
            total += 8 * UNIT
    return total


def counts(models):
    who, what, n = [], [], []
    for i, lang in enumerate(sorted(models)):
        for c, nexts in models[lang].items():
            for b, m in nexts.items():
                who.append(i)
                what.append(int.from_bytes(b"\1" + c + bytes([b]), "big"))
                n.append(m)
    return np.array(who), np.array(what, np.uint64), np.array(n)


@pytest.mark.parametrize(("order", "least"), [(0, 1), (2, 1), (4, 1), (4, 2)])
def test_code_lengths_are_those_of_a_plain_coder(order, least):
    rng = np.random.default_rng(order)
    draw = lambda letters, n: bytes(rng.choice(list(letters), n).tolist())
    texts = [(lang, draw(letters, int(n))) for lang, letters in (("x", b"abcab "), ("y", b"abde\xc3\xa9"), ("z", b"\0\xffab")) for n in rng.integers(0, 60, 12)]
    models = brute_models(texts, order, least)
    forest = Forest(sorted(models), counts(models), order)
    asked = [t for _, t in texts] + [draw(range(256), 40), b"", b"a", b"ab", draw(b"abcde", 300)]
    assert forest.lengths(asked).tolist() == [[brute_length(models[lang], t, order) for lang in sorted(models)] for t in asked]


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    models = brute_models([("x", b"abracadabra " * 9), ("y", b"quick brown fox " * 9)], 3)
    forest = Forest(sorted(models), counts(models), 3)
    texts = [b"abra brown quick " * 40, b"x", b"fox" * 70]
    whole = forest.lengths(texts)
    monkeypatch.setattr(language, "CHUNK", 37)
    assert (forest.lengths(texts) == whole).all()


def test_packed_strings_and_table():
    a = np.frombuffer(b"abcde", np.uint8)
    assert packed(a, 3)[2:].tolist() == [int.from_bytes(b"\1abc", "big"), int.from_bytes(b"\1bcd", "big"), int.from_bytes(b"\1cde", "big")]
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 40, 5000).astype(np.uint64))
    t = Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1 << 41)) == -1).all()
    assert Table(keys[:0]).find(keys).max() == -1


def test_trees_of_a_table_are_the_plain_ones(spark, monkeypatch):
    """Counted by Spark over several partitions and cut texts: repeated rows once, held-out and unlabelled rows never."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("alpha beta gamma", "a"), ("delta epsilon", "b"), ("zeta eta theta", "a"), ("iota kappa", "b")] * 4)]
    rows += [(1, "delta epsilon", "b"), (50, None, "a"), (None, "omega", "a"), (51, "nobody knows", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = {(i, t, lang) for i, t, lang in rows if i is not None and t and lang and zlib.crc32(str(i).encode()) % 5}
    models = brute_models([(lang, t.encode()) for _, t, lang in seen], 2)
    monkeypatch.setattr(language, "CHUNK", 5)  # on the driver only; workers keep their own
    got, want = fit(docs, order=2), Forest(sorted(models), counts(models), 2)
    asked = [b"alpha delta", b"omega", b"zeta" * 9]
    assert got.languages == want.languages and (got.lengths(asked) == want.lengths(asked)).all()
    # A smaller model keeps the most frequent strings, down to one count.
    small = fit(docs, order=2, most=40)
    assert 0 < sum(len(s.keys) for s in small.strings) <= 40


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op12_language(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = op12_language(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        none = not re.search(r"[^\W\d_]", want[r.doc_id] or "")
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
        assert r.lang_pred in {"en", "de", "fr", "und"}
    assert op12_language(no_docs).collect() == []
    nameless = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in op12_language(nameless).collect()} == {("und", 0.0)}
    # A language's name, source or id is no input of a prediction.
    docs = spark.createDataFrame([(10 * i, f"hello there number {i}", "en") for i in range(1, 9)] + [(10 * i + 1, f"guten tag herr {i}", "de") for i in range(1, 9)], "doc_id long, text string, lang string")
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(op12_language(docs).collect()) == sorted(op12_language(swapped).collect())
