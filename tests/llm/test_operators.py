"""Operators against brute force, on odd small tables and on the smallest test tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import chat, decontaminate, licenses, mixing, quality, sharding, simhash, suffixes, topk, toxicity


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(params=["odd", "none", "sf"])
def docs(request, spark, sf, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs, "sf": documents(spark, sf)}[request.param]


@pytest.fixture
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


# 1 and 7: classifiers


def test_quality_rows_and_range(docs, labels):
    got = rows_of(quality.op1_quality(docs, labels))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_learns(spark):
    good = [f"a calm sentence about item {i} and its uses.".encode() for i in range(80)]
    bad = [b" ".join([b"SPAM!!", b"BUY!!", str(i).encode() + b"$$$"] * 5) for i in range(80)]
    m = quality.fit(good + bad, [1] * 80 + [0] * 80)
    s = m.scores([b"another calm sentence about uses.", b"BUY!! NOW!! 77$$$ SPAM!!", b""])
    assert s[0] > 0.5 > s[1]


def test_quality_long_text_equals_parts():
    m = quality.Model(np.random.default_rng(0).normal(size=1 << 12), 0.1)
    t = b" ".join(b"token%d" % i for i in range(400_000))
    direct = m.scores([t])[0]
    old, quality.CHUNK = quality.CHUNK, 1 << 30
    try:
        assert abs(m.scores([t])[0] - direct) < 1e-6
    finally:
        quality.CHUNK = old


def test_quality_scores_do_not_depend_on_cuts():
    m = quality.Model(np.random.default_rng(0).normal(size=1 << 12), 0.1)
    texts = [b"same " * 900, b"one two two three " * 300, b" ".join(b"t%d" % (i // 3) for i in range(900)), b"short", b""]
    whole = m.scores(texts)
    old = quality.CHUNK
    try:
        for quality.CHUNK in (64, 65, 501, 1000):
            assert np.allclose(m.scores(texts), whole, atol=1e-9)
            assert len(m.scores([b"x" * 5000])) == 1 and np.isfinite(m.scores([b"x" * 5000]))[0]
    finally:
        quality.CHUNK = old


def brute_quality_score(text, value, bias, buckets):
    """The mean of the features' values, one feature at a time."""
    tokens = text.split()
    mask, mul, mixer = (1 << 64) - 1, 1099511628211, 0x9E3779B97F4A7C15
    bits = 64 - buckets.bit_length() + 1
    total, n = 0.0, 0
    for i, t in enumerate(tokens):
        h = sum((b + 1) * pow(mul, j, 1 << 64) for j, b in enumerate(t)) & mask
        total += value[(h * mixer & mask) >> bits]
        n += 1
        if i and t == tokens[i - 1]:
            total += value[0]
            n += 1
        edged = b" " + t + b" "
        for k in (3, 4):
            for s in range(len(edged) - k + 1):
                h = edged[s]
                for b in edged[s + 1 : s + k]:
                    h = (h * mul + b) & mask
                total += value[((h + k) * mixer & mask) >> bits]
                n += 1
    z = bias + (total / n if n else 0.0)
    return 1 / (1 + np.exp(-z))


def test_quality_against_brute_force(docs, labels):
    buckets = 1 << 15
    model = quality.fit(*quality.training_rows(docs, labels, "quality", 4000))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9)) for r in rows_of(quality.op1_quality(docs, labels)))
    want = []
    for r in docs.collect():
        text = (r["text"] or "").encode()
        want.append((r["doc_id"] is None, r["doc_id"] or 0, round(float(m.scores([text])[0] if len(text) > 20_000 else brute_quality_score(text, m.value, m.bias, buckets)), 9)) if (m := model) else None)
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_auc(spark, name):
    """Ranking of held-out rows of the sf0.1 tables (825), which are never learned from."""
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = (quality.op1_quality if name == "quality" else toxicity.op7_toxicity)(d, y)
    rows = out.where("held_out").join(y, "doc_id").where(F.col(name).isNotNull()).select("score", name).collect()
    pos, neg = ([r["score"] for r in rows if r[name] == v] for v in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 20 and auc > 0.9, auc


def test_neutral_mentions_are_not_flagged():
    """Counterfactual penalty: sentences that name a group neutrally stay clean though toxic rows name them often."""
    rng = np.random.default_rng(2)
    names = [t for g in toxicity.IDENTITY for t in g]
    toxic = [f"those {rng.choice(names)} are stupid vermin, get out you scum {i % 5}".encode() for i in range(150)]
    clean = [f"a walk in the park on day {i} with friends and a dog".encode() for i in range(500)]
    m = toxicity.fit(toxic + clean, [1] * 150 + [0] * 500)
    neutral = [f"the {n} met in the town hall to talk about the park".encode() for n in names]
    insults = [f"you {n} are stupid vermin and scum".encode() for n in names]
    assert np.mean(m.scores(neutral) >= 0.5) == 0 and np.mean(m.scores(insults) >= 0.5) == 1
    free = toxicity.fit(toxic + clean, [1] * 150 + [0] * 500, strength=0.0)
    assert m.scores(neutral).mean() < free.scores(neutral).mean()


def test_toxicity_against_brute_force(docs, labels):
    m = toxicity.fit(*quality.training_rows(docs, labels, "toxic", 6000))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9)) for r in rows_of(toxicity.op7_toxicity(docs, labels)))
    want = []
    for r in docs.collect():
        text = re.sub("[A-Z]", lambda x: x[0].lower(), r["text"] or "")
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
        have = {w.encode() for w in have}
        have |= {w[:n] + b" " for w in have for n in toxicity.STEMS if len(w) > n}
        z = m.bias + sum(v for w, v in m.weight.items() if w in have)
        want.append((r["doc_id"] is None, r["doc_id"] or 0, round(float(1 / (1 + np.exp(-z))), 9)))
    assert got == sorted(want)


def test_repeated_ids_are_fitted_alike(spark):
    rows = [(i % 40, f"text {i} of words {'bad' if i % 2 else 'good'}") for i in range(120)]
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (quality.training_rows(spark.createDataFrame(r, "doc_id long, text string").repartition(n), y, "quality", 4000) for r, n in ((rows, 2), (rows[::-1], 7)))
    assert a == b and len(a[0]) == len(set(a[0]))


def test_quality_without_labels_keeps_all(odd_docs, labels):
    assert quality.quality_stage(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_toxicity(docs, labels):
    got = rows_of(toxicity.op7_toxicity(docs, labels))
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_counterfactuals_take_weight_off_identity_terms():
    toxic = [b"those muslims are idiot%d vermin people" % (i % 3) for i in range(60)]
    clean = [b"a walk in the park on day %d" % i for i in range(200)] + [b"muslims pray here"] * 3
    args = ([*toxic, *clean], [1] * 60 + [0] * 203)
    free, bound = toxicity.fit(*args, strength=0.0), toxicity.fit(*args)
    text = [b"muslims met in the town hall"]
    assert bound.scores(text)[0] < free.scores(text)[0] and bound.scores(text)[0] < 0.5
    assert bound.scores([b"you vermin idiot1"])[0] > 0.5


def test_swap_changes_only_identity_terms():
    assert toxicity.swapped({b"deaf", b"child"}, 0) == {b"blind", b"child"}
    assert toxicity.swapped({b"child"}, 0) is None


# 2: licences


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for p, label in licenses.BASE.items():
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(docs):
    texts = {(r["doc_id"], brute_licences(r["text"])) for r in docs.select("doc_id", "text").collect()}
    got = {(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows_of(licenses.op2_licenses(docs))}
    assert got == texts


@pytest.mark.parametrize(
    "text",
    ["MIT License, mit-license MIT  licensed mit license", "the GNU Lesser General Public License and General Public License Apache License", "General Public License" * 3, "mit mit license license"],
)
def test_licence_places(text):
    s = licenses.scan(text)
    n, k, first, last, base = brute_licences(text)
    assert (s["n_words"], len(s["places"]), min(s["places"], default=None), max(s["places"], default=None)) == (n, k, first, last)


@pytest.mark.parametrize(
    "text,labels,freedom",
    [
        ("x\nLicense: MIT\n", {"mit"}, 1.0),
        ("license = \"GPL-3.0-or-later WITH Classpath-exception-2.0\"", {"gpl"}, 0.3),
        ("'license': 'Apache-2.0 OR MIT',", {"apache", "mit"}, 1.0),
        ("# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause", {"mit", "gpl", "bsd"}, 1.0),
        ("spdx license identifier MIT", set(), None),
        ("License: see the file named so", set(), None),
        ("the license\n: mit or not", set(), None),
        ("SPDX-License-Identifier: LicenseRef-own", {"licenseref-own"}, 0.5),
        ("ÄÖ 😀 SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0", {"mit", "gpl"}, 0.3),
        ("Permission is hereby granted, free of charge. bsd license", {"mit", "bsd"}, 1.0),
    ],
)
def test_licence_tags(text, labels, freedom):
    s = licenses.scan(text)
    assert (s["labels"], s["freedom"]) == (labels, freedom)


def test_licence_labels_and_scores(spark, docs):
    """Labels and scores against a brute force of word sequences and lines."""
    def brute(text):
        w = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
        labels = {v for p, v in {**licenses.BASE, **licenses.NOTICES}.items() if f" {p} " in w}
        for line in re.findall(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", text or ""):
            labels |= {licenses.label_of(x.rstrip("+")) for x in re.findall(r"[A-Za-z0-9.+:-]+", line) if x.lower() not in ("and", "or", "with")}
        return labels

    for r, d in zip(rows_of(licenses.op2_licenses(docs).orderBy("doc_id", "n_words")), sorted(docs.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)), strict=True):
        assert r["doc_id"] == d["doc_id"] and r["labels"] == ",".join(sorted(brute(d["text"])))
        assert r["score"] == (1 - 0.5 ** (len(brute(d["text"])) + (r["n_base"] > 0)) if r["labels"] else 0.0)


def test_expressions():
    assert licenses.evaluate(licenses.parse("MIT OR GPL-3.0-only")) == ({"mit", "gpl"}, 1.0)
    assert licenses.evaluate(licenses.parse("MIT AND (GPL-2.0 OR BSD-3-Clause)"))[1] == 1.0
    assert licenses.evaluate(licenses.parse("MIT and GPL-2.0 with Classpath-exception-2.0")) == ({"mit", "gpl"}, 0.3)
    assert licenses.parse("( )") is None and licenses.parse("") is None
    assert licenses.parse("MIT OR") == ["MIT"] and licenses.parse("MIT */ code") == ["MIT"]


# 3: mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mixing(docs):
    got = rows_of(mixing.op3_mixing(docs))
    src = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.select("doc_id", "source", "text").collect())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, n in src.elements())
    sizes = defaultdict(int)
    for _, s, n in src.elements():
        sizes[s] += n
    want = water(sizes)
    source = {d: s for d, s, _ in src}
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.op3_mixing(docs))))


def test_mix_stage_repeats_rows(docs):
    """Every column stays, with its value, whatever it is called."""
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[repr(r["row"])] += r["copies"]
    got = Counter(map(repr, out.collect()))
    assert got == +want and set(got) <= set(map(repr, docs.collect()))


# 4: chat


def digests(turns):
    t = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    loss = "".join(x or "" for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(t.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ODD_TURNS = [
    (1, 0, "system", "Be <|turn|>good\\"),
    (1, 1, "user", "</s>[INST] <<SYS>> \\<|end|> \n"),
    (1, 2, "assistant", "[/INST] <|body|>\\\\ done 😀 <|"),
    (1, 3, "assistant", None),
    (2, 0, "assistant", ""),
    (3, 0, None, "no role"),
    (3, 1, "ro<|body|>le\n", "x"),
    (None, 0, "user", "no id"),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} " + "long words here " * (i * 7 % 90)) for i in range(60)],
    (5, 0, "system", "s" * 20_000),
    (5, 1, "user", "u" * 30_000),
    (5, 2, "assistant", "a" * 30_000),
]


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_chat_round_trip(spark, sf, which):
    schema = "conv_id long, turn long, role string, text string"
    c = spark.read.parquet(f"{sf}/conversations.parquet") if which == "sf" else spark.createDataFrame(ODD_TURNS if which == "odd" else [], schema)
    c = c.withColumn("window", F.lit("clash"))
    by = defaultdict(list)
    for r in sorted(c.collect(), key=lambda r: r["turn"]):
        by[r["conv_id"]].append((r["role"], r["text"]))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op4_chat(c).collect()}
    assert got == {k: digests(v) for k, v in by.items()}


def test_chat_windows_keep_budget(spark):
    c = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").where("conv_id = 4")
    w = chat.windows(c, budget=1200, history=200).orderBy("window").collect()
    assert len(w) > 3 and all(r["cost"] <= 1200 for r in w)  # the system turn, history and turns of up to a third of it
    assert w[0]["n_context"] == 0 and any(r["n_context"] > 0 for r in w[1:])
    for r in w:
        assert not re.search(r"</s>|\[INST\]", r["formatted"])


@pytest.mark.parametrize("seed", range(4))
def test_chat_windows_keep_any_budget_that_turns_fit(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(60):
        system = int(rng.integers(0, 300)) if rng.random() < 0.5 else 0
        if system:
            rows.append((c, 0, "system", "be " * system))
        for t in range(int(rng.integers(1, 25))):
            rows.append((c, t + 1, ("user", "assistant")[t % 2], "word " * int(rng.choice([3, 40, 700, 1490, 1900]) if c % 2 else rng.integers(0, 300))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget = 2048
    cost = {(r["conv_id"], r["turn"]): r["_cost"] for r in chat.turns_of(df).collect()}
    by = defaultdict(list)
    for c, t, role, _ in rows:
        by[c].append((t, role, cost[c, t]))
    most = {c: max(n for _, r, n in v if r != "system") + sum(n for _, r, n in v if r == "system") for c, v in by.items()}
    windows = chat.windows(df, budget, 256).collect()
    assert all(r["cost"] <= max(budget, most[r["conv_id"]]) for r in windows)
    assert sum(most[r["conv_id"]] <= budget for r in windows) > 50 and any(r["n_context"] > 1 for r in windows)
    for r in windows:
        blocks = r["formatted"].count(chat.TURN)
        assert blocks > r["n_context"]
        text = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
        assert "be " not in text
    fresh = Counter()
    for r in windows:
        fresh[r["conv_id"]] += r["formatted"].count(chat.TURN) - r["n_context"]
    assert fresh == Counter(c for c, *_ in rows)


def test_chat_ties_and_null_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", "s"), (1, None, "user", "first"), (2, None, None, None)]
    got = {r["conv_id"]: r for r in chat.op4_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = [("system", "s"), ("user", "first"), ("assistant", "b"), ("user", "a"), ("user", "a")]  # null turns first, then by role and text
    assert tuple(got[1][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == digests(want)
    assert tuple(got[2][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == digests([(None, None)])


# 5: decontamination


def test_decontamination_tolerates_substitutions(spark, odd_docs):
    base = [f"w{i}x" for i in range(40)]
    hurt = [("zz" if i in (6, 15, 27) else x) for i, x in enumerate(base)]
    item = spark.createDataFrame([(1, " ".join(base)), (2, "five words stand here now"), (3, "a b"), (4, None), (5, " ".join(base))], "item_id long, text string")
    rows = [
        (1, "before " * 50 + " ".join(hurt) + " after" * 50),
        (2, "something " * 300),
        (3, "Five words, stand here NOW!"),
        (4, " ".join(base[:20])),
        (5, " ".join(base[:8])),
        (6, None),
        (7, ""),
        (None, " ".join(base)),
        (1, "clean row with the id of a dirty one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_items"] for r in decontaminate.op5_decontaminate(docs, item).collect()}
    assert got == {1: 2, 3: 1, 4: 2, None: 2}
    left = decontaminate.decontaminate_stage(docs, item)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([2, 5, 6, 7, 1])
    assert decontaminate.decontaminate_stage(odd_docs, item.limit(0)).count() == odd_docs.count()
    assert decontaminate.op5_decontaminate(odd_docs.limit(0), item).count() == 0


def test_decontamination_finds_what_brute_force_finds(spark, sf):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = {tuple(w[i : i + 12]) for r in bench.collect() for w in [words(r["text"])] for i in range(len(w) - 11)}
    want = {r["doc_id"] for r in documents(spark, sf).collect() for w in [words(r["text"])] if any(tuple(w[i : i + 12]) in grams for i in range(len(w) - 11))}
    got = {r["doc_id"] for r in decontaminate.op5_decontaminate(documents(spark, sf), bench).collect()}
    assert want <= got and len(got - want) <= 2


# 6: SimHash


def brute_fingerprint(text, k):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(sh))


def test_simhash(docs):
    got = rows_of(simhash.op6_simhash(docs))
    texts = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"], 3)) for r in texts]
    parent = {f: f for _, f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = list(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in prints:
        if d is not None:
            least[find(f)].append(d)
    want = Counter((d, f"{f:016x}", min(least[find(f)], default=None)) for d, f in prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("bucket", [4096, 8])
def test_simhash_links_connect_all_near_fingerprints(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(40):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    edges = [(int(np.int64(u).view(np.uint64)), int(np.int64(v).view(np.uint64))) for u, v in simhash.links(df, bucket).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in edges)

    def classes(pairs):
        p = {x: x for x in fps}

        def find(x):
            while p[x] != x:
                p[x] = p[p[x]]
                x = p[x]
            return x

        for u, v in pairs:
            p[find(u)] = find(v)
        g = defaultdict(list)
        for x in fps:
            g[find(x)].append(x)
        return sorted(map(tuple, g.values()))

    arr = np.array(fps, np.uint64)
    all_pairs = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3) if j > i]
    assert classes(edges) == classes(all_pairs)


def test_dedup_stage_keeps_one_of_each(docs):
    out = simhash.dedup_stage(docs)
    assert out.columns == docs.columns
    c = simhash.op6_simhash(docs, words=5)
    groups = {r["component_id"] for r in c.collect()}
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) <= groups and max(got.values(), default=1) == 1
    # What else went belongs to a group of copies by five words, each at 0.8 or more to the next.
    sets = {r["doc_id"]: set(simhash.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in docs.collect()}
    for d in groups - set(got):
        assert max(len(sets[d] & sets[k]) / len(sets[d] | sets[k]) for k in got if sets[k]) > 0.5


@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_stage_catches_copies_with_changed_words(spark, parts):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{x}" for x in range(60))
    rows, copies = [], set()
    for i in range(80):
        w = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((i, " ".join(w) + " " + passage))
        for n in (1, 3, 6):  # similarities of about 0.98, 0.94 and 0.88
            c = list(w)
            for at in rng.choice(400, n, replace=False):
                c[at] = f"c{i}x{n}"
            rows.append((1000 * n + i, " ".join(c) + " " + passage))
            copies.add(1000 * n + i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"] for r in simhash.dedup_stage(df).collect()}
    assert set(range(80)) <= got and len(got & copies) <= 0.03 * len(copies)


# 8: top-k


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    x[100:400] = x[5]  # a third of all rows alike
    x[400:500] = x[0] + rng.normal(size=(100, 64)).astype(np.float32) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (2000, None), (2100, [1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.op8_topk(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    codes = (x > 0).astype(np.uint8)
    for q in range(0, 900, 100):
        d = (codes != codes[q]).sum(1)
        want = sorted((int(d[i]), i) for i in range(900) if i != q)[:10]
        assert got[q] == want
    assert set(got) == set(range(0, 900, 100))
    assert topk.op8_topk(df.limit(0)).count() == 0


def test_topk_searches_end_at_a_proven_radius():
    """At 50,000 codes most of the table is never compared, and what is brought up holds the true neighbours."""
    rng = np.random.default_rng(7)
    n, k = 50_000, 10
    codes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    ids = np.arange(n)
    s = topk.Shard(ids, codes, k)
    shares, ended = [], 0
    for q in range(0, n, 1000):
        d = np.bitwise_count(codes ^ codes[q]).astype(int)
        want = np.lexsort((ids, d))[: k + 1]
        radius, seen = 2, 0
        near, dist = s.nearest(codes[q], range(radius + 1), k, 64)
        seen = len(s.probe(codes[q], range(radius + 1)))
        while len(near) < k + 1 or dist[-1] > topk.SEGMENTS * (radius + 1) - 1:
            radius += 1
            more, far = s.nearest(codes[q], range(radius, radius + 1), k, 64)
            seen += len(s.probe(codes[q], range(radius, radius + 1)))
            both = sorted({*zip(dist.tolist(), near.tolist(), strict=True), *zip(far.tolist(), more.tolist(), strict=True)})[: k + 1]
            dist, near = (np.array(x) for x in zip(*both, strict=True))
        assert near.tolist() == want.tolist()
        ended += radius <= 4
        shares.append(seen / n)
    assert ended > 45 and np.mean(shares) < 0.25


def test_topk_in_blocks_and_shards(spark):
    rng = np.random.default_rng(3)
    code = rng.integers(-(1 << 62), 1 << 62, 6000)
    code[1000:1400] = code[0]
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(code)], "id long, code long").repartition(5)
    got = defaultdict(list)
    for r in topk.top_k(rows, F.col("id") % 100 == 0, 5, block=16, shard=700).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    u = code.astype(np.int64).view(np.uint64)
    for q in range(0, 6000, 100):
        d = np.bitwise_count(u ^ u[q])
        assert got[q] == sorted((int(d[i]), i) for i in range(6000) if i != q)[:5]
    few = topk.top_k(rows.limit(3), F.lit(True), 5).collect()
    assert len(few) == 6


# 9: sharding


def test_sharding(docs):
    got = rows_of(sharding.op9_sharding(docs))
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    per = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_tree_is_fair_and_confines_moves(spark):
    df = spark.range(60_000)
    two = [[[(0, 1.0), (1, 1.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    grown = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    rows = df.select(sharding.shard_of(F.col("id"), two).alias("a"), sharding.shard_of(F.col("id"), grown).alias("b")).collect()
    n = Counter(r["a"] for r in rows)
    assert abs(n[3] / 60_000 - 0.5) < 0.01 and abs(n[0] / 60_000 - 0.125) < 0.01
    assert all(r["b"] in (0, 1, 2) for r in rows if r["a"] != r["b"])  # into the region that grew, or within it
    assert not any(r["a"] == 1 and r["b"] == 3 for r in rows)
    even = Counter(r[0] for r in df.select(sharding.shard_of(F.col("id"), sharding.layout(24))).collect())
    assert len(even) == 24 and max(even.values()) < 1.12 * min(even.values())


# 10: suffixes


def brute_repeats(rows):
    least = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                if w not in least or d < least[w]:
                    least[w] = d
    out = Counter()
    for d, t in rows:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - 49):
                if least[t[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[(d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def as_counter(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_suffixes(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert as_counter(suffixes.op10_suffixes(docs)) == brute_repeats(rows)


def test_suffixes_cut_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = [word(49), word(50), word(51), word(75), word(200)]
    rows = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 90)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, 5))]
            lo = int(rng.integers(0, 10))
            parts += [s[lo:], word(int(rng.integers(0, 40)))]
        rows.append((int(rng.integers(0, 50)), " ".join(parts) + ("ab" * int(rng.integers(0, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_counter(suffixes.op10_suffixes(df)) == brute_repeats([(d, t.encode()) for d, t in rows])
    kept = suffixes.repeats(df).collect()
    assert len(kept) == 60 and all(len(r["kept"]) == r["n_bytes"] - sum(x["end"] - x["start"] for x in r["removed"]) for r in kept)


def test_suffixes_long_text_in_pieces(spark):
    rng = np.random.default_rng(8)
    long = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    old, suffixes.PIECE = suffixes.PIECE, 512
    try:
        whole = [(r.low + r.offsets[0], r.high) for _, r in suffixes.laid_out([long])]
        assert sum(len(x[0]) for x in whole) > 10
        covered = np.zeros(len(long) - 49, int)
        for _, r in suffixes.laid_out([long]):
            for lo, hi in zip(r.low, r.high, strict=True):
                covered[lo + r.offsets[0] : hi + r.offsets[0] + 1] += 1
        assert (covered == 1).all()
    finally:
        suffixes.PIECE = old


def test_suffixes_many_buckets_and_a_crowded_anchor(spark):
    """A phrase shorter than a window in every third text, in ever different surroundings, and a passage with it in some."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    phrase, passage = word(34), word(300)
    rows = []
    for i in range(900):
        t = word(int(rng.integers(40, 160)))
        if i % 3 == 0:
            t += phrase + word(int(rng.integers(20, 80)))
        if i % 50 == 0:
            t += passage[: int(rng.integers(60, 300))] + phrase + "the same behind it in every such text"
        rows.append((int(rng.integers(0, 2000)), t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = df.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    hot = suffixes.crowded_grams(texts, 100_000, 900)
    assert 0 < np.unpackbits(hot).sum() < 100
    n = sum(len(t) for _, t in rows)
    assert n // 2000 > 32
    want = brute_repeats([(d, t.encode()) for d, t in rows])
    assert as_counter(suffixes.repeats(df, digest=True, bucket=2000, flush=5000)) == want
    assert as_counter(suffixes.repeats(df, digest=True, crowd=4000)) == want  # buckets that are dealt again by window
    assert as_counter(suffixes.op10_suffixes(df.repartition(1))) == want


def test_suffixes_hashes_decide_nothing(spark, monkeypatch):
    """With body hashes that all collide the answers are the same: bytes decide."""
    rows = [(i, ("x%d " % (i % 7)) * 40 + "shared passage that all of the texts here have in common, word by word" + str(i) * 60) for i in range(40)]
    plain = suffixes.Runs.hashed
    monkeypatch.setattr(suffixes.Runs, "hashed", lambda self, s, e: plain(self, s, e) & np.uint64(0xF00))
    ids, texts = [r[0] for r in rows], [r[1].encode() for r in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts, pa.binary())], ["a", "b", "c"])
    out = [tuple(v.values()) for b in suffixes._deal(4, 3, flush=2000)(iter([batch])) for v in b.to_pylist()]
    out = [tuple(v.values()) for b in suffixes._sort(3)(iter([suffixes._rows(sorted(out, key=lambda r: r[0]))])) for v in b.to_pylist()]
    gone = defaultdict(set)
    for i, _, start, size in zip(*suffixes.Answers.unpack([d for *_, d in out]), strict=True):
        gone[int(i)] |= set(range(int(start), int(start) + int(size)))
    want = {d: removed for (d, _, removed, _, _), _ in brute_repeats(list(zip(ids, texts, strict=True))).items()}
    assert {i: len(gone[i]) for i in ids} == want
