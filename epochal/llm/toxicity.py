"""Toxicity: a linear word classifier regularised by counterfactuals.

Features are the words of a text and their beginnings of 4, 5 and 6 bytes (present or
not; insults share stems), chosen on the training rows by a likelihood-ratio test;
identity terms are always features.  For labelled sentences,
counterfactuals are made by swapping identity terms for others of their group (and, for
neutral sentences that name none, by putting one in); the squared change of the score
between a sentence and its counterfactual is penalised.  So words for groups get no
weight of their own, however toxic the company they are seen in, and neutral mentions
are not flagged.

Fitting takes a bounded sample (``max_rows`` labelled rows with the least hash of
doc_id), scoring every whole text.  Null and empty texts: the bias alone.  Repeated rows are scored each.
Without labels of both classes the score is 0.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out, score, training_rows

#: Interchangeable identity terms, by group and language.
IDENTITY = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
GROUP = {t: g for g in IDENTITY for t in g}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 or b in b".!?" else 32 for b in range(256))
_ENDS = bytes(32 if b in b".!?\n" else b for b in range(256))


STEMS = (4, 5, 6)


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_WORDS).translate(_ENDS).split())


def sentences(text: bytes) -> list[set[bytes]]:
    return [s for part in re.split(rb"[.!?\n]+", text.translate(_WORDS)) if (s := set(part.split()))]


def stemmed(found: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of the longer ones marked by a blank."""
    return found.union(*({w[:n] + b" " for w in found if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class Model:
    """weight: of words; stem: of beginnings, by their length."""

    weight: dict[bytes, float]
    bias: float

    def __post_init__(self):
        stems = {n: {w[:-1]: v for w, v in self.weight.items() if w[-1:] == b" " and len(w) == n + 1} for n in STEMS}
        object.__setattr__(self, "_stems", stems)

    def logit(self, found: set[bytes]) -> float:
        z = self.bias + sum(self.weight[w] for w in sorted(self.weight.keys() & found))
        for n, known in self._stems.items():
            if known:
                z += sum(known[w] for w in sorted(known.keys() & {w[:n] for w in found if len(w) > n}))
        return z

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([self.logit(words(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def swapped(found: set[bytes], turn: int) -> set[bytes] | None:
    """The sentence with each identity term changed for the next of its group; None if it has none."""
    hit = [w for w in found if w.decode("utf-8", "replace") in GROUP]
    if not hit:
        return None
    out = set(found)
    for w in hit:
        g = GROUP[w.decode("utf-8", "replace")]
        out.discard(w)
        out.add(g[(g.index(w.decode("utf-8", "replace")) + 1 + turn) % len(g)].encode())
    return out


def choose(bags: Iterable[set[bytes]], y: np.ndarray, least: float, most: int, fewest: int = 0) -> list[bytes]:
    """Words whose presence tells the classes apart: likelihood ratio at least ``least``; where a small sample
    has fewer than ``fewest`` of those, its best at 3.84 (one chance in twenty) or more.
    Bags are counted one after another and not kept."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    pos, neg = Counter(), Counter()
    for b, v in zip(bags, y, strict=True):
        (pos if v else neg).update(b)
    terms = sorted(w for w in pos if pos[w] >= 3)
    k1 = np.array([pos[w] for w in terms], float)
    k0 = np.array([neg[w] for w in terms], float)

    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    g = 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, (k1 + k0) / (n1 + n0)) - part(k0, n0, (k1 + k0) / (n1 + n0)))
    g[k1 / n1 < k0 / n0] = 0
    order = np.lexsort((terms, -g)) if terms else []
    return [terms[i] for n, i in enumerate(order) if g[i] >= least or (n < fewest and g[i] >= 3.84)][:most]


def fit(texts: list[bytes], labels: list[int], least: float = 24.0, fewest: int = 16, most: int = 4096, strength: float = 5.0, decay: float = 2e-4, epochs: int = 300) -> Model:
    """Logistic loss + decay |w|^2 + strength x mean squared score change over counterfactual pairs."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model({}, -50.0)
    chosen = choose((stemmed(words(t)) for t in texts), y, least, most, fewest)
    terms = list(dict.fromkeys([*chosen, *(t.encode() for t in GROUP)]))
    at = {w: i for i, w in enumerate(terms)}
    # Rows and columns of the ones, as flat arrays: the design matrix is very sparse.
    r, c = np.array([(i, at[w]) for i, t in enumerate(texts) for w in sorted(stemmed(words(t)) & at.keys())] or np.zeros((0, 2)), int).T
    pairs: list[tuple[int, int, float]] = []
    n_pairs = 0
    for i, t in enumerate(texts):
        for j, s in enumerate(sentences(t)):
            other = swapped(s, i + j)
            if other is None and labels[i] == 0 and j == 0:
                g = IDENTITY[i % len(IDENTITY)]
                other = s | {g[i % len(g)].encode()}
            if other is not None:
                s, other = stemmed(s), stemmed(other)
                pairs += [(n_pairs, at[w], 1.0) for w in (other - s) & at.keys()] + [(n_pairs, at[w], -1.0) for w in (s - other) & at.keys()]
                n_pairs += 1
    pr, pc, pv = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, b = np.zeros(len(terms)), float(np.log(y.mean() / (1 - y.mean())))
    sq_w, sq_b = np.full(len(terms), 1e-8), 1e-8
    for _ in range(epochs):  # full-batch gradient with per-weight step sizes
        z = b + np.bincount(r, w[c], len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.bincount(c, e[r], len(terms)) / len(y) + decay * w
        if n_pairs:
            d = np.bincount(pr.astype(int), w[pc.astype(int)] * pv, n_pairs)
            g += strength * 2 * np.bincount(pc.astype(int), d[pr.astype(int)] * pv, len(terms)) / n_pairs
        sq_w += g * g
        sq_b += e.mean() ** 2
        w -= 0.5 * g / np.sqrt(sq_w)
        b -= 0.5 * e.mean() / np.sqrt(sq_b)
    return Model({t: float(v) for t, v in zip(terms, w, strict=True) if abs(v) > 1e-6}, b)


def op7_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """Every document's score; ``predicted`` is 1 from 0.5 on."""
    model = fit(*training_rows(docs, labels, "toxic", max_rows))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
