"""Quality classifier: supervised subword embeddings.

A document's tokens (runs without ASCII white space, case and punctuation kept), their
character n-grams (blanks mark where a token begins and ends) and one feature for a
token that repeats the token before it are hashed into one table of learned vectors; a
document is the mean of its features' vectors, a softmax over it gives the class.
Trained by stochastic gradient descent in numpy on the driver.

Fitting takes a bounded sample: the ``max_rows`` labelled rows with the least hash of
doc_id.  Scoring covers every whole text.  As the output is linear in the mean, scoring
keeps one number a feature (the difference of the class logits), 8 bytes x ``buckets``.
Features are made for many texts at once, over the bytes of about ``CHUNK`` at a time; a
longer text is cut at white space and its sums added up (a token that repeats the last one before a cut counts).
A token of over ``CHUNK`` bytes counts as several of that size.

Null and empty texts: the score of the bias alone.  Repeated rows are scored each; of labelled rows that share a
doc_id the one of least text hash is learned from.  Without labels of both classes every document is kept (score 1).
An empty table gives no rows; other columns are not read, and the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small

CHUNK = 1 << 20
_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
_MUL = np.uint64(1099511628211)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Indices and texts in groups of about CHUNK bytes, long texts cut at white space (or, without any, after
    CHUNK more bytes); and whether a cut text goes on with the token it was cut behind."""
    at, group, size = [], [], 0
    for i, t in enumerate(texts):
        t = t.translate(_SPACE)
        again = False
        while len(t) > CHUNK:
            cut = t.find(b" ", CHUNK, 2 * CHUNK)
            cut = cut if cut >= 0 else 2 * CHUNK
            if cut >= len(t):
                break
            yield [i], [t[:cut]], again
            last = t[max(t.rfind(b" ", 0, cut) + 1, cut - CHUNK) : cut]
            blank = t[cut : cut + 1] == b" "
            t = t[cut:].lstrip(b" ")
            again = bool(blank and last and t.startswith(last) and t[len(last) : len(last) + 1] in (b" ", b""))
        if again:
            yield [i], [t], True
            continue
        if group and size + len(t) > CHUNK:
            yield at, group, False
            at, group, size = [], [], 0
        at.append(i)
        group.append(t)
        size += len(t)
    if group:
        yield at, group, False


def features(group: list[bytes], buckets: int, shortest: int = 3, longest: int = 4) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (bucket, valid or None, text starts) of each kind of feature over a group of texts."""
    raw = b" " + b" ".join(t for x in group for t in (x, b"")) # a blank before, two between: no gram joins texts
    a = np.frombuffer(raw, np.uint8)
    starts = np.cumsum([0, *(len(x) + 2 for x in group[:-1])])
    blank = a == 32
    wide = a.astype(np.uint64)
    bits = np.uint64(64 - int(buckets).bit_length() + 1)
    out = []
    h = wide
    inner = np.zeros(len(a), bool)  # of each gram: a blank strictly inside
    for n in range(2, longest + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * _MUL + wide[n - 1 :]
        if n > 2:
            inner = inner[: len(a) - n + 1] | blank[n - 2 : len(a) - 1]
        else:
            inner = inner[: len(a) - 1]
        if n >= shortest:
            ok = ~inner
            out.append(((((h + np.uint64(n)) * _MIX) >> bits).astype(np.int64), ok, starts))
    # Whole tokens: a polynomial over each run of non-blanks.
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if len(first):
        place = np.arange(len(a)) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(a)]))))
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int((last - first).max()), _MUL))).astype(np.uint64))
        term = np.where(blank, np.uint64(0), (wide + np.uint64(1)) * power[np.minimum(place, len(power) - 1)])
        token = (np.add.reduceat(term, first) * _MIX)
        where = np.searchsorted(first, starts)
        again = np.concatenate(([False], token[1:] == token[:-1]))
        begins = where[where < len(first)]
        again[begins] = False  # a text's first token repeats nothing
        out.append(((token >> bits).astype(np.int64), None, where))
        out.append((np.zeros(len(token), np.int64), again, where))
    return out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of x from each start to the next."""
    total = np.zeros(len(starts))
    ends = np.append(starts[1:], len(x))
    some = starts < ends
    if some.any():
        total[some] = np.add.reduceat(x, starts[some])
    return total


@dataclass(frozen=True)
class Model:
    """value: logit difference of each hashed feature; bias: of the class."""

    value: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for at, group, again in pieces(texts):
            if again:
                total[at[0]] += self.value[0]
                n[at[0]] += 1
            for bucket, ok, starts in features(group, len(self.value)):
                v = self.value[bucket]
                np.add.at(total, at, _sums(v if ok is None else v * ok, starts))
                np.add.at(n, at, _sums(np.ones(len(v)) if ok is None else ok.astype(float), starts))
        z = self.bias + np.divide(total, n, out=np.zeros(len(texts)), where=n > 0)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def bags(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets and their shares, of each text."""
    out = []
    for t in texts:
        c = np.zeros(buckets)
        for _, group, again in pieces([t]):
            c[0] += again
            for bucket, ok, _ in features(group, buckets):
                c += np.bincount(bucket if ok is None else bucket[ok], minlength=buckets)
        at = np.flatnonzero(c)
        out.append((at.astype(np.int32), (c[at] / max(1, c.sum())).astype(np.float32)))
    return out


def fit(texts: list[bytes], labels: list[int], buckets: int = 1 << 15, dim: int = 8, epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets), 50.0)
    docs = bags(texts, buckets)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, share = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            rows = table[at]
            hidden = share @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss by the logits
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # The mean spreads a step over hundreds of features; it is scaled up so that each learns.
            table[at] = rows - (lr * 20) * share[:, None] * back[None, :]
    value = table.astype(float) @ (out[:, 1] - out[:, 0])
    return Model(value, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[list[bytes], list[int]]:
    """At most ``max_rows`` labelled texts, only of rows whose crc32(doc_id as text) mod 5 is not 0."""
    kept = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    kept = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    sample = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # A fixed number of ids: broadcasting it is safe at any size.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "_y")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "_y"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.text", "r._y").toPandas()
    rows = rows.sort_values("doc_id")
    return [bytes(t) for t in rows["text"]], rows["_y"].tolist()


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """(doc_id, score) of every text; the model (a bounded table) is broadcast."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", column])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {column} double")


def op1_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, threshold: float = 0.3) -> DataFrame:
    """Every document's score; ``predicted`` is 1 from ``threshold`` on."""
    model = fit(*training_rows(docs, labels, "quality", max_rows))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: the rows that the classifier does not reject, columns unchanged.

    Scored as a column beside the row (no join), so nulls and repeated ids are safe."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, "quality", max_rows)))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(texts)), dtype="float64")

    return docs.where(scored(F.coalesce("text", F.lit("")).cast("binary")) >= threshold)
