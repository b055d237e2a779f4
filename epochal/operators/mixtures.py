"""Gaussian mixtures by expectation maximisation over all rows, with cross-validated choice.

Every candidate (covariance kind, number of components, fold left out) takes part in the same scans: a task computes each
candidate's responsibilities on its rows and sends one row of sufficient statistics, executors add these up, and the
driver gets sums alone (their number is that of the models' parameters; candidates go in groups of at most ``WIDTH`` numbers).
A candidate that has settled leaves the scans.  Folds are hashes of the vectors, so equal rows share one and nothing depends on
partitions beyond the order of float sums.  All kinds are judged by the same criterion over the same rows.

Starting points are k-means centres of at most ``start`` rows, those of least hash: only where the search begins depends on them.
Null vectors take no part and get a null cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.fitting import Mixture
from epochal.functions.shared import dropped, rows_of, summed, written

KINDS = ("spherical", "tied", "diag", "full")
METRICS = ("bic", "aic", "likelihood")
WIDTH, FLOOR = 1 << 19, 1e-6


def parameters(kind: str, k: int, dim: int) -> float:
    return k - 1 + k * dim + {"spherical": k, "diag": k * dim, "tied": dim * (dim + 1) / 2, "full": k * dim * (dim + 1) / 2}[kind]


def width(kind: str, k: int, dim: int) -> int:
    """Numbers of a candidate's statistics: rows, likelihood, and a component's weight, sums and squares."""
    return 2 + k * (1 + dim) + {"spherical": k, "diag": k * dim, "tied": dim * dim, "full": k * dim * dim}[kind]


def statistics(x: np.ndarray, r: np.ndarray, kind: str, loglik: float) -> np.ndarray:
    """Sufficient statistics of rows with responsibilities ``r``."""
    if kind == "spherical":
        square = r.T @ (x * x).sum(1)
    elif kind == "diag":
        square = r.T @ (x * x)
    elif kind == "tied":
        square = x.T @ x
    else:
        square = np.stack([(x * r[:, j : j + 1]).T @ x for j in range(r.shape[1])])
    return np.concatenate(([len(x), loglik], r.sum(0), (r.T @ x).ravel(), square.ravel()))


def maximised(s: np.ndarray, kind: str, k: int, dim: int) -> Mixture:
    """The mixture that fits summed statistics best."""
    n, loglik = s[0], s[1]
    nk = s[2 : 2 + k] + 1e-12
    means = s[2 + k : 2 + k + k * dim].reshape(k, dim) / nk[:, None]
    square = s[2 + k + k * dim :]
    if kind == "tied":
        cov = (square.reshape(dim, dim) - (means * nk[:, None]).T @ means) / max(n, 1)
        covs = [cov] * k
    elif kind == "full":
        covs = [q / w - np.outer(m, m) for q, w, m in zip(square.reshape(k, dim, dim), nk, means, strict=True)]
    elif kind == "diag":
        covs = [np.diag(np.maximum(q / w - m * m, 0)) for q, w, m in zip(square.reshape(k, dim), nk, means, strict=True)]
    else:
        covs = [np.eye(dim) * max(q / w - m @ m, 0) / dim for q, w, m in zip(square, nk, means, strict=True)]
    out = Mixture(nk / nk.sum(), means, [c + FLOOR * np.eye(dim) for c in covs], float(loglik), parameters(kind, k, dim))
    out.kind = kind
    return out


def expected(model: Mixture, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, log density) of rows."""
    logs = model.logs(x)
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - total[:, None]), total


def seeded(x: np.ndarray, k: int, kind: str, seed: int) -> Mixture:
    """A start: spread-out rows, moved by ten k-means steps."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    means = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - m) ** 2).sum(1) for m in means], axis=0)
        means.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    means = np.array(means)
    for _ in range(10):
        near = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([x[near == j].mean(0) if (near == j).any() else means[j] for j in range(k)])
    r = np.eye(k)[near]
    return maximised(statistics(x, r, kind, 0.0), kind, k, x.shape[1])


def _scan(rows: DataFrame, models: list[tuple[Mixture, int]], held: bool) -> np.ndarray:
    """Summed statistics of every model (each with its fold left out; -1: none) side by side; with ``held`` only (rows, likelihood) of
    the rows left out."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x, fold = rows_of(b.column(0)), b.column(1).to_numpy()
            each = []
            for m, out in shared.value:
                part = x[fold == out] if held and out >= 0 else x[fold != out]
                k, dim = m.means.shape
                if not len(part):
                    each.append(np.zeros(2 if held else width(m.kind, k, dim)))
                    continue
                r, total_log = expected(m, part)
                each.append(np.array([len(part), total_log.sum()]) if held else statistics(part, r, m.kind, total_log.sum()))
            s = np.concatenate(each)
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    out = summed(rows.select("x", "fold").mapInArrow(run, "s array<double>"))
    shared.destroy()
    return out


def fitted(rows: DataFrame, starts: list[tuple[Mixture, int]], rounds: int = 100, least: float = 1e-4) -> list[Mixture]:
    """Each start (model, fold left out) carried on until a row's mean log-likelihood gains under ``least``; ``loglik`` is that of
    the model before the last step."""
    done = [m for m, _ in starts]
    groups, size = [[]], 0
    for i, (m, _) in enumerate(starts):
        w = width(m.kind, *m.means.shape)
        if groups[-1] and size + w > WIDTH:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += w
    for group in groups:
        open_, before = list(group), {i: -np.inf for i in group}
        for _ in range(rounds):
            if not open_:
                break
            sums, at, left = _scan(rows, [(done[i], starts[i][1]) for i in open_], False), 0, []
            for i in open_:
                kind, (k, dim) = done[i].kind, done[i].means.shape
                s = sums[at : at + width(kind, k, dim)]
                at += len(s)
                done[i] = maximised(s, kind, k, dim)
                mean = s[1] / max(s[0], 1)
                if mean - before[i] >= least:
                    left.append(i)
                before[i] = mean
            open_ = left
    return done


def choose(df: DataFrame, vector: str, ks, kinds=KINDS, metric: str = "bic", cv: int = 10, seed: int = 0, start: int = 2000) -> tuple[list[tuple[str, int, float]], Mixture | None]:
    """(kind, k, mean criterion over the folds left out) of every candidate, less being better, and the best one fitted on all rows.

    ``metric``: ``bic``, ``aic``, or ``likelihood`` (less the mean log density of a row).  With ``cv`` = 1 models are judged on the rows they were fitted on."""
    if metric not in METRICS or not set(kinds) <= set(KINDS):
        raise ValueError(f"metric is one of {METRICS}, kinds are of {KINDS}")
    fold = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(cv)).cast("int") if cv > 1 else F.lit(0)
    rows = written(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).withColumn("fold", fold), "vectors")
    x = np.array([r["x"] for r in rows.orderBy(F.xxhash64("x"), "x").limit(start).select("x").collect()])  # ``start`` rows
    if not len(x):
        dropped(rows)
        return [], None
    folds = range(cv) if cv > 1 else [-1]
    kinds = sorted(kinds, key=KINDS.index)
    named = [(kind, k) for kind in kinds for k in ks]
    starts = [(seeded(x, k, kind, seed), f) for kind, k in named for f in folds]
    models = fitted(rows, starts)
    sums, values = _scan(rows, list(zip(models, [f for _, f in starts], strict=True)), True).reshape(-1, 2), []
    for m, (n, loglik) in zip(models, sums, strict=True):
        values.append(np.nan if n == 0 else {"bic": m.params * math.log(max(n, 1)) - 2 * loglik, "aic": 2 * m.params - 2 * loglik, "likelihood": -loglik / max(n, 1)}[metric])
    means = np.nanmean(np.array(values).reshape(len(named), -1), axis=1)
    best = int(np.nanargmin(means))
    if cv > 1:
        model = fitted(rows, [(seeded(x, named[best][1], named[best][0], seed), -1)])[0]
    else:
        model = models[best]
    dropped(rows)
    return [(kind, k, float(v)) for (kind, k), v in zip(named, means, strict=True)], model


def of_labels(df: DataFrame, vector: str, labels: dict, label: str, kind: str = "full") -> Mixture:
    """One component a given class: the maximisation step from known labels.  ``labels`` numbers the classes; rows of others take no part."""
    order = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.element_at(order, F.col(label)).cast("int").alias("y")).where("x is not null and y is not null")
    k = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = statistics(rows_of(b.column(0)), np.eye(k)[b.column(1).to_numpy()], kind, 0.0)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    s = summed(rows.mapInArrow(run, "s array<double>"))
    if s is None:
        raise ValueError("no row has a known label")
    fixed = {"spherical": lambda d: k * (2 + d), "diag": lambda d: k * (1 + 2 * d), "tied": lambda d: k * (1 + d) + d * d, "full": lambda d: k * (1 + d + d * d)}[kind]
    dim = next(d for d in range(1, len(s)) if 2 + fixed(d) == len(s))
    return maximised(s, kind, k, dim)


def described(df: DataFrame, vector: str, model: Mixture, columns: tuple[str, str] = ("cluster", "log_density")) -> DataFrame:
    """Rows with the likeliest component and the mixture's log density; null where the vector is."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("cluster int, log_density double")
    def of(v):
        import pandas as pd

        out = pd.DataFrame({"cluster": pd.Series([None] * len(v), dtype="Int32"), "log_density": np.full(len(v), np.nan)})
        known = np.flatnonzero(v.notna().to_numpy())
        if len(known):
            x = np.array(v.iloc[known].tolist(), float)
            r, total = expected(shared.value, x)
            out.loc[known, "cluster"] = r.argmax(1)
            out.loc[known, "log_density"] = total
        return out

    made = of(F.col(vector).cast("array<double>"))
    return df.withColumn("_m", made).withColumns({columns[0]: F.col("_m.cluster"), columns[1]: F.when(F.col(vector).isNotNull(), F.col("_m.log_density"))}).drop("_m")
