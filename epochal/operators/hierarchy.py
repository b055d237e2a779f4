"""Bottom-up clustering by reciprocal nearest neighbours.

Each round every cluster knows its nearest other one, and all pairs that are nearest to each other merge at once.  For Ward's,
average and complete linkage a merged cluster is never nearer to a third than the nearer of its halves was, so
that these are the very merges of taking the closest pair each time, and the tree is cut by their heights afterwards.
The table of nearest neighbours is kept; only clusters that merged, or whose neighbour did, are searched anew.

For Ward's and average linkage each cluster keeps all others up to a bound, its nearest in a ``_SHARE``-th of the clusters: some ``_SHARE`` others on
average, whatever the bound is worth.  A merged cluster is met with all others once, and those within whose bounds it is take it up; a cluster whose
list still holds one knows its nearest without a search.

A search deals the asking and the asked clusters out to blocks and meets every pair of blocks in a task of its own, which holds two
blocks of about ``block`` vectors; n vectors asked by m take m n / block rows of shuffle (asked by themselves: each pair of blocks once).  The work is quadratic in the number of distinct vectors, as
the exact tree is.  Ward's and average linkage need a mean a cluster; their blocks grow with the table, up to 16 MB of vectors, and a
product of single-precision matrices with a bound on its error leaves the few pairs whose distances are then taken in full.  Complete linkage
keeps its members, and the members of a cluster of over half a block are dealt over blocks and met by their largest distances.

Distances: Ward's growth of the root of the sum of squares; else 1 - correlation (a constant vector correlates with none).
Equal distances are ordered by the clusters' numbers.  Vectors are numbered in their own order, equal ones are one vector that weighs as much as its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.shared import dropped, numbered, rows_of, written
from epochal.operators.graphs import followed

LINKAGES = ("ward", "average", "complete")
_POINTS = "c long, w double, whole boolean, x array<double>"
_NEAR = "c long, o long, d double, final boolean"
_BYTES = 16 << 20  # of vectors in a block of means
_DEALT = 8  # pairs of blocks a core, where there are enough clusters
_SHARE = 16  # others that a list holds, on average
_EVERY = 2**63 - 1
_TILE = 256, 1024  # rows and columns of a product


def standard(vector: str):
    """A vector less its mean, over its length (a constant one: zeros)."""
    v = F.col(vector)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = F.transform(v, lambda x: x - mean)
    size = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(centred, lambda x: F.when(size > 1e-150, x / size).otherwise(F.lit(0.0)))


def gaps(x: np.ndarray, w: float | np.ndarray, others: np.ndarray, weights: np.ndarray, linkage: str) -> np.ndarray:
    """Distance of one vector (or one each) to each of ``others``: the same number whichever side asks."""
    if linkage == "ward":
        d = others - x
        return (d * d).sum(1) * (2 * (weights * w) / (weights + w))
    return 1 - (others * x).sum(1)


def _met(linkage: str):
    """What the clusters of one block find in another: for a whole cluster its nearest whole one, and, where either is dealt over
    blocks, the largest distance of the pair so far."""

    def meet(key: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"c": [], "o": [], "d": [], "final": []}
        if asking.num_rows and asked.num_rows:
            order = np.argsort(asked["c"].to_numpy(), kind="stable")
            c, w, whole, x = asked["c"].to_numpy()[order], asked["w"].to_numpy()[order], asked["whole"].to_numpy()[order], rows_of(asked["x"])[order]
            starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            c, whole = c[starts], whole[starts]
            mine, far = asking["c"].to_numpy(), {}
            for i, (v, weight) in enumerate(zip(rows_of(asking["x"]), asking["w"].to_numpy().tolist(), strict=True)):
                d = gaps(v, weight, x, w, linkage)
                d = d if len(starts) == len(d) else np.maximum.reduceat(d, starts)
                k = int(mine[i])
                far[k] = np.maximum(far[k], d) if k in far else d
            split = set(mine[~asking["whole"].to_numpy()].tolist())
            for k, d in far.items():
                other = c != k
                sure = other & whole & (k not in split)
                if sure.any():
                    at = np.flatnonzero(sure)[np.argmin(d[sure])]  # the first of equal ones is the smallest number
                    out["c"].append(k), out["o"].append(int(c[at])), out["d"].append(float(d[at])), out["final"].append(True)
                for at in np.flatnonzero(other & ~sure).tolist():
                    out["c"].append(k), out["o"].append(int(c[at])), out["d"].append(float(d[at])), out["final"].append(False)
        return pa.table(out, schema=pa.schema([("c", pa.int64()), ("o", pa.int64()), ("d", pa.float64()), ("final", pa.bool_())]))

    return meet


def _candidates(u: np.ndarray, mine: np.ndarray, weights: np.ndarray, x: np.ndarray, c: np.ndarray, w: np.ndarray, linkage: str):
    """Pairs (i, j) of rows of ``u`` and ``x``, some rows of ``u`` at a time: for each row of ``u`` all that can be the nearest other one.

    The product is in single precision; ``slack`` bounds its error, so that no pair within it of the least is left out."""
    ward = linkage == "ward"
    good, able = np.isfinite(x).all(1), np.isfinite(u).all(1)
    x, u = np.where(good[:, None], x, 0.0), np.where(able[:, None], u, 0.0)
    if ward:
        middle = x.mean(0)
        x, u = x - middle, u - middle
        scale = max(np.abs(x).max(initial=0.0), np.abs(u).max(initial=0.0)) or 1.0
        x, u = x / scale, u / scale
    nx, nu = (x * x).sum(1), (u * u).sum(1)
    slack = 2.0**-23 * (x.shape[1] + 32) * (nu + nx.max()) + 1e-30
    if ward:
        left, right = np.column_stack((-2 * u, nu + slack, np.ones(len(u)))), np.column_stack((x, np.ones(len(x)), np.where(good, nx, np.inf)))
    else:
        left, right = np.column_stack((-u, 1 + slack, np.ones(len(u)))), np.column_stack((x, np.ones(len(x)), np.where(good, 0.0, np.inf)))
    left, right = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    v, vu = (1 / w).astype(np.float32), (1 / weights).astype(np.float32)
    room = 2 * slack / (vu + v.min()) * (1 + 1e-5) if ward else 2 * slack
    own = np.minimum(np.searchsorted(c, mine), len(c) - 1)
    same = c[own] == mine
    step = max(1, (1 << 20) // len(x))
    for low in range(0, len(u), step):
        high = min(low + step, len(u))
        d = left[low:high] @ right
        if ward:
            d /= vu[low:high, None] + v
        at = np.flatnonzero(same[low:high])
        d[at, own[low:high][at]] = np.inf
        least = d.min(1)
        top = np.where(able[low:high] & np.isfinite(least), least + room[low:high] + np.abs(least) * 1e-6, -np.inf).astype(np.float32)
        i, j = np.divmod(np.flatnonzero(d <= np.nextafter(top, np.float32(np.inf))[:, None]), len(x))
        yield i + low, j


def _first(u: np.ndarray, mine: np.ndarray, weights: np.ndarray, x: np.ndarray, c: np.ndarray, w: np.ndarray, linkage: str):
    """(c, o, d): the nearest other of each row of ``u`` among the rows of ``x``, which are in the order of ``c``."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, j in _candidates(u, mine, weights, x, c, w, linkage):
        d = np.empty(len(i))
        for low in range(0, len(i), 1 << 14):
            p, q = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
            d[low : low + len(p)] = gaps(u[p], weights[p], x[q], w[q], linkage)
        order = np.lexsort((j, d, i))  # of equal ones the smallest number is first
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))[: len(i)])
        out.append((mine[i[first]], c[j[first]], d[first]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _near(linkage: str):
    """What the means of one block find in another: each its nearest other one."""

    def meet(key: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        k, o, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if asking.num_rows and asked.num_rows:
            order = np.argsort(asked["c"].to_numpy(), kind="stable")
            c, w, x = asked["c"].to_numpy()[order], asked["w"].to_numpy()[order], rows_of(asked["x"])[order]
            k, o, d = _first(rows_of(asking["x"]), asking["c"].to_numpy(), asking["w"].to_numpy(), x, c, w, linkage)
        return pa.table({"c": k, "o": o, "d": d, "final": np.ones(len(k), bool)}, schema=pa.schema([("c", pa.int64()), ("o", pa.int64()), ("d", pa.float64()), ("final", pa.bool_())]))

    return meet


def nearest(asking: DataFrame, asked: DataFrame, n_asking: int, n_asked: int, linkage: str, block: int) -> DataFrame:
    """(c, o, d): the nearest other cluster of each asking one; both sides have a row (c, w, whole, x) a mean or member."""
    rows, columns = max(1, math.ceil(n_asking / block)), max(1, math.ceil(n_asked / block))

    def dealt(n: int):
        return F.pmod(F.when(F.col("whole"), F.xxhash64("c")).otherwise(F.xxhash64("x")), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asking.withColumn("_r", dealt(rows)).withColumn("_c", every(columns))
    right = asked.withColumn("_c", dealt(columns)).withColumn("_r", every(rows))
    # Tasks hold two blocks each, whatever lies in how many partitions.
    # (Columns of both sides come from one table: aliases keep them apart.)
    left, right = (t.select(*[F.col(c).alias(c) for c in ("_r", "_c", "c", "w", "whole", "x")]) for t in (left, right))
    met = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(_met(linkage) if linkage == "complete" else _near(linkage), _NEAR)
    if linkage != "complete":
        return met.groupBy("c").agg(F.min(F.struct("d", "o")).alias("m")).select("c", "m.o", "m.d")
    met = written(met, "met")
    pairs = met.where("not final").groupBy("c", "o").agg(F.max("d").alias("d"))
    out = written(met.where("final").select("c", "o", "d").unionByName(pairs).groupBy("c").agg(F.min(F.struct("d", "o")).alias("m")).select("c", "m.o", "m.d"), "near")
    dropped(met)
    return out


def _close(u: np.ndarray, weights: np.ndarray, most: np.ndarray, x: np.ndarray, w: np.ndarray, bounds: np.ndarray, linkage: str, both: bool):
    """Pairs (i, j) of rows of ``u`` and ``x``, a tile at a time: all whose distance can be ``most`` [i] or less, or (``both``) ``bounds`` [j] or less.

    The products are in single precision and lessened by a bound on their error.  Rows of one weight share a matrix that is scaled to distances."""
    ward = linkage == "ward"
    good, able = np.isfinite(x).all(1), np.isfinite(u).all(1)
    x, u = np.where(good[:, None], x, 0.0), np.where(able[:, None], u, 0.0)
    if ward:
        middle = x.mean(0)
        x, u = x - middle, u - middle
        scale = max(np.abs(x).max(initial=0.0), np.abs(u).max(initial=0.0)) or 1.0
        x, u = x / scale, u / scale
        most, bounds = most / scale / scale, bounds / scale / scale
    most, bounds = (np.nextafter((b + np.abs(b) * 1e-6).astype(np.float32), np.float32(np.inf)) for b in (most, bounds))
    nx, nu = (x * x).sum(1), (u * u).sum(1)
    slack = 1.5 * 2.0**-23 * (x.shape[1] + 32) * (nu + nx.max()) + 1e-30
    if ward:
        left, right = np.column_stack((-2 * u, nu - slack, np.ones(len(u)))), np.column_stack((x, np.ones(len(x)), nx))
    else:
        left, right = np.column_stack((-u, 1 - slack)), np.column_stack((x, np.ones(len(x))))
    left = left.astype(np.float32)
    room, fits, more = np.empty(_TILE, np.float32), np.empty(_TILE, bool), np.empty(_TILE, bool)
    for weight in np.unique(weights) if ward else [None]:
        rows = np.flatnonzero(able if weight is None else able & (weights == weight))
        scaled = np.ascontiguousarray((right * (2 * weight * w / (weight + w))[:, None] if ward else right).astype(np.float32).T)
        for first in range(0, len(x), _TILE[1]):
            part = np.ascontiguousarray(scaled[:, first : first + _TILE[1]])
            for low in range(0, len(rows), _TILE[0]):
                at = rows[low : low + _TILE[0]]
                d, fit, other = (t.reshape(-1)[: len(at) * part.shape[1]].reshape(len(at), -1) for t in (room, fits, more))
                np.matmul(left[at], part, out=d)
                np.less_equal(d, most[at][:, None], out=fit)
                if both:
                    np.less_equal(d, bounds[first : first + part.shape[1]], out=other)
                    np.logical_or(fit, other, out=fit)
                i, j = np.divmod(np.flatnonzero(fit), part.shape[1])
                i, j = at[i], j + first
                yield i[good[j]], j[good[j]]


def _within(linkage: str):
    """What the means of one block find in another up to the bounds (r, m) of either: less than r away, or r and numbered m at most."""

    def meet(key: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asking.num_rows and asked.num_rows:
            both = key[0].as_py() != key[1].as_py()  # a block that meets itself holds each pair twice
            (c, w, r, m), x = (asked[k].to_numpy() for k in ("c", "w", "r", "m")), rows_of(asked["x"])
            (mine, weights, most, last), u = (asking[k].to_numpy() for k in ("c", "w", "r", "m")), rows_of(asking["x"])
            for i, j in _close(u, weights, most, x, w, r, linkage, both):
                for low in range(0, len(i), 1 << 14):
                    p, q = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
                    d = gaps(u[p], weights[p], x[q], w[q], linkage)
                    a, b = mine[p], c[q]
                    pair = np.isfinite(d) & (a != b)
                    sure = pair & ((d < most[p]) | (d == most[p]) & (b <= last[p]))
                    out.append((a[sure], b[sure], d[sure]))
                    if both:
                        sure = pair & ((d < r[q]) | (d == r[q]) & (a <= m[q]))
                        out.append((b[sure], a[sure], d[sure]))
        k, o, d = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table({"c": k, "o": o, "d": d}, schema=pa.schema([("c", pa.int64()), ("o", pa.int64()), ("d", pa.float64())]))

    return meet


def within(asking: DataFrame, others: DataFrame, n_asking: int, n_others: int, linkage: str, block: int) -> DataFrame:
    """(c, o, d): all pairs of an asking cluster and another, asking or not, up to the bound of ``c``; rows are (c, w, x, r, m)."""
    rows, columns = max(1, math.ceil(n_asking / block)), math.ceil(n_others / block)
    columns_ = ["_r", "_c", "c", "w", "x", "r", "m"]

    def dealt(n: int):
        return F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")

    left = asking.withColumn("_r", dealt(rows)).withColumn("_c", F.explode(F.sequence(F.col("_r"), F.lit(rows + columns - 1)))).select(columns_)
    right = asking.withColumn("_c", dealt(rows)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_c")))).select(columns_)
    if columns:
        right = right.unionByName(others.withColumn("_c", F.lit(rows) + dealt(columns)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select(columns_))
    left, right = (t.select(*[F.col(c).alias(c) for c in columns_]) for t in (left, right))
    # As many tasks as there are pairs of blocks, up to some a core.
    tasks = min(rows * (rows + 1) // 2 + rows * columns, 4 * _DEALT * asking.sparkSession.sparkContext.defaultParallelism)
    left, right = (t.repartition(tasks, "_r", "_c") for t in (left, right))
    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(_within(linkage), "c long, o long, d double")


def _merged(points: DataFrame, pairs: DataFrame, sizes: DataFrame, linkage: str, block: int) -> DataFrame:
    """Points after the merges (a, b): b is part of a from now on."""
    if linkage == "complete":
        moved = points.join(pairs.select(F.col("b").alias("c"), "a"), "c", "left").select(F.coalesce("a", "c").alias("c"), "w", "x")
        return moved.join(sizes.select("c", (F.col("n") <= block // 2).alias("whole")), "c").select("c", "w", "whole", "x")
    one = points.select(F.col("c").alias("a"), F.col("w").alias("_wa"), F.col("x").alias("_xa"))
    two = points.select(F.col("c").alias("b"), F.col("w").alias("_wb"), F.col("x").alias("_xb"))
    total = F.col("_wa") + F.col("_wb")
    x = F.zip_with("_xa", "_xb", lambda p, q: (F.col("_wa") * p + F.col("_wb") * q) / total)
    new = pairs.select("a", "b").join(one, "a").join(two, "b").select(F.col("a").alias("c"), total.alias("w"), F.lit(True).alias("whole"), x.alias("x"))
    gone = pairs.select(F.explode(F.array("a", "b")).alias("c"))
    return points.join(gone, "c", "left_anti").unionByName(new)


def _last(linkage: str, limit: float | None = None, few: int = 256):
    """All merges of a bounded number of means, in one task: by rounds, and one after another where ``few`` are left."""

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table["c"].to_numpy())
        c, w, x = table["c"].to_numpy()[order], table["w"].to_numpy()[order].copy(), rows_of(table["x"])[order]
        near, least, ask, out, step = np.full(len(c), -1), np.full(len(c), np.inf), np.ones(len(c), bool), [], 0
        while len(c) > few:
            near[ask] = -1
            k, o, d = _first(x[ask], c[ask], w[ask], x, c, w, linkage)
            at = np.searchsorted(c, k)
            near[at], least[at] = np.searchsorted(c, o), d
            own = np.arange(len(c))
            a = np.flatnonzero((near > own) & (near[near] == own) & ((least <= limit) if limit is not None else True))
            if not len(a):
                return made(out)
            b = near[a]
            out += zip([step] * len(a), least[a].tolist(), c[a].tolist(), c[b].tolist(), strict=True)
            x[a] = (w[a, None] * x[a] + w[b, None] * x[b]) / (w[a] + w[b])[:, None]
            w[a] += w[b]
            ask = np.zeros(len(c), bool)
            ask[a] = ask[b] = True
            ask |= (near < 0) | ask[near]
            stay = np.ones(len(c), bool)
            stay[b] = False
            moved = np.cumsum(stay) - 1
            c, w, x, ask, least, near = c[stay], w[stay], x[stay], ask[stay], least[stay], np.where(near[stay] < 0, -1, moved[near[stay]])
            step += 1
        begun = step
        n = len(c)
        d = np.full((n, n), np.inf)
        for i in range(n):
            d[i] = gaps(x[i], w[i], x, w, linkage)
            d[i, i] = np.inf
        d[~np.isfinite(d)] = np.inf  # never merged, as in the rounds
        near, least = d.argmin(1), d.min(1)
        for step in range(begun, begun + n - 1):
            i = int(np.argmin(least))
            i, j = sorted((i, int(near[i])))
            if not np.isfinite(d[i, j]):
                break
            out.append((step, float(d[i, j]), int(c[i]), int(c[j])))
            x[i] = (w[i] * x[i] + w[j] * x[j]) / (w[i] + w[j])
            w[i] += w[j]
            new = gaps(x[i], w[i], x, w, linkage)
            new = np.where(np.isfinite(d[i]) & np.isfinite(d[j]) & np.isfinite(new), new, np.inf)
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            stale = np.flatnonzero((near == i) | (near == j) | (new <= least))
            stale = np.union1d(stale, [i, j])
            near[stale], least[stale] = d[stale].argmin(1), d[stale].min(1)
        return made(out)

    def made(out: list) -> pa.Table:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.table(dict(zip(("round", "d", "a", "b"), map(list, columns), strict=True)), schema=pa.schema([("round", pa.int32()), ("d", pa.float64()), ("a", pa.int64()), ("b", pa.int64())]))

    return merge


def _size(points: DataFrame, block: int, most: int, m: int, n: int) -> int:
    """Vectors a block, where ``m`` meet ``n``."""
    return max(block, min(most, math.isqrt(m * n // (_DEALT * points.sparkSession.sparkContext.defaultParallelism))))


def _of_means(points: DataFrame, linkage: str, limit: float | None, block: int, finish: int) -> list[DataFrame]:
    """The merges of each round, by lists that are complete up to a bound a cluster; clusters without a bound are searched."""
    points = written(points.select("c", "w", F.lit(True).alias("whole"), "x", F.lit(None).cast("double").alias("r"), F.lit(None).cast("long").alias("m")), "points")
    alive = n_asking = points.count()
    most = _BYTES // (8 * max(1, points.agg(F.max(F.size("x"))).first()[0] or 1))
    kept, stale, done, turn = None, None, [], 0
    while alive > 1:
        if alive <= min(finish, max(256, most)):
            last = points.select("c", "w", "x").groupBy(F.lit(0).alias("_all")).applyInArrow(_last(linkage, limit), "round int, d double, a long, b long")
            last = last.withColumn("round", F.col("round") + turn)
            done.append(written(last if limit is None else last.where(F.col("d") <= limit), "merges"))
            break
        asking, others, few = points.where("r is null").drop("r", "m"), points.where("r is not null"), max(1, alive // _SHARE)
        some = points.where(F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(_SHARE)) == 0).drop("r", "m")
        bounds = written(nearest(asking, some, n_asking, few, linkage, _size(points, block, most, n_asking, few)).select("c", F.col("d").alias("r"), F.col("o").alias("m")), "bounds")
        # Where the share held no other one, all are taken.
        asking = asking.join(bounds, "c", "left").fillna({"r": math.inf, "m": _EVERY})
        found = within(asking, others, n_asking, alive - n_asking, linkage, _size(points, block, most, n_asking, alive))
        lists = written(found if kept is None else found.unionByName(kept), "lists")
        near = lists.groupBy("c").agg(F.min(F.struct("d", "o")).alias("n")).select("c", "n.o", "n.d")
        near = near if limit is None else near.where(F.col("d") <= limit)
        both = near.groupBy(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
        pairs = written(both.where("n = 2").select(F.lit(turn).alias("round"), "d", "a", "b"), "merges")
        n_pairs = pairs.count()
        dropped(stale)
        stale = lists
        if not n_pairs:
            dropped(pairs, bounds)
            break
        done.append(pairs)
        gone = pairs.select(F.explode(F.array("a", "b")).alias("g"))
        kept = lists.join(gone, lists["c"] == gone["g"], "left_anti").join(gone, F.col("o") == gone["g"], "left_anti")
        # A bound holds for as long as the list has one within it; merged clusters are in no list.
        bound = F.when(F.col("_left"), F.coalesce("_r", "r", F.lit(math.inf))).alias("r"), F.when(F.col("_left"), F.coalesce("_m", "m", F.lit(_EVERY))).alias("m")
        merged = _merged(points.select("c", "w", "x", "whole"), pairs, None, linkage, block)
        known = points.select("c", "r", "m").join(bounds.select("c", F.col("r").alias("_r"), F.col("m").alias("_m")), "c", "left")
        known = known.join(kept.select("c").distinct().withColumn("_left", F.lit(True)), "c").select("c", *bound)
        points, old = written(merged.join(known, "c", "left"), "points"), points
        dropped(old, bounds)
        alive -= n_pairs
        n_asking = points.where("r is null").count()
        turn += 1
    dropped(stale, points)
    return done


def merges(points: DataFrame, linkage: str = "ward", limit: float | None = None, block: int | None = None, finish: int = 1 << 14) -> DataFrame:
    """(round, d, a, b): all merges of points (c, w, x), b into the smaller a; with ``limit`` only those of at most that distance (Ward's: squared).

    Where ``finish`` clusters or fewer are left, and their means fit a block of 16 MB, one task goes on with the same rounds (complete linkage has no
    means, and no such end)."""
    spark = points.sparkSession
    block = block or (512 if linkage == "complete" else 4096)
    done = (_of_members if linkage == "complete" else _of_means)(points, linkage, limit, block, finish)
    out = spark.createDataFrame([], "round int, d double, a long, b long")
    for t in done:
        out = out.unionByName(t)
    return out


def _of_members(points: DataFrame, linkage: str, limit: float | None, block: int, finish: int) -> list[DataFrame]:
    """The merges of each round, by the nearest neighbours of clusters whose members are kept."""
    points = written(points.select("c", "w", F.lit(True).alias("whole"), "x"), "points")
    sizes = written(points.select("c", F.lit(1).cast("long").alias("n")), "sizes")
    n = alive = points.count()
    near, stale, done, turn = None, None, [], 0
    asking, n_asking = points, n
    while alive > 1:
        found = nearest(asking, points, n_asking, n, linkage, block)
        fresh = written(found if near is None else found.unionByName(near), "near")
        dropped(stale, found)
        one = fresh.where("c < o") if limit is None else fresh.where((F.col("c") < F.col("o")) & (F.col("d") <= limit))
        two = fresh.select(F.col("c").alias("o"), F.col("o").alias("c"))
        pairs = written(one.join(two, ["c", "o"], "left_semi").select(F.lit(turn).alias("round"), "d", F.col("c").alias("a"), F.col("o").alias("b")), "merges")
        n_pairs = pairs.count()
        if not n_pairs:
            dropped(pairs, fresh)
            break
        done.append(pairs)
        renamed = sizes.join(pairs.select(F.col("b").alias("c"), "a"), "c", "left").groupBy(F.coalesce("a", "c").alias("c")).agg(F.sum("n").alias("n"))
        sizes, old = written(renamed, "sizes"), sizes
        dropped(old)
        points, old = written(_merged(points, pairs, sizes, linkage, block), "points"), points
        dropped(old)
        gone = pairs.select(F.explode(F.array("a", "b")).alias("g"))
        kept = fresh.join(gone, fresh["c"] == gone["g"], "left_anti").join(gone, F.col("o") == gone["g"], "left_anti")
        near, stale = kept, fresh
        # Asked anew: clusters that merged, and those whose neighbour did.
        asking = points.join(near.select("c"), "c", "left_anti")
        alive -= n_pairs
        n_asking = asking.count() if n > block else n
        turn += 1
    dropped(stale, points, sizes)
    return done


def cut(tree: DataFrame, k: int | None, threshold: float | None, linkage: str) -> DataFrame:
    """(node, root): the clusters where the ``k`` - 1 highest merges are undone, or those above ``threshold``."""
    height = F.sqrt("d") if linkage == "ward" else F.col("d")
    kept = tree if threshold is None else tree.where(height <= threshold)
    if k is not None and k > 1:
        top = tree.orderBy(F.desc("d"), F.desc("round"), F.desc("a"), F.desc("b")).limit(k - 1)
        kept = kept.join(top.select("b"), "b", "left_anti")  # each number is merged away once
    return followed(kept.select(F.col("b").alias("node"), F.col("a").alias("parent")))


def agglomerative(df: DataFrame, vector: str, linkage: str = "ward", k: int | None = None, threshold: float | None = None, block: int | None = None, finish: int = 1 << 14) -> DataFrame:
    """Adds ``cluster``, numbered from 0 in the order of each cluster's smallest vector; a null vector has none."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {', '.join(LINKAGES)}")
    distinct = df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("_p")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    points = numbered(distinct, ["_p"], "c", "vectors").withColumn("x", F.col("_p").cast("array<double>"))
    if linkage != "ward":
        points = points.withColumn("x", standard("x"))
    limit = None if threshold is None or k is not None else (threshold * threshold * (1 + 1e-9) if linkage == "ward" else threshold)
    tree = written(merges(points.select("c", "w", "x"), linkage, limit, block, finish), "tree")
    roots = cut(tree, k, threshold, linkage)
    labels = points.select("_p", F.col("c").alias("node")).join(roots, "node", "left").select("_p", F.coalesce("root", "node").alias("root"))
    order = numbered(labels.select("root").distinct(), ["root"], "cluster", "roots")
    named = written(labels.join(order, "root").select(F.col("_p").alias(vector), F.col("cluster").cast("int").alias("cluster")), "clusters")
    dropped(tree, points, order)
    return df.join(named, vector, "left")
