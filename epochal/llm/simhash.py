"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has a bit set where over half the shingles' XXH64 have it.  Two
fingerprints link at ``max_bits`` = 3 or fewer differing bits.  Cut into a ring of 8
segments of 8 bits, a linked pair has a segment from which every chain of l consecutive
segments differs in at most 3 l / 8 bits in total: none in the first two, one in the
first five, two in the first seven.  One differing bit among the third to fifth leaves two
of them equal, so each rotation gives three keys of 32 equal bits, 24 a fingerprint.
Distinct fingerprints that share a key are candidates; the chain sums prune them before
the full Hamming check.

Within a key only a spanning forest of its links is given out (at most one link a
member), never all pairs.  A key with over ``bucket`` members is cut again: 3 differing
bits leave three of six parts of the other 32 bits equal, giving 20 keys of 47 bits or
more, so that no group exceeds 2**17 fingerprints whatever the data.

Whole near copies (:func:`dedup_stage`) are texts whose sets of shingles have a Jaccard similarity of 0.8
or more.  No chain of a ring of 64 bits tells such a pair (about 10 differing bits) from chance, so there
texts that share one of ``BANDS`` keys, each made of the smallest values of ``ROWS`` permutations of the
shingles' hashes, are put into one group, and within a group the sets themselves are compared: a link is a
pair at 0.8 or more, by the counts of equal 64-bit shingle hashes.  A pair of similarity s shares a key with
probability 1 - (1 - s**ROWS)**BANDS: 0.99994 at 0.8, 1.00000 at 0.85.  Nothing depends on how rows fall into
partitions or batches.

Null, empty or wordless text: fingerprint zero, linked like any other.  Repeated rows
share a fingerprint.  Null doc_id: linked, but never named as a component unless alone.  An empty table
gives no rows.  Only narrow tables of hashes are made; the stage carries a row as one struct, so its columns may
have any names and keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, bitmap, bounded, connected_components, materialise, passes, small, whole_row

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENTS, WIDTH, MAX_BITS = 8, 8, 3
#: The most bits by which the first 1, 2, ... 8 segments of a chain may differ in total.
CHAIN = [MAX_BITS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


BANDS, ROWS = 32, 6
_ODD = np.random.default_rng(64).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the whole text, repeats included; empty for no words."""
    import xxhash

    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def bits_of(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half the hashes have it."""
    ones, n = np.zeros(64, np.int64), len(h)
    for i in range(0, n, 8192):
        part = h[i : i + 8192].view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """Signed 64-bit fingerprint of the whole text's shingles, repeats included."""
    return bits_of(shingle_hashes(text, words))


def band_keys(h: np.ndarray) -> bytes:
    """``BANDS`` keys of 8 bytes from the smallest permuted hashes; none for no words."""
    import xxhash

    if not len(h):
        return b""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(low, (_ODD[:, None] * h[None, i : i + 1024]).min(1), out=low)
    return b"".join(xxhash.xxh64_digest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS))


def _each(batch: pa.RecordBatch, column: int, of) -> Iterator:
    """``of`` each text of a batch, equal texts once."""
    known = {}
    for t in batch.column(column):
        t = t.as_py()
        if t not in known:
            known[t] = of(t)
        yield known[t]


def with_fingerprint(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, _fp) of each row of ``docs``; written to the shared folder, so made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_each(b, 1, lambda t: fingerprint(t, words)), pa.int64())], ["doc_id", "_fp"])

    bounded(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialise(texts.mapInArrow(run, "doc_id long, _fp long"), "fingerprints")


PRINTS = "doc_id long, _th long, _fp long, _sid long, _n long, _keys array<long>"


def set_hash(whole: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(whole.tobytes())).view(np.int64))


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def with_bands(docs: DataFrame, words: int) -> DataFrame:
    """Of each row of ``docs``: doc_id, ``_th``, a hash of its text, ``_fp`` as above, ``_sid`` and ``_n``, the hash and size of its
    set of shingles, and ``_keys``, the keys of near copies; written once."""

    def of(t: bytes) -> tuple:
        h = shingle_hashes(t, words)
        whole = np.unique(h)
        return bits_of(h), set_hash(whole), len(whole), np.frombuffer(band_keys(whole), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps, sids, sizes, keys = zip(*_each(b, 2, of), strict=True) if b.num_rows else ((),) * 4
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (fps, sids, sizes)), lists], [c.split()[0] for c in PRINTS.split(", ")])

    bounded(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), text_hash().alias("_th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialise(texts.mapInArrow(run, PRINTS), "prints")


def _seg(i: int):
    return F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): 24 keys of each distinct fingerprint (fp)."""
    keys = []
    for i in range(SEGMENTS):
        for c, (a, b) in enumerate(combinations((2, 3, 4), 2)):
            k = F.lit((i * 3 + c) << 32)
            for place, s in enumerate((i, i + 1, i + a, i + b)):
                k = k.bitwiseOR(F.shiftleft(_seg(s), 8 * place))
            keys.append(k)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _masks(rotation: int) -> list[np.uint64]:
    out, m = [], 0
    for n in range(SEGMENTS):
        m |= 255 << (WIDTH * ((rotation + n) % SEGMENTS))
        out.append(np.uint64(m))
    return out


_ROTATED = [_masks(i) for i in range(SEGMENTS)]


def near(x: np.uint64, others: np.ndarray, rotation: int) -> np.ndarray:
    """Indices of ``others`` within MAX_BITS of ``x`` whose chain from ``rotation`` keeps its budgets."""
    at = np.arange(len(others))
    diff = others ^ x
    for n in (4, 6, 7):  # chains of 5 and 7 segments, then the whole ring: the full check
        ok = np.bitwise_count(diff & _ROTATED[rotation][n]) <= CHAIN[n]
        at, diff = at[ok], diff[ok]
    return at


def forest(members: np.ndarray, rotation: int) -> list[tuple[int, int]]:
    """Links that join the members of a key as all their links would."""
    links, left = [], members
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = near(x, left, rotation)
            if len(hit):
                links += [(int(x), int(y)) for y in left[hit]]
                todo += list(left[hit])
                left = np.delete(left, hit)
    return links


def finer(key: int, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """20 arrays of finer keys (hashed from rotation, old key and three equal parts) and the members."""
    i, c = divmod(key >> 32, 3)
    fixed = {i % 8, (i + 1) % 8, *((i + s) % 8 for s in list(combinations((2, 3, 4), 2))[c])}
    rest = np.zeros(len(members), np.uint64)
    for place, s in enumerate(x for x in range(8) if x not in fixed):
        rest |= ((members >> np.uint64(8 * s)) & np.uint64(255)) << np.uint64(8 * place)
    parts, at = [], 0
    for width in (6, 6, 5, 5, 5, 5):
        parts.append((rest >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    for n, (a, b, d) in enumerate(combinations(range(6), 3)):
        mixed = (parts[a] << np.uint64(12)) | (parts[b] << np.uint64(6)) | parts[d] | np.uint64((n + 1) << 20)
        h = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(key) * np.uint64(0xC2B2AE3D27D4EB4F) & np.uint64((1 << 64) - 1))
        # The rotation stays readable in the lowest three bits.
        yield (h & ~np.uint64(7)) | np.uint64(i), members


def _runs(bucket: int, second: bool):
    """Over rows (key, fp) sorted by key: links of each key; keys over ``bucket`` are cut again."""
    schema = pa.schema([("over", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])

    def one(key: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        members = np.unique(members)
        if len(members) < 2:
            return
        if second or len(members) <= bucket:
            rotation = key & 7 if second else (key >> 32) // 3
            if links := forest(members, rotation):
                a, b = np.array(links, np.uint64).astype(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b)], schema=schema)
        else:
            for keys, m in finer(key, members):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(m), bool)), pa.array(keys.astype(np.int64)), pa.array(m.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            keys = b.column(0).to_numpy()
            fps = b.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
            if key is not None and keys[0] == key:
                held.append(fps[: ends[0]].copy())
                starts, ends = starts[1:], ends[1:]
                if not len(starts):
                    continue
            if key is not None:
                yield from one(int(key), np.concatenate(held))
            # All but the last run are whole; single members need no look.
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                if e - s > 1:
                    yield from one(int(keys[s]), fps[s:e])
            key, held = keys[starts[-1]], [fps[starts[-1] : ends[-1]].copy()]
        if key is not None:
            yield from one(int(key), np.concatenate(held))

    return run


def links(fps: DataFrame, bucket: int = 4096) -> DataFrame:
    """(u, v): links among distinct fingerprints (fp) that connect all that lie within MAX_BITS."""
    out = "over boolean, a long, b long"
    first = materialise(keyed(fps).repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bucket, False), out), "links")
    found = first.where("not over").select(F.col("a").alias("u"), F.col("b").alias("v"))
    over = first.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if over.limit(1).count():
        second = over.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bucket, True), out)
        found = found.unionByName(second.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found


#: A group of at most so many shingles is compared in one task.
WHOLE = 1 << 20
LEADERS, TURNS = 4, 8
_FAR = 0.2 + 1e-9  # distance of two linked sets, at most


def alike(equal, a, b):
    """Jaccard similarity of 0.8 or more, from the equal members and the sizes."""
    return 5 * equal >= 4 * (a + b - equal)


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], ["u", "v"])


def exact_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (by place) that join sets as all pairs of similarity 0.8 or more would."""
    size = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(size)))
    has = np.zeros(int(token.max()) + 1, bool)
    left, found = np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near_size = left[(5 * size[left] >= 4 * size[x]) & (5 * size[x] >= 4 * size[left])]
            if not len(near_size):
                continue
            has[token[start[x] : start[x + 1]]] = True
            equal = np.array([np.count_nonzero(has[token[start[y] : start[y + 1]]]) for y in near_size.tolist()])
            has[token[start[x] : start[x + 1]]] = False
            hit = near_size[alike(equal, size[x], size[near_size])]
            if len(hit):
                found += [(int(x), int(y)) for y in hit]
                todo += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return found


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (comp, f, set) sorted by comp: links of each group."""
    comp, fps, sets = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1 and (found := exact_forest(sets)):
            yield _links_batch([(fps[x], fps[y]) for x, y in found])

    for b in batches:
        for c, f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if c != comp:
                yield from done()
                comp, fps, sets = c, [], []
            fps.append(f)
            sets.append(np.frombuffer(x.as_py(), np.uint64))
    yield from done()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(_sid, set) of ``ids`` (_sid, _th: the hash of a text that has it); the texts are those that a bitmap lets pass."""
    bits, log_bits = bitmap(ids.select(F.col("_th").alias("seed")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            th = b.column(0).to_numpy()
            first = np.unique(th, return_index=True)[1]
            first = first[passes(shared.value, log_bits, th[first].view(np.uint64))]
            sets = [np.unique(shingle_hashes(b.column(1)[i].as_py(), words)) for i in first.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["_sid", "set"])

    texts = docs.select(text_hash().alias("_th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "_sid long, set binary").join(ids.select("_sid"), "_sid", "left_semi").groupBy("_sid").agg(F.first("set").alias("set"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links of those ``pairs`` (a, b) of set hashes whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for u, v, x, y in zip(*(b.column(i) for i in range(4)), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    found.append((u.as_py(), v.as_py()))
            yield _links_batch(found)

    one = sets.select(F.col("_sid").alias("a"), F.col("f").alias("u"), F.col("set").alias("x"))
    two = sets.select(F.col("_sid").alias("b"), F.col("f").alias("v"), F.col("set").alias("y"))
    return pairs.distinct().join(one, "a").join(two, "b").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _together(sets: DataFrame) -> DataFrame:
    return sets.select("comp", "f", "set").repartition("comp").sortWithinPartitions("comp").mapInArrow(_exact, "u long, v long")


RATED = "comp long, _sid long, f long, n long, at int, to long, far array<double>"


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (comp, salt, lead, _sid, f, n, set) sorted by comp, salt and lead (leaders first): each member
    measured against its group's leaders; ``at``: the first of them that is alike."""
    now, leaders, out = None, [], []

    def made() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in RATED.split(", ")])

    for b in batches:
        for comp, salt, lead, sid, f, n, x in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
            x = np.frombuffer(x.as_py(), np.uint64)
            if (comp, salt) != now:
                now, leaders = (comp, salt), []
            if lead == 0:
                leaders.append((f, x))
                continue
            equal = [len(np.intersect1d(x, y, assume_unique=True)) for _, y in leaders]
            at = next((i for i, (e, (_, y)) in enumerate(zip(equal, leaders, strict=True)) if alike(e, len(x), len(y))), None)
            out.append((comp, sid, f, n, at, None if at is None else leaders[at][0], [1 - e / (len(x) + len(y) - e) for e, (_, y) in zip(equal, leaders, strict=True)]))
        if len(out) >= 2000:
            yield made()
            out = []
    yield made()


def _large(sets: DataFrame, whole: int) -> DataFrame:
    """Links of groups too large for one task; ``sets`` (comp, _sid, f, n, set).

    Each turn measures all members of a group against a few leaders, whose sets go to as many salted parts of the group as
    it has weight.  Members within 0.2 of a leader are
    linked to it and leave.  Jaccard distance is a metric, so one that left at distance p links to one not of
    its leader at distance q only if q - p is at most 0.2; such pairs are compared.  The rest goes on until it
    fits a task; what is left after the last turn is compared pair by pair.
    """
    fits = F.expr("5 * n >= 4 * n2 and 5 * n2 >= 4 * n")
    found, left = None, sets
    for turn in range(TURNS):
        draw = [F.min(F.struct(F.xxhash64("_sid", F.lit(LEADERS * turn + i)).alias("h"), "_sid"))["_sid"] for i in range(LEADERS)]
        drawn = left.groupBy("comp").agg(F.array_distinct(F.array(*draw)).alias("l"), F.ceil(F.sum("n") / F.lit(whole)).cast("int").alias("parts"))
        drawn = materialise(drawn, "drawn")
        if drawn.isEmpty():
            break
        named = drawn.select("comp", "parts", F.explode("l").alias("_sid"))
        leaders = left.join(named, ["comp", "_sid"]).select("comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("lead"), "_sid", "f", "n", "set")
        members = left.join(drawn.select("comp", "parts"), "comp").select("comp", F.pmod(F.xxhash64("_sid"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("lead"), "_sid", "f", "n", "set")
        dealt = leaders.unionByName(members).repartition("comp", "salt").sortWithinPartitions("comp", "salt", "lead", "_sid")
        rated = materialise(dealt.mapInArrow(_rate, RATED), "rated")
        new = rated.where("at is not null").select(F.col("f").alias("u"), F.col("to").alias("v"))
        gone = rated.where("at is not null").select("comp", "at", F.col("_sid").alias("a"), "n", F.get("far", "at").alias("p"), F.col("far").alias("far_a")).where("p > 0")
        others = rated.select("comp", F.col("_sid").alias("b"), F.col("n").alias("n2"), F.col("at").alias("own"), F.col("far").alias("far_b"), F.posexplode("far").alias("at", "q"))
        others = others.where((F.col("q") <= 2 * _FAR) & ~F.col("at").eqNullSafe(F.col("own")))
        close = F.forall(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x - y) <= _FAR), lambda ok: ok)
        pairs = gone.join(others, ["comp", "at"]).where(fits & (F.col("q") - F.col("p") <= _FAR) & close).select("a", "b")
        new = new.unionByName(_compared(pairs, sets))
        rest = rated.where("at is null").select("comp", "_sid", "n")
        weight = rest.groupBy("comp").agg(F.sum("n").alias("w"))
        rest = materialise(sets.join(rest.join(weight, "comp").select("_sid", "w"), "_sid").select("comp", "_sid", "f", "n", "w", "set"), "rest")
        # A turn's links are written before the next begins, so plans do not grow with turns.
        found = append(new.unionByName(_together(rest.where(F.col("w") <= whole))), found, "near")
        left = rest.where(F.col("w") > whole).drop("w")
    else:
        narrow = left.select("comp", F.col("_sid").alias("a"), "n")
        pairs = narrow.join(left.select("comp", F.col("_sid").alias("b"), F.col("n").alias("n2")), "comp").where((F.col("a") < F.col("b")) & fits).select("a", "b")
        found = append(_compared(pairs, sets), found, "near")
    return found


def near_links(docs: DataFrame, prints: DataFrame, words: int, whole: int = WHOLE) -> DataFrame:
    """(u, v): fingerprints of rows of ``docs`` (``prints``: :func:`with_bands` of them) whose sets of shingles are alike,
    as a forest that joins what all such pairs of a group would."""
    some = prints.where("_n > 0")
    entries = materialise(some.groupBy("_sid").agg(F.min("_fp").alias("f"), F.first("_n").alias("n"), F.min("_th").alias("_th"), F.first("_keys").alias("keys")), "entries")
    same = some.select("_sid", "_fp").distinct().join(entries.select("_sid", "f"), "_sid").where("_fp <> f").select(F.col("_fp").alias("u"), F.col("f").alias("v"))
    keys = entries.select(F.explode("keys").alias("key"), "_sid")
    first = keys.groupBy("key").agg(F.min("_sid").alias("lead"), F.max("_sid").alias("last")).where("lead <> last").select("key", "lead")
    groups = connected_components(keys.join(first, "key").select(F.col("_sid").alias("u"), F.col("lead").alias("v")))
    members = groups.select(F.col("node").alias("_sid"), F.col("root").alias("comp")).join(entries.select("_sid", "f", "n", "_th"), "_sid")
    weight = members.groupBy("comp").agg(F.sum("n").alias("w"))
    members = materialise(members.join(weight, "comp").select("comp", "_sid", "f", "n", "_th", "w"), "members")
    sets = materialise(_sets(docs, members, words).join(members, "_sid").select("comp", "_sid", "f", "n", "w", "set"), "sets")
    found = same.unionByName(_together(sets.where(F.col("w") <= whole)))
    large = sets.where(F.col("w") > whole).drop("w")
    return found if large.isEmpty() else found.unionByName(_large(large, whole))


def components(prints: DataFrame, bucket: int = 4096, more: DataFrame | None = None) -> DataFrame:
    """(fp, first, first_fp) of every fingerprint in ``prints`` (doc_id, _fp): the smallest doc_id
    reachable, and the smallest fingerprint it has.  ``more``: further links (u, v)."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_fp").alias("f"))
    fps = materialise(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("m")), "distinct")
    found = links(fps.select("fp"), bucket)
    if more is not None:
        found = found.unionByName(more)
    roots = connected_components(found)
    with_root = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = with_root.groupBy("root").agg(F.min("m").alias("w"))
    return with_root.join(whole, "root").select("fp", F.col("w.d").alias("first"), F.col("w.f").alias("first_fp"))


def op6_simhash(docs: DataFrame, words: int = 3, bucket: int = 4096) -> DataFrame:
    """Every document's fingerprint and component."""
    prints = with_fingerprint(docs, words)
    c = components(prints, bucket)
    out = prints.join(c, prints["_fp"] == c["fp"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def dedup_stage(docs: DataFrame, words: int = 5, bucket: int = 4096) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays (the smallest doc_id), whole.

    Linked are fingerprints within 3 bits, and texts whose sets of shingles have a Jaccard similarity of 0.8
    or more.  Rows without doc_id stay only where their group has no other.  Of rows that share that doc_id and their fingerprint
    the text of least hash stays, and of equal rows one.
    """
    prints = with_bands(docs, words)
    c = components(prints.select("doc_id", "_fp"), bucket, near_links(docs, prints, words))
    keep = c.where("fp = first_fp").select(F.col("fp").alias("_fp"), F.col("first").alias("_first"))
    mine = prints.select("doc_id", "_fp", "_th").join(keep, "_fp").where(F.col("doc_id").eqNullSafe(F.col("_first")))
    kept = mine.groupBy("doc_id", "_fp").agg(F.min("_th").alias("_th")).select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("_k"), "_th")
    rows = docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("_k"), text_hash().alias("_th"), whole_row(docs).alias("_row"))
    once = rows.join(kept, ["_k", "_th"], "left_semi").groupBy("_k", "_th").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return once.select("_row.*")
