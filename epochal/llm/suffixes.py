"""Suffix-array dedup: remove what repeats a window of ``WINDOW`` bytes of a smaller document.

A document loses each byte covered by a 50-byte window that also starts in a document with
a smaller doc_id.  Windows are grouped by a depth-limited radix sort: suffixes are ordered
only through the threshold, by most-significant-digit passes, and suffixes that are still
equal after the last digit are exactly the repeated windows.  Every decision is made on bytes; hashes only deal
windows out, and a collision costs time, nothing else.

A suffix's first digit is its anchor: among the 12-byte grams of its window the one of least hash.  Consecutive windows
with one anchor form a run, which travels as one entry: its bytes with document and place.
Entries are dealt to buckets by the anchor's hash, and in a bucket

1. entries are ordered by the anchor's bytes; an anchor that is there once repeats nothing;
2. of entries with equal bytes those of the smallest document stay, the others are removed whole;
3. where an anchor still has entries of several kinds, their suffixes are radix-sorted: by the anchor's place in
   the window, then by the window's bytes, eight a digit, dropping a suffix as soon as it is alone.

Equal runs within ``FLUSH`` bytes of text are met at once, so a group of copies sends one entry each so often.  Grams that
stand in ever different surroundings in over a hundredth of the documents would make poor digits: they are found in a
sample of documents and are no anchors wherever a window has another gram.  The sample has a say in the dealing only; results
are the same with any.  A bucket takes some ``BUCKET`` bytes of text; one that comes to over ``CROWD`` all the same is not
held: its windows become entries of their own, dealt by the hash of the whole window, in a second pass.
Buckets and partitions grow in number with the input.  What is removed goes back to the documents as places, dealt
by document; texts move once, to their answers.

Null or empty text: no bytes, nothing removed.  Texts under 50 bytes keep all.  Rows with
one doc_id do not remove from each other.  Rows without doc_id neither lose nor remove.  Repeated rows are answered
each.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, passes, release, small

WINDOW, GRAM = 50, 12
SPREAD = WINDOW - GRAM + 1
PIECE, FLUSH, BUCKET, CROWD = 1 << 20, 16 << 20, 6 << 20, 64 << 20
#: Partitions at most.
PARTITIONS = 20_000
#: Bits of a gram's hash that say whether it is crowded.
CROWD_BITS = 22
_P = 0x5851F42D4C957F2D
_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, and those of the inverse; made once a worker."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, PIECE * 2 + 2 * WINDOW)
        _POW[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))).astype(np.uint64)) for base in (_P, pow(_P, -1, 1 << 64))]
    return _POW[0], _POW[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


class Runs:
    """Runs of the windows of some texts laid end to end.

    doc: index of the text; low, high: first and last window, at: anchor (places in ``a``); anchor, body: hashes."""

    def __init__(self, texts: list[bytes], offsets: list[int], crowded: np.ndarray | None = None):
        self.a = a = np.frombuffer(b"".join(texts), np.uint8)
        self.texts, self.offsets = texts, offsets
        power, self.inv = _powers(len(a) + WINDOW)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_TABLE[a] * power[: len(a)], out=self.sums[1:])
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        gram = _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inv[: len(a) - GRAM + 1]) >> np.uint64(1)
        if crowded is not None:  # these come after all others
            gram |= passes(crowded, CROWD_BITS, gram << np.uint64(1)).astype(np.uint64) << np.uint64(63)
        # Leftmost least gram of each window, by doubling.
        v, rel, width = gram, np.zeros(len(gram), np.uint8), 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            take = v[step:] < v[:-step]
            rel = np.where(take, rel[step:] + np.uint8(step), rel[:-step])
            v = np.where(take, v[step:], v[:-step])
            width += step
        counts = sizes - WINDOW + 1
        total = int(counts.sum())
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        s = np.arange(total) + np.repeat(self.starts - first, counts)
        at = s + rel[s]
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(s) != 1))
        lo, hi = np.concatenate(([0], cut + 1)), np.concatenate((cut, [total - 1]))
        self.low, self.high, self.at = s[lo], s[hi], at[lo]
        self.doc = np.searchsorted(self.starts, self.low, side="right") - 1
        self.anchor = gram[at[lo]]
        self.body = self.hashed(self.low, self.high + WINDOW)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end: of content alone, wherever it stands."""
        return _mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64) * np.uint64(_P))


def laid_out(texts: list[bytes], crowded: np.ndarray | None = None) -> Iterator[tuple[list[int], Runs]]:
    """Runs of all texts, about PIECE bytes at a time; longer texts in pieces that overlap by a window."""
    ids: list[int] = []
    group: list[bytes] = []
    offsets: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1] if len(t) > PIECE else t
            if len(part) < WINDOW:
                continue
            if group and size + len(part) > PIECE:
                yield ids, Runs(group, offsets, crowded)
                ids, group, offsets, size = [], [], [], 0
            ids.append(i)
            group.append(part)
            offsets.append(at)
            size += len(part)
            if len(t) <= PIECE:
                break
    if group:
        yield ids, Runs(group, offsets, crowded)


def same_bytes(a: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes of ``a`` at ``one`` those at ``two``?  ``a`` ends in eight spare bytes."""
    view = np.lib.stride_tricks.sliding_window_view(a, 8)
    ok = np.ones(len(one), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        pick = np.flatnonzero(ok & (size > k))
        x = np.ascontiguousarray(view[one[pick] + k]).view("<u8").ravel() ^ np.ascontiguousarray(view[two[pick] + k]).view("<u8").ravel()
        rest = np.minimum(size[pick] - k, 8).astype(np.uint64)
        ok[pick] = (x << (np.uint64(64) - np.uint64(8) * rest)) == 0
    return ok


class Entries:
    """Runs to be dealt: document (id, low half of its text's hash), place in it, length, place of the anchor in the run, bytes."""

    KINDS = (("id", "<i8"), ("th", "<u4"), ("pos", "<u4"), ("size", "u1"), ("rel", "u1"))

    def __init__(self, id, th, pos, size, rel, a, start):  # noqa: A002
        self.id, self.th, self.pos, self.size, self.rel, self.a, self.start = id, th, pos, size, rel, a, start

    def __len__(self) -> int:
        return len(self.id)

    def take(self, at: np.ndarray) -> Entries:
        return Entries(*(getattr(self, k)[at] for k, _ in self.KINDS), self.a, self.start[at])

    def bodies(self) -> np.ndarray:
        """All their bytes, one after another: rows as wide as the longest, cut to size."""
        most = int(self.size.max(initial=1))
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.a, np.zeros(most, np.uint8))) if len(self.a) < int(self.start.max(initial=0)) + most else self.a, most)
        return wide[self.start][np.arange(most) < self.size[:, None]]

    def pack(self) -> bytes:
        import zstandard

        parts = [np.uint32(len(self)).tobytes(), *(getattr(self, k).astype(t).tobytes() for k, t in self.KINDS), self.bodies().tobytes()]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))

    @classmethod
    def together(cls, parts: list[Entries]) -> Entries:
        """Several as one, over their texts laid end to end (and some spare bytes)."""
        at = np.cumsum([0, *(len(p.a) for p in parts[:-1])])
        columns = [np.concatenate([getattr(p, k) for p in parts]) for k, _ in cls.KINDS]
        return cls(*columns, np.concatenate([*(p.a for p in parts), np.zeros(2 * WINDOW, np.uint8)]), np.concatenate([p.start + o for p, o in zip(parts, at, strict=True)]))

    def hashes(self) -> np.ndarray:
        """A hash of each entry's bytes."""
        power, inverse = _powers(len(self.a) + 1)
        sums = np.zeros(len(self.a) + 1, np.uint64)
        np.cumsum(_TABLE[self.a] * power[: len(self.a)], out=sums[1:])
        end = self.start + self.size
        return _mix((sums[end] - sums[self.start]) * inverse[self.start] + self.size.astype(np.uint64) * np.uint64(_P))

    def windows(self) -> Entries:
        """Each window as an entry of its own."""
        n = self.size.astype(np.int64) - WINDOW + 1
        owner = np.repeat(np.arange(len(self)), n)
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return Entries(self.id[owner], self.th[owner], self.pos[owner] + shift.astype(self.pos.dtype), np.full(len(owner), WINDOW, self.size.dtype), (self.rel[owner] - shift).astype(self.rel.dtype), self.a, self.start[owner] + shift)

    def dealt(self, deal: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of packed entries by bucket of ``deal``."""
        bucket = ((deal >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        e, bucket = self.take(order), bucket[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist() if len(bucket) else [0]
        for i in range(0, len(cut) - 1, 256):
            yield _rows([(int(bucket[s]), None, e.take(np.arange(s, t)).pack()) for s, t in zip(cut[i : i + 256], cut[i + 1 : i + 257])])

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Entries:
        import zstandard

        columns, bodies = [[] for _ in cls.KINDS], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
            for c, (_, t) in zip(columns, cls.KINDS, strict=True):
                c.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            bodies.append(raw[at:])
        a = np.frombuffer(b"".join([*bodies, bytes(8)]), np.uint8)
        id, th, pos, size, rel = (np.concatenate(c) for c in columns)  # noqa: A001
        ends = np.cumsum(size.astype(np.int64))
        return cls(id, th, pos, size, rel, a, ends - size)


ROW = "bucket int, q int, data binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("q", pa.int32()), ("data", pa.binary())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)


class Answers:
    """Stretches to remove (id, th, start, size), gathered and sent off by the group of documents they go to."""

    KINDS = (("id", "<i8"), ("th", "<u4"), ("start", "<u4"), ("size", "u1"))

    def __init__(self, groups: int, most: int = 1 << 20):
        self.groups, self.most, self.held, self.n = groups, most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(tuple(c.astype(t) for c, (_, t) in zip(columns, self.KINDS, strict=True)))
            self.n += len(columns[0])
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        if not self.held:
            return
        id, th, start, size = (np.concatenate(c) for c in zip(*self.held, strict=True))  # noqa: A001
        self.held, self.n = [], 0
        q = group_of(id, th, self.groups)
        order = np.lexsort((start, th, id, q))
        id, th, start, size, q = id[order], th[order], start[order], size[order], q[order]  # noqa: A001
        cut = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1, [len(q)]))
        pack = lambda s, e: zstandard.ZstdCompressor(level=1).compress(b"".join((np.uint32(e - s).tobytes(), *(c[s:e].tobytes() for c in (id, th, start, size)))))
        for i in range(0, len(cut) - 1, 4096):
            yield _rows([(-1, int(q[s]), pack(s, e)) for s, e in zip(cut[i : i + 4096].tolist(), cut[i + 1 : i + 4097].tolist())])

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        import zstandard

        columns = [[np.zeros(0, t)] for _, t in cls.KINDS]
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
            for c, (_, t) in zip(columns, cls.KINDS, strict=True):
                c.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
        return tuple(np.concatenate(c) for c in columns)


def group_of(id: np.ndarray, th: np.ndarray, groups: int) -> np.ndarray:  # noqa: A002
    """The group of documents that (id, th) belongs to; :func:`group_column` says the same in Spark."""
    low = (id.astype(np.int64) ^ th.astype(np.int64)) & 0xFFFFFFFF
    return ((low >> 16) * 40503 + low) % groups


def group_column(groups: int):
    low = F.col("doc_id").bitwiseXOR(F.col("th")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.shiftright(low, 16) * F.lit(40503) + low, F.lit(groups)).cast("int")


def _entries(ids: np.ndarray, ths: np.ndarray, at: list[int], r: Runs) -> Entries:
    """Entries of some texts' runs."""
    text = np.asarray(at)[r.doc]
    pos = r.low - r.starts[r.doc] + np.asarray(r.offsets)[r.doc]
    return Entries(ids[text], ths[text].astype(np.uint32), pos.astype(np.uint32), (r.high - r.low + WINDOW).astype(np.uint8), (r.at - r.low).astype(np.uint8), r.a, r.low)


def _late(e: Entries, body: np.ndarray) -> np.ndarray:
    """Which entries repeat the bytes of one of a smaller document here, by place."""
    order = np.lexsort((e.id, body))
    same = (body[order][1:] == body[order][:-1]) & (e.size[order][1:] == e.size[order][:-1])
    if not same.any():
        return np.zeros(0, np.int64)
    first = order[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))]
    late = np.flatnonzero(e.id[order] > e.id[first])
    one, two = order[late], first[late]
    return one[same_bytes(e.a, e.start[one], e.start[two], e.size[one].astype(np.int64))]


def _deal(buckets: int, groups: int, crowded: np.ndarray | None = None, flush: int = FLUSH):
    """Texts to entries by bucket; runs that repeat within ``flush`` bytes of text are answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, held, size = Answers(groups), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            e, body, deal = Entries.together([x for x, _, _ in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
            held.clear()
            late = _late(e, body)
            yield from answers.add(e.id[late], e.th[late], e.pos[late], e.size[late])
            left = np.ones(len(e), bool)
            left[late] = False
            yield from e.take(np.flatnonzero(left)).dealt(deal[left], buckets)

        for b in small(batches):
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy() & 0xFFFFFFFF
            for at, r in laid_out(b.column(2).to_pylist(), crowded):
                held.append((_entries(ids, ths, at, r), r.body, r.anchor))
                size += len(r.a)
                if size >= flush:
                    yield from out()
                    size = 0
        if held:
            yield from out()
        yield from answers.flush()

    return run


def _by_window(buckets: int, groups: int):
    """Entries of crowded buckets, window by window: by the hash of the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(groups)
        for b in batches:
            for data in b.column(2).to_pylist():
                e = Entries.unpack([data]).windows()
                for s in range(0, len(e), 1 << 19):
                    part = e.take(np.arange(s, min(len(e), s + (1 << 19))))
                    body = part.hashes()
                    late = _late(part, body)
                    yield from answers.add(part.id[late], part.th[late], part.pos[late], part.size[late])
                    left = np.ones(len(part), bool)
                    left[late] = False
                    yield from part.take(np.flatnonzero(left)).dealt(body[left], buckets)
        yield from answers.flush()

    return run


def _crowded(known: np.ndarray | None):
    """(gram, n): of each megabyte of a sample, the anchors that stand in two kinds of runs or more, by the bits that name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for _, r in laid_out(b.column(0).to_pylist(), known):
                kinds = np.unique(np.stack((r.anchor << np.uint64(1) >> np.uint64(64 - CROWD_BITS), r.body), 1), axis=0)[:, 0]
                gram, n = np.unique(kinds, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

    return run


def equal_suffixes(a: np.ndarray, suffix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited radix sort: (suffix, group) of the suffixes of ``a`` whose first WINDOW bytes stand
    more than once in their group.  Each pass orders by the next digit of eight bytes (the last: two)
    within the groups so far and drops suffixes that are alone.  ``a`` ends in eight spare bytes."""
    view = np.lib.stride_tricks.sliding_window_view(a, 8)
    for depth in (None, *range(0, WINDOW, 8)):
        if depth is None:
            digit = np.zeros(len(suffix), np.uint64)
        else:
            digit = np.ascontiguousarray(view[suffix + depth]).view(">u8").ravel().astype(np.uint64)
            if WINDOW - depth < 8:
                digit >>= np.uint64(8 * (8 - (WINDOW - depth)))
        order = np.lexsort((digit, group)) if depth is not None else np.argsort(group, kind="stable")
        suffix, group, digit = suffix[order], group[order], digit[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))) if len(suffix) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] < 2 if len(group) else np.zeros(0, bool)
        suffix, group = suffix[~alone], group[~alone]
    return suffix, group


def repeated(e: Entries) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, th, start, size) of what the entries of a bucket lose."""
    view = np.lib.stride_tricks.sliding_window_view(e.a, 8)
    word = lambda start: np.ascontiguousarray(view[start]).view(">u8").ravel().astype(np.uint64)
    # The anchor's bytes; entries alone with theirs repeat nothing.
    digits = [word(e.start + e.rel + k) >> np.uint64(8 * max(0, k + 8 - GRAM)) for k in range(0, GRAM, 8)]
    order = np.lexsort(digits[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for d in digits:
        d = d[order]
        new[1:] |= d[1:] != d[:-1]
    anchor = np.cumsum(new) - 1
    many = np.bincount(anchor)[anchor] > 1
    e, anchor = e.take(order[many]), anchor[many]
    if not len(e):
        return
    # Kinds of equal bytes, numbered as they come; an anchor's entries stand together, and so do its kinds' numbers.
    raw, known = e.a.tobytes(), {}
    kind = np.fromiter((known.setdefault(raw[s:t], len(known)) for s, t in zip(e.start.tolist(), (e.start + e.size).tolist(), strict=True)), np.int64, len(e))
    n_kinds = len(known)
    del raw, known
    least = np.full(n_kinds, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, e.id)
    late = e.id > least[kind]
    yield e.id[late], e.th[late], e.pos[late], e.size[late]
    e, kind, anchor = e.take(np.flatnonzero(~late)), kind[~late], anchor[~late]
    # One entry of each kind stands for it in the byte passes, where its anchor has other kinds.
    shown = np.unique(kind, return_index=True)[1]
    kinds_of = np.bincount(anchor[shown], minlength=int(anchor.max()) + 1)
    shown = shown[kinds_of[anchor[shown]] > 1]
    if not len(shown):
        return
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], np.arange(n_kinds + 1))
    share = np.cumsum(e.size[shown].astype(np.int64) - WINDOW + 1) >> 19
    # At most some half a million suffixes at a time, whole anchors together.
    part = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(anchor[shown]) != 0)), share, 0))
    for p in np.unique(part):
        pick = shown[part == p]
        n = e.size[pick].astype(np.int64) - WINDOW + 1
        owner = np.repeat(pick, n)
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        group = anchor[owner].astype(np.int64) * 256 + e.rel[owner] - shift
        at, group = equal_suffixes(e.a, e.start[owner] + shift, group)
        if not len(at):
            continue
        # Which entry a suffix lies in: entries that are shown do not overlap.
        by = pick[np.argsort(e.start[pick])]
        owner = by[np.searchsorted(e.start[by], at, side="right") - 1]
        low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, e.id[owner])
        gone = e.id[owner] > low[group]
        owner, shift = owner[gone], (at - e.start[owner])[gone]
        order2 = np.lexsort((shift, owner))
        owner, shift = owner[order2], shift[order2]
        if not len(owner):
            continue
        edge = np.concatenate(([True], (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1] + 1)))
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(owner)) - 1
        # The same stretch goes from every entry of the kind (all of one document).
        k = kind[owner[first]]
        count = begin[k + 1] - begin[k]
        every = order[np.repeat(begin[k] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
        yield e.id[every], e.th[every], e.pos[every] + np.repeat(shift[first], count), np.repeat(shift[last] - shift[first] + WINDOW, count)


def _sort(groups: int, crowd: int | None = CROWD):
    """Rows sorted by bucket: answers pass; each bucket's entries are sorted together.  Those of a bucket of over ``crowd`` packed
    bytes pass as they are, with bucket -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, now, blobs, size = Answers(groups), None, [], 0
        for b in batches:
            passed = []
            for bucket, q, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket < 0:
                    passed.append((bucket, q, data))
                    continue
                if bucket != now:
                    if blobs:
                        for found in repeated(Entries.unpack(blobs)):
                            yield from answers.add(*found)
                    now, blobs, size = bucket, [], 0
                size += len(data)
                blobs.append(data)
                if crowd is not None and size > crowd:
                    yield _rows([(-2, None, x) for x in blobs])
                    blobs = []
            if passed:
                yield _rows(passed)
        if blobs:
            for found in repeated(Entries.unpack(blobs)):
                yield from answers.add(*found)
        yield from answers.flush()

    return run


def spans(size: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(start, end) of each maximal stretch that the given ones cover, from those sorted by start."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    start = start.astype(np.int64)
    reach = np.maximum.accumulate(start + length)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.stack((start[new], reach[np.append(new[1:], len(start)) - 1]), 1)


OUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed for the way to their answers."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in small(batches):
        packed = pa.array([z.compress(t.as_py()) for t in b.column(4)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], packed], ["q", "kind", "doc_id", "th", "data"])


def _finish(digest: bool):
    """Rows (q, kind, doc_id, th, data) sorted by (q, kind): answers of a group of documents, then their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        now, blobs, known, rows, size = None, [], None, [], 0
        for b in batches:
            for q, kind, doc, th, data in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), strict=True):
                if q != now:
                    now, blobs, known = q, [], None
                if kind == 0:
                    blobs.append(data.as_py())
                    continue
                if known is None:
                    id, half, start, length = Answers.unpack(blobs)  # noqa: A001
                    order = np.lexsort((start, half, id))
                    id, half, start, length, blobs = id[order], half[order], start[order], length[order], []  # noqa: A001
                    new = np.flatnonzero(np.concatenate(([True], (id[1:] != id[:-1]) | (half[1:] != half[:-1])))) if len(id) else np.zeros(0, np.int64)
                    known = {(i, h): (s, e) for i, h, s, e in zip(id[new].tolist(), half[new].tolist(), new.tolist(), [*new[1:].tolist(), len(id)][: len(new)], strict=True)}
                text = plain.decompress(data.as_py())
                s, e = known.get((doc, th & 0xFFFFFFFF), (0, 0))
                cut = spans(len(text), start[s:e], length[s:e])
                kept = b"".join(text[x:y] for x, y in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(text)], strict=True)) if len(cut) else text
                if digest:
                    rows.append((doc, len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((doc, len(text), [{"start": x, "end": y} for x, y in cut.tolist()], kept))
                    size += len(kept)
                if len(rows) >= 2000 or size > PIECE * 8:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        if digest:
            kinds, names = [pa.int64()] * 4 + [pa.string()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        else:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "removed", "kept"]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def crowded_grams(texts: DataFrame, total: int, n: int, sample: int = 16 << 20, rounds: int = 2) -> np.ndarray | None:
    """A bitmap (half a megabyte) of grams that are anchors in over a hundredth of the documents of a sample (some ``sample`` bytes) in
    different runs; the second round finds what takes their place."""
    every = max(1, total // sample)
    some = texts.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(every)) == 0).select("text")
    flags = np.zeros(1 << CROWD_BITS, np.uint8)
    bits = None
    for _ in range(rounds):
        found = some.mapInArrow(_crowded(bits), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64, n // every // 100))
        grams = found.select("gram").toPandas()["gram"].to_numpy(dtype=np.int64)  # a document has a bounded number of anchors a byte: a hundred times that
        if not len(grams):
            break
        flags[grams] = 1
        bits = np.packbits(flags, bitorder="little")
    return bits


def repeats(docs: DataFrame, digest: bool = False, bucket: int = BUCKET, crowd: int = CROWD, flush: int = FLUSH) -> DataFrame:
    """Each document's removed stretches and what is left of it (or the digests of op10)."""
    bounded(docs.sparkSession)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    known = text.where(F.col("doc_id").isNotNull())
    total, n = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    # Buckets and groups stream by, so a partition may hold any number of them: partitions stop growing where the driver's tables of them would not fit.
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20)), PARTITIONS)
    buckets, groups = max(parts, total // bucket + 1), max(2 * parts + 1, total // (32 << 20))
    deal = F.when(F.col("bucket") < 0, F.coalesce("q", F.lit(0))).otherwise(F.col("bucket"))

    def dealt(rows: DataFrame, by) -> DataFrame:
        """Evenly: what ``by`` numbers goes to partitions in turn."""
        return rows.repartitionById(parts, F.pmod(by, F.lit(parts)).cast("int"))

    def sorted_in(rows: DataFrame, most: int | None) -> DataFrame:
        return dealt(rows, deal).sortWithinPartitions("bucket").mapInArrow(_sort(groups, most), ROW)

    first = materialise(sorted_in(known.mapInArrow(_deal(buckets, groups, crowded_grams(known, total, n), flush), ROW), crowd), "answers")
    release(docs.sparkSession)  # the entries' shuffle files, before texts are shuffled
    answers = first.where("bucket = -1").select("q", "data")
    over = first.where("bucket = -2")
    if not over.isEmpty():
        answers = answers.unionByName(sorted_in(over.mapInArrow(_by_window(max(buckets, 4 * parts), groups), ROW), None).select("q", "data"))
    none = F.lit(None).cast("long")
    rows = answers.select("q", F.lit(0).alias("kind"), none.alias("doc_id"), none.alias("th"), "data").unionByName(
        known.select(group_column(groups).alias("q"), F.lit(1).alias("kind"), "doc_id", "th", F.col("text").alias("data")).mapInArrow(_squeeze, "q int, kind int, doc_id long, th long, data binary")
    )
    out = dealt(rows, F.col("q")).sortWithinPartitions("q", "kind").mapInArrow(_finish(digest), DIGEST if digest else OUT)
    rest = text.where(F.col("doc_id").isNull())
    if digest:
        zero = F.lit(0).cast("long")
        rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    else:
        rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("removed"), F.col("text").alias("kept"))
    return out.unionByName(rest)


def op10_suffixes(docs: DataFrame) -> DataFrame:
    return repeats(docs, digest=True)
