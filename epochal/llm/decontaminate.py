"""Benchmark decontamination by spaced-seed hashing.

An item of 10 or more words contaminates a document where a stretch of words laid against it agrees in
over four of five words, with at least 12 equal (four fifths of the item's, rounded up, for items
under 15 words).  Items of 6 to 9 words may have one word changed or left off at an end; items of 5 are
sought whole; an item of fewer words says too little to be sought within a text, and counts where it is a whole text.

Fixed masks ignore selected positions of ten words.  The nine masks here ignore every pair of
positions between them, and a tenth takes six words running.  A stretch as above has ten words with at
most two changed, or six unchanged ones running (where three changed words stand together in the middle of
16 to 19): so whatever the rule finds has a seed in common with its item.  Texts get blank words at
both ends, so that a seed may reach over them.  Short items have masks of their own, for the lengths there are.

Seeds of items are joined to those of documents.  Where all the benchmark's seeds (with their
places) are within ``most_seeds``, they are broadcast as a sorted array (24 bytes each, behind a
bitmap) and joined in the scan, and so are the words, to be compared around each hit; nothing is shuffled.
A larger benchmark sends the document's seeds that a bitmap of two slots lets pass to an
ordinary join; the texts that it finds are fetched in a second scan and compared there.  Both give the same rows.

Null or empty texts and items hit nothing.  Repeated rows and items are each compared.
A document is known by doc_id and a hash of its text, so rows that share an id or have
none are judged each by their own text.  Empty tables give no rows; other columns are not read, and the
stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bounded, materialise, passes, small, whole_row
from .tokens import many, mix, word_hashes

#: Each pair of the ten positions is ignored (0) by one of the nine; the last takes six words running.
MASKS = ("0010011111", "0100110111", "0110101101", "0110111010", "1001101011", "1011110100", "1101011001", "1101110010", "1111000110", "111111")
SPAN, SHORTEST, LEAST = 10, 5, 12
#: Blank words put before and behind a text: more than any mask ignores, taken together.
PAD = 3
_BLANK = np.uint64(0x5EED)
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & ((1 << 64) - 1) | 1) for i in range(SPAN)]


def least_equal(size: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Equal words that contaminate, by an item's size."""
    return np.where(size < 6, size, np.minimum(least, -(-size * 4 // 5)))


def masks_of(size: int) -> list[tuple[int, list[int]]]:
    """(number, positions looked at) of the masks for items of a size; all sizes from SPAN on share theirs."""
    if size >= SPAN:
        return [(m, [i for i, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
    if size <= SHORTEST:
        return [(100 * size, list(range(size)))]
    return [(100 * size + part, [i for i in range(size) if i % 3 != part]) for part in range(3)]


def seeds(w: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Hashes of windows of words by place, for each mask of ``sizes``, and the size."""
    turned = [w * o for o in _ODD]
    for size in sizes:
        for number, ones in masks_of(size):
            n = len(w) - (ones[-1] if size >= SPAN else size - 1)
            if n > 0:
                h = np.full(n, np.uint64(number * 7919 + 1))
                for i in ones:
                    h += turned[i][i : i + n]
                yield mix(h), size


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with blanks around each, and where each begins."""
    blank = np.full(PAD, _BLANK) * np.arange(1, PAD + 1, dtype=np.uint64)
    parts, starts, at = [], [], 0
    for w in texts:
        parts += [blank, w, blank + np.uint64(9)]
        starts.append(at + PAD)
        at += len(w) + 2 * PAD
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(starts, np.int64)


ITEM = "item_id long, ikey long, ipos int, seed long, words array<long>, size int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in small(batches, 1 << 18):
        rows = []
        for i, w in zip(b.column(0).to_pylist(), many(b.column(1).to_pylist()), strict=True):
            if not len(w):
                continue
            key = xxhash.xxh64_intdigest(repr(i).encode() + w.tobytes()) >> 1  # items that share an id, or have none, stay apart
            rows.append((i, key, -1, 0, w.view(np.int64).tolist(), len(w)))  # the item itself
            for h, _ in seeds(w, [min(len(w), SPAN)]):
                rows += [(i, key, p, s, None, len(w)) for p, s in enumerate(h.view(np.int64).tolist())]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in ITEM.split(", ")])


def best_stretch(equal: np.ndarray) -> int:
    """The most equal words in any stretch with a positive sum of +1 for an equal word and -4 for another."""
    same = np.concatenate(([0], np.cumsum(equal, dtype=np.int64)))
    total = 5 * same - 4 * np.arange(len(same))
    # The earliest start whose sum lies below that of the end gives the longest stretch to each end.
    start = np.searchsorted(-np.minimum.accumulate(total), -total, side="right")
    end = np.flatnonzero(start < np.arange(len(same)))
    return int((same[end] - same[start[end]]).max(initial=0))


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Equal words of the best stretch with the item laid at ``shift``; an item under SHORTEST counts as the whole text only."""
    if len(item) < SHORTEST:
        return len(item) if len(text) == len(item) and (text == item).all() else 0
    lo, hi = max(shift, 0), min(shift + len(item), len(text))
    if hi - lo < least_equal(np.array(len(item))):
        return 0
    equal = text[lo:hi] == item[lo - shift : hi - shift]
    if len(item) < SPAN:  # one word may differ, wherever it is
        return int(equal.sum())
    return best_stretch(equal)


def hit_places(texts: list[np.ndarray], sizes: list[int], hit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, seed) of the windows of which ``hit`` (of seeds) holds, no row twice."""
    w, starts = padded(texts)
    lengths = np.array([len(t) for t in texts])
    at, found = [], []
    for h, size in seeds(w, sizes):
        if size < SHORTEST:  # whole texts only
            here = starts[lengths == size]
            ok = here[hit(h[here])]
        else:
            ok = np.flatnonzero(hit(h))
        at.append(ok)
        found.append(h[ok])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, found = np.concatenate(at), np.concatenate(found)
    text = np.maximum(np.searchsorted(starts - PAD, at, side="right") - 1, 0)
    return text, at - starts[text], found


class Known:
    """A benchmark in arrays: sorted seeds with item and place, and the items' words."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        made = [(h, np.full(len(h), n), np.arange(len(h))) for n, w in enumerate(words) for h, _ in seeds(w, [min(len(w), SPAN)])]
        seed, item, place = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place, self.ids, self.words = seed[order], item[order], place[order], ids, words
        log_bits = max(20, int(32 * len(seed)).bit_length())
        self.log_bits = log_bits
        slot = seed >> np.uint64(64 - log_bits)
        flags = np.zeros(1 << log_bits, np.uint8)
        flags[slot.astype(np.int64)] = 1
        self.bits = np.packbits(flags, bitorder="little")
        self.sizes = sorted({min(len(w), SPAN) for w in words})

    def holds(self, h: np.ndarray) -> np.ndarray:
        ok = passes(self.bits, self.log_bits, h)
        some = np.flatnonzero(ok)
        at = np.minimum(np.searchsorted(self.seed, h[some]), len(self.seed) - 1)
        ok[some] = self.seed[at] == h[some]
        return ok

    def found(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, item, overlap) of each contaminated text; of equal pairs the largest overlap."""
        if not len(self.seed):
            return
        text, at, h = hit_places(texts, self.sizes, self.holds)
        order = np.argsort(text, kind="stable")
        text, at, h = text[order], at[order], h[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1, [len(text)])) if len(text) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            best: dict[int, int] = {}
            for item, shift in self.lines(at[s:e], h[s:e]):
                n = overlap(texts[text[s]], self.words[item], shift)
                if n >= least_equal(np.array(len(self.words[item]))):
                    best[item] = max(n, best.get(item, 0))
            yield from ((int(text[s]), item, n) for item, n in best.items())

    def lines(self, at: np.ndarray, h: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
        """Distinct (item, shift) of one text's hits, a bounded number of matches at a time."""
        lo, hi = np.searchsorted(self.seed, h), np.searchsorted(self.seed, h, side="right")
        out: set[tuple[int, int]] = set()
        part = np.cumsum(hi - lo) // most
        for p in np.unique(part):
            pick = np.flatnonzero(part == p)
            n = (hi - lo)[pick]
            i = np.repeat(lo[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            pairs = np.unique(np.stack((self.item[i], np.repeat(at[pick], n) - self.place[i]), 1), axis=0)
            out.update(map(tuple, pairs.tolist()))
        return sorted(out)


FOUND = "doc_id long, th long, item_id long, overlap int, size int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def _in_scan(docs: DataFrame, item: DataFrame) -> DataFrame:
    """Overlaps of all documents with a benchmark that is broadcast."""
    whole = item.where("ipos < 0").select("ikey", "item_id", "words").dropDuplicates(["ikey"]).orderBy("ikey").collect()
    shared = docs.sparkSession.sparkContext.broadcast(Known([r["item_id"] for r in whole], [np.array(r["words"], np.int64).view(np.uint64) for r in whole]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in small(batches, 1 << 20):
            ids, th = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [(ids[t], th[t], known.ids[i], n, len(known.words[i])) for t, i, n in known.found(list(many(b.column(2).to_pylist())))]
            yield _found(rows)

    return texts_of(docs).mapInArrow(run, FOUND)


HIT = "doc_id long, th long, pos int, seed long"


def _by_join(docs: DataFrame, item: DataFrame) -> DataFrame:
    """The same by joins: document seeds that three slots of a bitmap let pass, then the texts they lie in."""
    spark = docs.sparkSession
    known = item.where("ipos >= 0").select("ikey", "ipos", "seed").distinct()
    sizes = sorted(r[0] for r in item.where("ipos < 0").select(F.least("size", F.lit(SPAN)).alias("size")).distinct().collect())  # ten at most
    # Two slots a seed: its leading bits, and those of its lower half.
    bits, log_bits = bitmap(known.select(F.explode(F.array("seed", F.shiftleft("seed", 32))).alias("seed")).distinct())
    filters = spark.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = lambda h: passes(filters.value, log_bits, h) & passes(filters.value, log_bits, h << np.uint64(32))
        for b in small(batches, 1 << 20):
            text, at, h = hit_places(list(many(b.column(2).to_pylist())), sizes, ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], [x.split()[0] for x in HIT.split(", ")])

    texts = texts_of(docs)
    lines = texts.mapInArrow(hits, HIT).join(known, "seed").select("doc_id", "th", "ikey", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    lines = materialise(lines, "lines")
    seen, log_seen = bitmap(lines.select(F.col("th").alias("seed")).distinct())
    wanted = spark.sparkContext.broadcast(seen)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ok = passes(wanted.value, log_seen, b.column(1).to_numpy().view(np.uint64))
            yield b.filter(pa.array(ok))

    one = texts.mapInArrow(fetched, "doc_id long, th long, text binary").select("doc_id", "th", F.lit(0).alias("kind"), "text", *(F.lit(None).cast(k).alias(c) for c, k in (("item_id", "long"), ("shift", "int"), ("words", "array<bigint>"))))
    whole = item.where("ipos < 0").select("ikey", "item_id", "words").dropDuplicates(["ikey"])
    two = lines.join(whole, "ikey").select("doc_id", "th", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("text"), "item_id", "shift", "words")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w = None, None
        for b in batches:
            rows = []
            for doc, th, kind, text, i, shift, words in zip(*(b.column(c) for c in range(7)), strict=True):
                name = (doc.as_py(), th.as_py())
                if kind.as_py() == 0:
                    if name != now:
                        now, w = name, word_hashes(text.as_py())
                elif name == now:
                    words = words.values.to_numpy().view(np.uint64)
                    n = overlap(w, words, shift.as_py())
                    if n >= least_equal(np.array(len(words))):
                        rows.append((*name, i.as_py(), n, len(words)))
            yield _found(rows)

    dealt = one.unionByName(two).repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "kind")
    return dealt.mapInArrow(compared, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, most_seeds: int = 1 << 20) -> DataFrame:
    """(doc_id, th, item_id, overlap, size): verified overlaps of documents and items."""
    bounded(docs.sparkSession)
    item = materialise(benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_items, ITEM), "items")
    found = _in_scan(docs, item) if item.count() <= most_seeds else _by_join(docs, item)
    return found.groupBy("doc_id", "th", "item_id").agg(F.max("overlap").alias("overlap"), F.max("size").alias("size"))


def op5_decontaminate(docs: DataFrame, benchmark: DataFrame, most_seeds: int = 1 << 20) -> DataFrame:
    """One row a contaminated document: how many items it overlaps, the longest overlap, and the least item that has it."""
    c = contamination(docs, benchmark, most_seeds)
    return c.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("overlap").alias("overlap"), F.min_by("item_id", F.struct(-F.col("overlap"), F.col("item_id"))).alias("item_id"))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, most_seeds: int = 1 << 20) -> DataFrame:
    """Pipeline stage: the documents that overlap no item; columns unchanged."""
    bad = contamination(docs, benchmark, most_seeds).select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("_k"), F.col("th").alias("_t")).distinct()
    bad = materialise(bad, "found")  # its size is known then: documents are only shuffled where it is large
    rows = docs.select(whole_row(docs).alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull()).alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    return rows.join(bad, ["_k", "_t"], "left_anti").select("_row.*")
