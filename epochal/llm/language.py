"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts of up to ``order`` bytes with the counts of what follows them.  A byte costs
log2((n + q) / count) bits in the longest context of its history that the tree holds, where n bytes of q kinds were seen; a byte
not seen there costs an escape, log2((n + q) / q), and is looked for in the context a byte shorter, down to log2(256) below
the empty one (escape method C, no exclusion; statistics stay frozen).  A text's language is the one with the least code
length.  Lengths are integers, in units of 2^-16 bit, so that sums do not depend on batches or cuts.

The trees of all languages are merged: a byte is looked up by the longest string of context and byte that any language
holds, which has its cost in every language beside it, and escapes above it are differences of sums along the chain
of contexts.  So a byte takes one or two look-ups, however many languages there are.

Learning takes a bounded sample: of each language the ``sample`` documents of least hash of doc_id whose crc32(doc_id as text) mod 5 is not 0
(of rows that share doc_id and language the one of least text hash), whole texts.  Strings are counted by Spark; a model keeps at most ``most``
(language, string) pairs, the most frequent, down to a count that all of it shares.  Prediction covers every whole text;
long ones are cut every ``CHUNK`` bytes, each piece with the bytes before it as context.

Null texts and texts without a letter: `und`, score 0; so is everything where no language could be learned.  Null ids are scored,
not learned from.  Ties go to the smaller language by code point.  Repeated rows are scored each.  An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, forget, materialise, small
from .quality import held_out

CHUNK, UNIT = 1 << 19, 1 << 16
LETTER = r"\p{L}"


def packed(a: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes up to each position as one number with a leading 1 (positions before ``size`` - 1 are void)."""
    out = np.full(len(a), 1, np.uint64)
    for back in range(size - 1, -1, -1):
        out <<= np.uint64(8)
        if back < len(a):
            out[back:] |= a[: len(a) - back]
    return out


def tail(keys: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes of packed strings, packed."""
    return (keys & np.uint64((1 << 8 * size) - 1)) | np.uint64(1 << 8 * size)


class Table:
    """Numbers to their places: one slot a number, those whose slot is taken in a sorted list beside."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        first = np.unique(slot, return_index=True)[1]
        self.key, self.at, self.more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
        self.key[slot[first]], self.at[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more[slot[rest]] = True
        self.rest, self.rest_at = keys[rest], rest

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.at[slot], -1)
        again = np.flatnonzero((out < 0) & self.more[slot])
        if len(again):
            place = np.searchsorted(self.rest, keys[again]).clip(0, len(self.rest) - 1)
            hit = self.rest[place] == keys[again]
            out[again[hit]] = self.rest_at[place[hit]]
        return out


class Forest:
    """The merged context trees.  ``counts``: (language number, string with a leading 1, count) of every kept string of context and byte."""

    def __init__(self, languages: list[str], counts: tuple[np.ndarray, np.ndarray, np.ndarray], order: int):
        self.languages, self.order = languages, order
        who, what, n = counts
        size = np.zeros(len(what), int)
        for k in range(1, order + 2):
            size[(what >> np.uint64(8 * k)) == 1] = k
        bits = lambda x: np.rint(np.log2(x) * UNIT).astype(np.int64)
        self.contexts: list[Table] = []  # by length
        self.above: list[np.ndarray] = []  # (languages, contexts): escapes from a context and all shorter ones
        self.strings: list[Table] = []
        self.cost: list[np.ndarray] = []  # (languages, strings): cost of the byte from its context
        self.context_of: list[np.ndarray] = []
        for k in range(order + 1):
            mine = size == k + 1
            w, s, c = who[mine], what[mine], n[mine]
            strings, at = np.unique(s, return_inverse=True)
            contexts, of = np.unique(strings >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(languages), len(contexts)), np.int64), np.zeros((len(languages), len(contexts)), np.int64)
            np.add.at(total, (w, of[at]), c)
            np.add.at(kinds, (w, of[at]), 1)
            held = kinds > 0
            escape = np.where(held, bits(np.maximum(total + kinds, 1)) - bits(np.maximum(kinds, 1)), 0)
            if k:
                above = escape + self.above[k - 1][:, self.contexts[k - 1].find(tail(contexts, k - 1))]
                below = self.cost[k - 1][:, self.strings[k - 1].find(tail(strings, k))]
            else:
                above, below = escape, np.full((len(languages), len(strings)), 8 * UNIT, np.int64)
            cost = escape[:, of] + below
            cost[w, at] = bits(total[w, of[at]] + kinds[w, of[at]]) - bits(c)
            self.contexts.append(Table(contexts))
            self.above.append(above.astype(np.int32))
            self.strings.append(Table(strings))
            self.cost.append(cost.astype(np.int32))
            self.context_of.append(of)

    def piece(self, a: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(languages, bytes): the cost of each byte; ``place``: how many bytes of its text stand before it here."""
        full = packed(a, self.order + 1)
        found = self.strings[-1].find(full)
        out = self.cost[-1][:, found] if len(self.strings[-1].keys) else np.zeros((len(self.languages), len(a)), np.int32)
        todo = np.flatnonzero((found < 0) | (place < self.order))
        for k in range(self.order, -1, -1):
            able = place[todo] >= k
            rows = todo[able]
            found = self.strings[k].find(tail(full[rows], k + 1))
            hit = found >= 0
            rows, found = rows[hit], found[hit]
            out[:, rows] = self.cost[k][:, found]
            # Where longer contexts are held, escapes from them come on top.
            late = np.flatnonzero(place[rows] > k) if k < self.order else rows[:0]
            self._escapes(full, place, rows[late], k, self.above[k][:, self.context_of[k][found[late]]], out)
            keep = np.ones(len(todo), bool)
            keep[np.flatnonzero(able)[hit]] = False
            todo = todo[keep]
        out[:, todo] = 8 * UNIT
        self._escapes(full, place, todo, -1, np.zeros((len(self.languages), len(todo)), np.int32), out)
        return out

    def _escapes(self, full: np.ndarray, place: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray, out: np.ndarray) -> None:
        """Add escapes from the longest context held before each of ``rows`` down to length ``k`` (above it), of which ``known`` is the rest."""
        for j in range(self.order, k, -1):
            if not len(rows):
                return
            able = np.flatnonzero(place[rows] >= j)
            found = self.contexts[j].find(tail(full[rows[able]] >> np.uint64(8), j))
            hit = able[found >= 0]
            out[:, rows[hit]] += self.above[j][:, found[found >= 0]] - known[:, hit]
            keep = np.ones(len(rows), bool)
            keep[hit] = False
            rows, known = rows[keep], known[:, keep]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): code lengths."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for at, group, skip in pieces(texts, self.order):
            a = np.frombuffer(b"".join(group), np.uint8)
            sizes = np.array([len(t) for t in group])
            starts = np.cumsum(sizes) - sizes
            cost = self.piece(a, np.arange(len(a)) - np.repeat(starts, sizes))
            # Only a piece alone in its group has bytes that are not counted.
            for i, c in enumerate(cost):
                out[at, i] += np.add.reduceat(c[skip:], starts, dtype=np.int64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of 2 to the negative code lengths."""
        bits = self.lengths(texts)
        best = bits.argmin(1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000 * UNIT) / UNIT).sum(1)
        return [self.languages[i] for i in best], share


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[bytes], int]]:
    """Indices and texts in groups of about ``CHUNK`` bytes; a longer text piece by piece, with ``order`` bytes before each that are not counted."""
    at, group, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            for begin in range(0, len(t), CHUNK):
                skip = min(order, begin)
                yield [i], [t[begin - skip : begin + CHUNK]], skip
        elif t:
            if group and size + len(t) > CHUNK:
                yield at, group, 0
                at, group, size = [], [], 0
            at.append(i)
            group.append(t)
            size += len(t)
    if group:
        yield at, group, 0


def counted(rows: DataFrame, order: int) -> DataFrame:
    """(lang, string, n): how often each string of up to ``order`` + 1 bytes, packed, stands in texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for at, group, skip in pieces([texts[i] for i in np.flatnonzero(langs == lang)], order):
                    a = np.frombuffer(b"".join(group), np.uint8)
                    sizes = np.array([len(t) for t in group])
                    place = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    for k in range(1, order + 2):
                        keys, n = np.unique(packed(a, k)[(place >= k - 1) & (place >= skip)], return_counts=True)
                        if len(keys):
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "string", "n"])

    return rows.mapInArrow(run, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, order: int = 4, sample: int = 500, most: int = 1 << 19) -> Forest | None:
    """The models of all languages, or None without any."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang").distinct()
    ids = materialise(ids, "ids")
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return None
    # Least hashes: only a share of each language's ids that holds ``sample`` of them (by over ten deviations) is sorted.
    likely = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, (sample + 20 * sample**0.5 + 200) / n)
        likely = likely | ((F.col("lang") == lang) & (F.xxhash64("doc_id") <= F.lit(int((2 * share - 1) * ((1 << 63) - 1024)) if share < 1 else (1 << 63) - 1)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = materialise(ids.where(likely).withColumn("_n", nth).where(F.col("_n") <= sample).select("doc_id", "lang"), "drawn")
    forget(ids)
    # At most ``sample`` ids a language: broadcast while there are no more than a quarter of a million.
    few = F.broadcast(drawn) if drawn.count() <= 1 << 18 else drawn
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(few, ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    strings = materialise(counted(texts.select("lang", "text"), order), "strings")
    forget(drawn)
    room = min(most, max(1 << 12, (1 << 23) // len(languages)))
    held = dict(strings.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect())
    least, total = 4096, 0
    while least > 1 and total + held.get(least, 0) + held.get(least - 1, 0) <= room:
        total += held.get(least, 0)
        least -= 1
    who = F.array_position(F.array(*[F.lit(lang) for lang in languages]), F.col("lang")) - 1
    kept = strings.where(F.col("n") >= least).select(who.cast("long").alias("who"), "string", "n").toArrow()  # ``room`` rows
    forget(strings)
    return Forest(languages, (kept["who"].to_numpy(), kept["string"].to_numpy().view(np.uint64), kept["n"].to_numpy()), order)


def op12_language(docs: DataFrame, order: int = 4, sample: int = 500, most: int = 1 << 19) -> DataFrame:
    """Every document's language and how sure it is."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, order, sample, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in small(batches):
            texts, none = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), bool)
            if forest is None:
                names, share = ["und"] * len(texts), np.zeros(len(texts))
            else:
                names, share = forest.predict(texts)
                names, share = ["und" if x else y for x, y in zip(none, names, strict=True)], np.where(none, 0.0, share)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("text"), (~text.rlike(LETTER)).alias("none")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
