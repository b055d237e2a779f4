"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Letters A-Z lower-cased; ASCII that is no letter or digit becomes a blank; other bytes stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MUL = np.uint64(1099511628211)
#: Bytes taken at a time, and from which on a word is hashed by itself.
CHUNK, LONG = 1 << 20, 1 << 16


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    return next(iter(many([text])))


def many(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text, made over about ``CHUNK`` bytes at a time."""
    group, size = [], 0
    for t in texts:
        if len(t) > CHUNK:
            yield from _group(group)
            group, size = [], 0
            yield _long(t)
            continue
        if size + len(t) > CHUNK:
            yield from _group(group)
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    yield from _group(group)


def _long(t: bytes) -> np.ndarray:
    """One text, cut behind words; what holds a word of over ``CHUNK`` bytes goes word by word."""
    t, at, out = t.translate(WORDS), 0, []
    while at < len(t):
        end = t.find(b" ", min(len(t), at + CHUNK))
        end = len(t) if end < 0 else end
        part = t[at:end]
        out += [_hashes(part)[0]] if len(part) <= 2 * CHUNK else [_hashes(w)[0] if len(w) < LONG else _whole(w) for w in part.split()]
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _whole(word: bytes) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(word)], np.uint64)


def _group(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        h, first = _hashes(b" ".join(texts).translate(WORDS))
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])).tolist()
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            yield h[s:e]


def _hashes(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of translated bytes."""
    a = np.frombuffer(plain, np.uint8)
    blank = a == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    # Position within the word (blanks add nothing, whatever theirs).
    start = np.zeros(len(a), np.int64)
    start[first] = first
    place = np.arange(len(a)) - np.maximum.accumulate(start)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int((last - first).max()), _MUL))).astype(np.uint64))
    term = np.where(blank, np.uint64(0), (a.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)])
    h = mix(np.add.reduceat(term, first))
    for i in np.flatnonzero(last - first >= LONG).tolist():
        h[i] = _whole(plain[first[i] : last[i]])[0]
    return h, first


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
