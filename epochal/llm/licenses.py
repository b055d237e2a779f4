"""License scans: an Aho-Corasick automaton over word sequences, and licence expressions.

Texts are lower-cased (A-Z) and cut into words at every ASCII character that is not a
letter or digit; joined by single blanks they are scanned once by an automaton that
holds all notice phrases and identifier tags, so overlapping places are all found.
Where it meets an ``SPDX-License-Identifier`` tag or a ``License`` field, followed by a colon (for the field, an equals
sign too), the rest of that line is parsed by a shunting yard (with > and > or, brackets) and evaluated; a field only
counts where each name is a known licence, as prose follows the word as well.

Null or empty text: no words, no labels, score 0.  Malformed expressions give no
labels.  Repeated rows are scanned each; whole texts are scanned.  An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small

#: The contract's phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases (as words) and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "boost software license": "bsl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: Tag and whether any name may follow it (else only known licences).
TAGS = {"spdx license identifier": True, "license": False}
#: How freely a label's texts may be used, 0 to 1; unknown labels count 0.5.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "bsl": 1.0, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "reserved": 0.0}
IDS = ("cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "apache", "agpl", "lgpl", "gpl", "mpl", "epl", "bsd", "isc", "mit", "unlicense", "bsl")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: What follows a tag's last word: blanks or a closing quote, a colon or equals sign, and the expression.
_BEHIND = {True: re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)"), False: re.compile(rb"[\"' \t]*[:=][ \t]*[\"']?([^\r\n]*)")}
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+|\S")
_RANK = {"or": 1, "and": 2, "with": 3}
_AUTOMATON = []


def automaton():
    """Built once a worker."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, label in NOTICES.items():
            a.add_word(f" {p} ", (p, label, False))
        for p, free in TAGS.items():
            a.add_word(f" {p} ", (p, None, free))
        for p, label in BASE.items():
            a.add_word(f" {p} ", (p, label, True))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def label_of(identifier: str) -> str:
    low = identifier.lower()
    return next((i for i in IDS if low == i or low.startswith(i + "-")), low)


def parse(expression: str) -> list[str] | None:
    """Shunting yard: the expression's longest well-formed start in postfix order, or None if there is none."""
    out, stack, operand = [], [], True
    best = None
    for t in _TOKEN.findall(expression):
        low = t.lower()
        if operand:
            if t == "(":
                stack.append(t)
            elif re.match(r"[a-z0-9]", low) and low not in _RANK:
                out.append(t)
                operand = False
                if "(" not in stack:
                    best = out + stack[::-1]
            else:
                break
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif t == ")" and "(" in stack:
            while (o := stack.pop()) != "(":
                out.append(o)
            if "(" not in stack:
                best = out + stack[::-1]
        else:
            break
    return best


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named, and freedom: the best of ``or``, the worst of ``and``; an exception after ``with`` changes nothing."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else (a[0] | b[0], (max if t == "or" else min)(a[1], b[1])))
        else:
            label = label_of(t.rstrip("+"))
            stack.append(({label}, FREEDOM.get(label, 0.5)))
    return stack[0]


def scan(text: str | None) -> dict:
    """All findings in one text: words, base places (word index), labels and freedom."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.translate(_LOWER)
    found = plain.split()
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    places, base, labels, worth, tags = [], set(), set(), [], []
    at = words = 0
    for end, (phrase, label, is_base) in automaton().iter(line):
        start = end - len(phrase) - 1  # where the leading blank stands
        if is_base or label is None:
            # Longer phrases that end together come first, so starts may step back a little.
            words += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
        if label is None:
            tags.append((words + phrase.count(" "), is_base))
            continue
        if is_base:
            places.append(words)
            base.add(label)
        labels.add(label)
    if tags:
        ends = [m.end() for m in _WORD.finditer(plain)]  # of each word, in the text itself
        for last, free in tags:
            m = _BEHIND[free].match(raw, ends[last])
            postfix = m and parse(m[1].decode("utf-8", "replace"))
            if postfix and (free or all(t in _RANK or label_of(t.rstrip("+")) in IDS or (i and i + 1 < len(postfix) and postfix[i + 1] == "with") for i, t in enumerate(postfix))):
                named, freedom = evaluate(postfix)
                labels |= named
                worth.append(freedom)
    notice = [FREEDOM[x] for x in labels if x in FREEDOM] if not worth else worth
    return {"n_words": len(found), "places": places, "base": base, "labels": labels, "freedom": min(notice, default=None)}


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = scan(t.as_py())
            p = s["places"]
            # Score: that the text states a licence; one more kind of evidence halves the doubt.
            sure = 1 - 0.5 ** (len(s["labels"]) + (len(p) > 0)) if s["labels"] else 0.0
            rows.append((i, s["n_words"], len(p), min(p, default=None), max(p, default=None), ",".join(sorted(s["base"])), ",".join(sorted(s["labels"])), sure, s["freedom"]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document; see the contract of op2 for the columns.  No shuffle."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches, OUT)


def op2_licenses(docs: DataFrame) -> DataFrame:
    return license_scan(docs)
