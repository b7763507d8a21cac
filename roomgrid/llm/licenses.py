"""License scans: winnowed fingerprints pick candidates, banded alignment reports matches.

Words are runs of letters and digits, lower-cased.  Of every ``WINDOW`` neighbouring runs of
``GRAM`` words the smallest hash is a fingerprint, so any shared passage of at least
GRAM + WINDOW - 1 words shares one.  The fingerprints of the templates form an inverted index
(small and fixed by the template table, so it goes along with the task).  A hit names a
template and a diagonal; the template is then aligned with the words around that diagonal in a
band, and a match is reported with its coverage (aligned template words that are equal), its
matched words and its span in characters.  The phrases of a template that name its license and
version (``NAMES`` and version numbers) must stand in the span whole and in order; a template
of under ``SHORT`` words that has none must be covered whole.  Of matches that overlap, the one with more matched
words stays, then the one with more coverage, then the earlier name.

Templates are a parameter: rows (name, text).  ``TEMPLATES`` has short notices of common
licenses.

Defined results: null and empty texts have no matches; every row is scanned alone, so
repeated rows repeat their matches; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgrid.llm import words as W

GRAM = 3
WINDOW = 2
BAND = 6
COVERAGE = 0.8

# The wording of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY", "Licensed under CC BY"),
    ("CC-BY-SA", "Licensed under CC BY-SA"),
    ("CC-BY-NC", "Licensed under CC BY-NC"),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA"),
    ("CC-BY-ND", "Licensed under CC BY-ND"),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND"),
    ("GPL", "licensed under the GNU General Public License"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL", "licensed under the GNU Affero General Public License"),
    ("MPL", "Licensed under the Mozilla Public License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("zlib", "Licensed under the zlib License"),
    ("Apache", "Licensed under the Apache License"),
    ("Apache-2.0", "Licensed under the Apache 2.0 License"),
    ("BSD", "Licensed under the new BSD License"),
    ("BSD", "Licensed under the 3-Clause BSD License"),
)

# What names a license (a version number after these words counts with them).
NAMES = ("apache license", "apache 2 0", "mit license", "bsd license", "zlib license", "gnu general public license",
         "gnu lesser general public license", "gnu affero general public license", "mozilla public license",
         "cc0", "cc by nc sa", "cc by nc nd", "cc by nc", "cc by sa", "cc by nd", "cc by")
SHORT = 10
_PHRASE = re.compile(rf"\b(?:(?:{'|'.join(NAMES)})(?: \d+)*|(?:version|v) \d+(?: \d+)*)\b")

_BREAK = np.ones(256, dtype=bool)      # everything but letters, digits and non-ASCII bytes
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c >= 128:
        _BREAK[_c] = False


def tokenised(col: pa.Array) -> W.Words:
    return W.Words(col, lower=True, separators=_BREAK)


def grams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the first word) of every run of GRAM words of one row."""
    m = len(w.hash) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:m]
    for k in range(1, GRAM):
        h = W.chain(h, w.hash[k:m + k])
    at = np.flatnonzero(w.doc[:m] == w.doc[GRAM - 1:])
    return h[at], at


def winnow(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all rows: the smallest gram of every window, the last on a tie; a
    row with fewer grams than a window keeps its smallest."""
    h, at = grams(w)
    if len(h) == 0:
        return h, at
    doc = w.doc[at]
    keep = np.zeros(len(h), bool)
    m = len(h) - WINDOW + 1
    if m > 0:
        full = np.flatnonzero(doc[:m] == doc[WINDOW - 1:])
        low = full + WINDOW - 1
        for k in range(WINDOW - 2, -1, -1):
            low = np.where(h[full + k] < h[low], full + k, low)
        keep[low] = True
    n = np.bincount(doc, minlength=w.n_docs)
    for d in np.flatnonzero((n > 0) & (n < WINDOW)):
        own = np.flatnonzero(doc == d)
        keep[own[np.argmin(h[own])]] = True
    return h[keep], at[keep]


class Index:
    """Inverted index of the templates: sorted fingerprints with (template, place)."""

    def __init__(self, templates):
        self.names = [n for n, _ in templates]
        w = tokenised(W.as_large_strings(pa.array([t for _, t in templates], pa.string())))
        cut = w.first_word
        self.words = [w.hash[cut[i]:cut[i + 1]] for i in range(len(self.names))]
        plain = [" ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())) for _, t in templates]
        self.phrases = [[self.words[i][(k := t[:m.start()].count(" ")):k + m[0].count(" ") + 1]
                         for m in _PHRASE.finditer(t)] for i, t in enumerate(plain)]
        h, at = grams(w)       # every gram: whichever the text's windows choose, it is here
        order = np.argsort(h, kind="stable")
        self.hash, self.template = h[order], w.doc[at][order]
        self.place = at[order] - cut[self.template]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, index row) of all that are in the index."""
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = b - a
        which = np.repeat(np.arange(len(h)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]
        return which, row


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(equal words, first, last + 1) of the best alignment of the whole template with a part of
    the text, within ``band`` of the diagonal text place = template place + shift."""
    n, width = len(template), 2 * band + 1
    low = -10 ** 9
    # by template row, over the band: (score, equal words, first text place)
    row = [(0, 0, shift + d - band) if 0 <= shift + d - band <= len(text) else (low, 0, 0) for d in range(width)]
    for i in range(n):
        new = []
        for d in range(width):
            j = i + 1 + shift + d - band      # text words used after this cell
            best = (low, 0, 0)
            if 0 <= j <= len(text):
                if j >= 1:
                    s, e, f = row[d]
                    same = template[i] == text[j - 1]
                    best = (s + (2 if same else -1), e + same, f)
                if d + 1 < width and row[d + 1][0] - 1 > best[0]:     # template word left out
                    best = (row[d + 1][0] - 1, *row[d + 1][1:])
                if d and new[d - 1][0] - 1 > best[0]:                 # text word inserted
                    best = (new[d - 1][0] - 1, *new[d - 1][1:])
            new.append(best)
        row = new
    d = max(range(width), key=lambda d: (row[d][0], row[d][1], -abs(d - band)))
    return int(row[d][1]), max(0, row[d][2]), n + shift + d - band


def named(phrases: list[np.ndarray], text: np.ndarray) -> bool:
    """Whether all phrases stand in the text, each without a gap, one after the other."""
    at = 0
    for p in phrases:
        while at + len(p) <= len(text) and not np.array_equal(text[at:at + len(p)], p):
            at += 1
        if at + len(p) > len(text):
            return False
        at += len(p)
    return True


def matches(col: pa.Array, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """(row, name, template, coverage, words, first byte, end byte) of a batch."""
    w = tokenised(col)
    h, at = winnow(w)
    which, hit = index.hits(h)
    if len(which) == 0:
        return []
    cut = w.first_word
    doc, tpl = w.doc[at[which]], index.template[hit]
    shift = at[which] - cut[doc] - index.place[hit]
    order = np.lexsort((shift, tpl, doc))
    found: dict[int, list] = {}
    last = None
    for d, t, s in zip(doc[order].tolist(), tpl[order].tolist(), shift[order].tolist()):
        if last is not None and last[:2] == (d, t) and s - last[2] <= BAND // 2:
            continue      # the same diagonal, give or take the band
        last = (d, t, s)
        text = w.hash[cut[d]:cut[d + 1]]
        equal, a, b = align(index.words[t], text, s)
        part = equal / len(index.words[t])
        phrases = index.phrases[t]
        least = 1.0 if not phrases and len(index.words[t]) < SHORT else coverage
        if part >= least and b > a and named(phrases, text[a:b]):
            while b > a and text[b - 1] not in index.words[t]:
                b -= 1
            found.setdefault(d, []).append((-equal, -part, index.names[t], t, a, b))
    out = []
    for d, rows in found.items():
        taken: list[tuple[int, int]] = []
        for e, p, name, t, a, b in sorted(rows):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((d, name, t, -p, -e, int(w.start[cut[d] + a]), int(w.end[cut[d] + b - 1])))
    return sorted(out, key=lambda r: (r[0], r[5]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         coverage: float = COVERAGE) -> DataFrame:
    """One row for each match: id, license, template, coverage, matched words, start and length
    in characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    templates = list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            text = W.as_large_strings(batch.column(1))
            for a, b in W.slices(text):
                part = text.slice(a, b - a)
                got = matches(part, index, coverage)
                buf, offs = W.buffers(part)
                chars = lambda d, x: int(((buf[offs[d]:x] & 0xC0) != 0x80).sum())
                start = [chars(r[0], r[5]) for r in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array([r[0] for r in got], pa.int64())),
                     pa.array([r[1] for r in got], pa.string()), pa.array([r[2] for r in got], pa.int32()),
                     pa.array([r[3] for r in got], pa.float64()), pa.array([r[4] for r in got], pa.int32()),
                     pa.array(start, pa.int64()),
                     pa.array([chars(r[0], r[6]) - s for r, s in zip(got, start)], pa.int64())],
                    names=["id", "license", "template", "coverage", "words", "start", "length"])

    return rows.mapInArrow(run, f"id {kind}, license string, template int, coverage double, words int, start long, "
                                "length long").withColumnRenamed("id", id_col)
