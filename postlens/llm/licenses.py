"""License scans: MinHash bands over text windows retrieve templates, shingles verify them.

Texts and templates become words (lower case; punctuation separates, full
stops vanish, words without a letter or digit are dropped) and five-word
shingles.  A template of L words is looked for in windows of
``STRETCH * L + step - 1`` words, ``step`` words apart, so that some window
holds whole any occurrence that inserted words stretch to at most that many
times its length (templates that may not lose a shingle cannot be stretched:
their windows have ``L + step - 1`` words).  Templates of equal length share
their windows, whose MinHash bands retrieve templates from a table of the band
hashes of that length; the number of bands is set so that a window holding
``least`` of a template's shingles collides with it but for a chance of
``MISS``.  A retrieved pair is accepted if the window really holds that share
of the template's shingles, compared word by word.

A band can only collide if the window holds one of the template's shingles, so
windows without any of them get no signature: that loses nothing and keeps
the work in proportion to the text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import by_value

by_value(__name__)

SHINGLE = 5
LEAST = 0.8                  # share of a template's shingles that a window must hold
STRETCH = 2                  # template lengths that a copy with inserted words may take
ROWS = 2                     # MinHash values a band
MISS = 1e-6                  # chance that no band of a true window collides
SEED = 20240

#: Notices of public licenses, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 by the author."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Library General Public License as published by the Free Software Foundation; either version 2 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and "
                "neighboring rights to this software to the public domain worldwide."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
                  "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                  "means."),
) + tuple(
    (f"CC-{code}-{version}", line)
    for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                       ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for version, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
    for line in (f"This work is licensed under a Creative Commons {name} {version} {port} License.",
                 f"Licensed under CC {code} {version}.")
    if (code, version) != ("BY-NC", "4.0") and (code, version, line[0]) != ("BY", "4.0", "T")      # listed above
)

#: Notices of fewer than SHINGLE words, found as whole sequences.
LINES = (
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)

_SEPARATORS = bytes(range(0x21, 0x2D)) + b"/:;<=>?@[\\]^`{|}~"      # not - . _ nor digits and letters
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def _bare(word: bytes) -> bytes:
    """A word without dashes around it; empty if it has no letter or digit."""
    word = word.strip(b"-_")
    return word if word.isalnum() or any(map(str.isalnum, word.decode("utf-8", "replace"))) else b""


def words_of(text: str | None) -> list[bytes]:
    return [w for w in map(_bare, (text or "").encode().lower().translate(_TO_SPACE, b".").split()) if w]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte spans, in the text's UTF-8, of the words that ``words_of`` gives."""
    raw = text.encode().lower().translate(_TO_SPACE)
    return [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw) if _bare(m.group().replace(b".", b""))]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every run of SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def _permuted(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[hash, permutation]: a keyed mix of each hash (murmur's finisher)."""
    x = h[:, None] ^ keys[None, :]
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


@dataclass
class Template:
    license: str
    words: list[bytes]
    step: int
    reach: int                  # words of the longest copy that some window holds whole
    bands: int
    shingles: set               # of word tuples
    hashes: np.ndarray
    signature: np.ndarray       # [band, row]

    @property
    def window(self) -> int:
        return self.reach + self.step - 1


def reach_for(words: int, least: float = LEAST) -> int:
    """Words that a copy may take: STRETCH template lengths, or just one if no shingle may be lost."""
    own = words - SHINGLE + 1
    return words * STRETCH if np.ceil(least * own - 1e-9) < own else words


def bands_for(words: int, step: int, least: float = LEAST, reach: int | None = None) -> int:
    """Bands by which a window with ``least`` of the shingles collides but for a chance of MISS."""
    own, window = words - SHINGLE + 1, (reach or words) + step - SHINGLE
    shared = np.ceil(least * own - 1e-9)
    likeness = shared / (own + window - shared)
    p = likeness ** ROWS
    return 1 if p >= 1 else int(np.ceil(np.log(MISS) / np.log(1 - p)))


def prepare(templates=TEMPLATES, least: float = LEAST) -> list[Template]:
    out = []
    for license, text in templates:
        words = words_of(text)
        if len(words) < SHINGLE:
            raise ValueError(f"{license}: a template needs {SHINGLE} words")
        step = max(1, len(words) // 8)
        reach = reach_for(len(words), least)
        bands = bands_for(len(words), step, least, reach)
        hashes = shingle_hashes(words)
        out.append(Template(license, words, step, reach, bands, {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)},
                            np.unique(hashes), _signature(hashes, bands)))
    return out


@lru_cache(maxsize=64)
def _keys(bands: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2 ** 63, bands * ROWS).astype(np.uint64)


def _signature(hashes: np.ndarray, bands: int) -> np.ndarray:
    return _permuted(hashes, _keys(bands)).min(axis=0).reshape(bands, ROWS)


def _band_hashes(signature: np.ndarray) -> np.ndarray:
    """64-bit hash of each band's number and values."""
    h = np.arange(len(signature), dtype=np.uint64)
    for row in signature.T:
        h = (h ^ row) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class BandTable:
    """(band, band hash) -> templates, for templates of one length and so of one window length."""

    def __init__(self, own: list[tuple[int, Template]]):
        first = own[0][1]
        self.step, self.window, self.bands = first.step, first.window, first.bands
        self.hashes = np.unique(np.concatenate([t.hashes for _, t in own]))
        keys = np.concatenate([_band_hashes(t.signature) for _, t in own])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.repeat([n for n, _ in own], self.bands)[order]

    def retrieve(self, hashes: np.ndarray) -> list[int]:
        """Numbers of the templates with which a window's shingles share a band."""
        wanted = _band_hashes(_signature(hashes, self.bands))
        lo = np.searchsorted(self.keys, wanted)
        met = self.keys[np.minimum(lo, len(self.keys) - 1)] == wanted
        found: set[int] = set()
        for i, key in zip(lo[met].tolist(), wanted[met].tolist()):
            while i < len(self.keys) and self.keys[i] == key:
                found.add(int(self.owners[i]))
                i += 1
        return sorted(found)


def _passages(held: list[tuple], i: int, j: int, need: float) -> list[tuple]:
    """(shingles, first word, end word) of the passages among hits ``i`` to ``j`` of a window.

    The first is the tightest run with all shingles that the hits have; what
    lies before and after it is searched for further ones.
    """
    out, todo = [], [(i, j)]
    while todo:
        i, j = todo.pop()
        whole = len({w for _, w in held[i:j]})
        if whole < need or not whole:
            continue
        count: Counter = Counter()
        best, lo = None, i
        for hi in range(i, j):
            count[held[hi][1]] += 1
            while count[held[lo][1]] > 1:
                count[held[lo][1]] -= 1
                lo += 1
            if len(count) == whole and (best is None or held[hi][0] - held[lo][0] < best[0]):
                best = held[hi][0] - held[lo][0], lo, hi
        _, lo, hi = best
        out.append((whole, held[lo][0], held[hi][0] + SHINGLE))
        todo += [(i, lo), (hi + 1, j)]
    return out


def _apart(found: set) -> list[tuple]:
    """Passages that do not overlap, by place: the fullest first, then the shortest, then the first."""
    kept: list[tuple] = []                              # (first word, end word, shingles)
    for n, lo, hi in sorted(found, key=lambda p: (-p[0], p[2] - p[1], p[1])):
        at = bisect_left(kept, (lo, hi, n))
        if (at == 0 or kept[at - 1][1] <= lo) and (at == len(kept) or kept[at][0] >= hi):
            kept.insert(at, (lo, hi, n))
    return [(n, lo, hi) for lo, hi, n in kept]


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST, lines=LINES):
        self.templates, self.least = prepare(templates, least), least
        by_length: dict[int, list] = {}
        for number, t in enumerate(self.templates):
            by_length.setdefault(len(t.words), []).append((number, t))
        self.tables = [BandTable(own) for own in by_length.values()]
        self.lines = [(license, words_of(text)) for license, text in lines]
        if not all(words for _, words in self.lines):
            raise ValueError("a line needs a word")
        self.all = np.unique(np.concatenate([t.hashes for t in self.templates]))

    def scan(self, text: str | None) -> list[tuple]:
        """(template number, containment, first word, end word) of every passage that holds a template.

        A passage is the tightest run of words with all the template's
        shingles that an accepted window holds; of passages of one template
        that overlap the fullest stays, then the shortest, then the first.
        """
        words = words_of(text)
        hashes = shingle_hashes(words)
        if not len(hashes):
            return []
        at = np.searchsorted(self.all, hashes)
        near = np.nonzero(self.all[np.minimum(at, len(self.all) - 1)] == hashes)[0]
        if not len(near):
            return []
        out = []
        for table in self.tables:
            hits = near[np.isin(hashes[near], table.hashes)]
            if not len(hits):
                continue
            span, step = table.window - SHINGLE + 1, table.step     # shingles a window holds
            starts = set()                              # windows (at multiples of step) that hold a hit
            last = max(0, -(-(len(hashes) - span) // step))
            for h in hits.tolist():
                first = max(0, -(-(h - span + 1) // step))
                starts.update(range(first, min(h // step, last) + 1))
            retrieved: dict[int, list] = {}             # template number -> windows
            for k in sorted(starts):
                a = k * step
                b = min(a + span, len(hashes))
                for number in table.retrieve(hashes[a:b]):
                    retrieved.setdefault(number, []).append((a, b))
            for number, windows in retrieved.items():
                t = self.templates[number]
                held = [(i, w) for i in hits.tolist() if (w := tuple(words[i:i + SHINGLE])) in t.shingles]
                at = [i for i, _ in held]
                need = self.least * len(t.shingles) - 1e-9
                found = set()
                for run in {(bisect_left(at, a), bisect_left(at, b)) for a, b in windows}:
                    found.update(_passages(held, *run, need))
                out += [(number, n / len(t.shingles), lo, hi) for n, lo, hi in _apart(found)]
        return sorted(out, key=lambda p: (p[0], p[2]))

    def scan_lines(self, text: str | None) -> list[tuple]:
        """The same for the lines, numbered after the templates: every place where all words of one follow each other."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        out = []
        for number, (_, line) in enumerate(self.lines, len(self.templates)):
            wanted, seen, word = b" " + b" ".join(line) + b" ", 0, 0
            at = joined.find(wanted)
            while at >= 0:
                word, seen = word + joined.count(b" ", seen, at), at
                out.append((number, 1.0, word, word + len(line)))
                at = joined.find(wanted, at + len(wanted) - 1)
        return out

    def entry(self, number: int) -> tuple[str, int]:
        """License and words of a template or line."""
        if number < len(self.templates):
            return self.templates[number].license, len(self.templates[number].words)
        license, words = self.lines[number - len(self.templates)]
        return license, len(words)

    def best(self, found: list[tuple]) -> list[bool]:
        """Is a passage the best one where it stands?

        Passages that share half of the shorter one's words compete; the
        higher containment wins, then the longer template, then the first.
        """
        order = sorted(range(len(found)), key=lambda i: found[i][2])
        rank = [(-share, -self.entry(number)[1], number, first) for number, share, first, _ in found]
        out = [True] * len(found)
        near: list[int] = []                            # earlier passages that may reach the present one
        for i in order:
            first, end = found[i][2:4]
            near = [j for j in near if found[j][3] > first]
            for j in near:
                shared = min(end, found[j][3]) - first
                if 2 * shared >= min(end - first, found[j][3] - found[j][2]):
                    out[max(i, j, key=lambda k: rank[k])] = False
            near.append(i)
        return out


OUT = ("doc_id long, license string, template int, containment double, start_byte long, end_byte long, passage string, best boolean")


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, lines=LINES) -> DataFrame:
    """One row a passage: doc_id, license, template (number), containment, byte span and text, and whether it is the best.

    Spans are in the text's UTF-8.  Null, empty and short texts hold no
    passage; repeated rows give their passages again; a null doc_id is kept.
    Templates that overlap in a text are all reported; ``best`` marks the one
    that tells the license where several cover a passage.  Lines are numbered
    after the templates.  An empty table gives an empty result; other columns
    are not read.
    """
    def run(batches):
        scanner = Scanner(templates, least, lines)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = scanner.scan(text) + scanner.scan_lines(text)
                if found:
                    spans, raw = word_spans(text), text.encode()
                    for (number, share, first, end), best in zip(found, scanner.best(found)):
                        a, z = spans[first][0], spans[end - 1][1]
                        rows.append((doc_id, scanner.entry(number)[0], number, share, a, z,
                                     raw[a:z].decode("utf-8", "replace"), best))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 ["doc_id", "license", "template", "containment", "start_byte", "end_byte", "passage", "best"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
