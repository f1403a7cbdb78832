"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides.

A text is its letters and digits in lower case, as words, and its shingles of five words.
Windows of 4, 8, 16, ... shingles step by half their length, over the whole text. Each template
belongs to the smallest windows of which one holds any place where it stands whole. Then the
window shares at least 4 of 21 shingles with the template (1 of 4 for a template of one
shingle), and with 48 bands of one MinHash each a template is retrieved with a probability
of 0.9999 or more. Block minima are taken once; the longer windows' are minima of those.

A retrieved template is verified on the words themselves, in the window and as much text on
either side of it: the share of its shingles in some run as long as a window, from whatever
place on, must reach the threshold. So a notice doesn't depend on where windows fall.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import raw_text, slices, text_runs


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    bands: int = 48
    containment: float = 0.8
    seed: int = 5
    block: int = 2  # shingles in the smallest windows' step


#: Notices of public licenses as they are published (fixed values): name, text.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))
_NONE = np.uint32(0xFFFFFFFF)
_LONG = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    """ASCII letters and digits in lower case, all other bytes from 0x80 on as they are."""
    return text.translate(_FOLD).split()


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """32-bit hash of the n words from each place, from 64-bit hashes of the words."""
    base, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * base + words[k : k + len(out)]
        return ((out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Templates by their MinHash values."""

    def __init__(self, templates: list[tuple[str, str]], p: Params):
        self.p, self.templates = p, []
        self.widths: list[int] = []  # shingles in a window of each template
        r = np.random.default_rng(p.seed)
        self.a = r.integers(0, 1 << 31, p.bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 1 << 32, p.bands, dtype=np.uint32)
        levels: dict[int, list[int]] = {}
        for name, text in templates:
            words = words_of(text.encode())
            shingles = {tuple(words[i : i + p.shingle]) for i in range(len(words) - p.shingle + 1)}
            if not shingles:
                continue  # too short to tell from other text
            step, level = p.block, 0
            while step + 1 < len(words) - p.shingle + 1:
                step, level = step * 2, level + 1
            levels.setdefault(level, []).append(len(self.templates))
            self.widths.append(2 * step)
            self.templates.append((name, len(self.templates), shingles, words))
        #: For each level and band: a bitmap of the values' upper bits, the sorted values and their templates.
        self.levels = {level: [self._table(own, f) for f in range(p.bands)] for level, own in levels.items()}

    def _mixed(self, h: np.ndarray, f: int) -> np.ndarray:
        x = h * self.a[f] + self.b[f]
        x ^= x >> np.uint32(15)
        return x * np.uint32(0x85EBCA6B)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def _table(self, own: list[int], f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.array([self._mixed(shingle_hashes(self._hashes(self.templates[t][3]), self.p.shingle), f).min() for t in own], np.uint32)
        maybe = np.zeros(1 << 16, bool)
        maybe[low >> np.uint32(16)] = True
        order = np.argsort(low, kind="stable")
        return maybe, low[order], np.array(own)[order]

    def retrieve(self, h: np.ndarray, valid: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, after the last) of the windows that share a band with a template."""
        out: set[tuple[int, int, int]] = set()
        if not self.levels or not len(h):
            return out
        pad = -len(h) % self.p.block
        for f in range(self.p.bands):
            x = np.where(valid, self._mixed(h, f), _NONE)
            low = np.concatenate([x, np.full(pad, _NONE, np.uint32)]).reshape(-1, self.p.block).min(1)
            step = self.p.block
            for level in range(max(self.levels) + 1):
                window = np.minimum(low, np.append(low[1:], _NONE))
                if level in self.levels:
                    maybe, values, own = self.levels[level][f]
                    for w in np.flatnonzero(maybe[window >> np.uint32(16)]).tolist():
                        first, last = np.searchsorted(values, window[w]), np.searchsorted(values, window[w], "right")
                        out |= {(int(t), w * step, (w + 2) * step) for t in own[first:last]}
                low = np.append(low, np.full(len(low) % 2, _NONE, np.uint32)).reshape(-1, 2).min(1)
                step *= 2
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text (license, template, containment, first_word, n_words) of every template it has."""
        own, out = [], []
        for t in texts:
            if len(t) > _LONG:
                own.append([])
                out.append(self._scan_long(t))
            else:
                own.append(words_of(t))
                out.append(None)
        return [b if a is None else a for a, b in zip(out, self._scan_words(own), strict=True)]

    def _scan_long(self, text: bytes) -> list[tuple]:
        """A huge text in runs; each also has the words before it that a window may need."""
        best: dict[int, tuple] = {}
        over = 2 * self.p.block * 2 ** max(self.levels, default=0) + self.p.shingle
        tail: list[bytes] = []
        at = 0
        for part in text_runs(text):
            words = tail + words_of(part)
            for name, t, share, first, n in self._scan_words([words])[0]:
                hit = (share, -(at + first), n, name)
                best[t] = max(best.get(t, hit), hit)
            drop = max(0, len(words) - over)
            tail, at = words[drop:], at + drop
        return [(name, t, share, -at, n) for t, (share, at, n, name) in sorted(best.items())]

    def _scan_words(self, own: list[list[bytes]]) -> list[list[tuple]]:
        starts = np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int64)
        flat = [w for words in own for w in words]
        h = shingle_hashes(self._hashes(flat), self.p.shingle)
        room = np.repeat(starts[1:], np.diff(starts))[: len(h)] - np.arange(len(h))
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, first, last in sorted(self.retrieve(h, room >= self.p.shingle)):
            doc = int(np.searchsorted(starts, first, "right")) - 1
            while doc < len(own) and starts[doc] < last:  # a window may reach into the next texts
                a = max(first - self.widths[t], int(starts[doc]))
                b = min(last + self.widths[t], int(starts[doc + 1]) - self.p.shingle + 1)
                near = places.setdefault((doc, t), [])
                if near and a <= near[-1][1]:
                    near[-1] = (near[-1][0], max(b, near[-1][1]))
                elif a < b:
                    near.append((a, b))
                doc += 1
        found: list[dict[int, tuple]] = [{} for _ in own]
        for (doc, t), near in places.items():
            best = max((self._best_run(flat, t, a, b) for a, b in near), default=(0.0, 0, 0))
            if best[0] >= self.p.containment:
                found[doc][t] = (best[0], best[1] + int(starts[doc]), best[2])
        return [[(self.templates[t][0], t, s, -at, n) for t, (s, at, n) in sorted(f.items())] for f in found]

    def _best_run(self, flat: list[bytes], t: int, a: int, b: int) -> tuple[float, int, int]:
        """(containment, -first word, words) of the run from a to b with most of the template, the first of equals."""
        shingles, width, best = self.templates[t][2], self.widths[t], (0.0, 0, 0)
        run: deque[tuple[int, tuple]] = deque()
        held: Counter = Counter()
        for i in range(a, b):
            if (x := tuple(flat[i : i + self.p.shingle])) in shingles:
                run.append((i, x))
                held[x] += 1
                while i - run[0][0] >= width:
                    _, gone = run.popleft()
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                best = max(best, (len(held) / len(shingles), -run[0][0], i - run[0][0] + self.p.shingle))
        return best


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared)
        for batch in slices(batches, "text", 4 << 20):
            found = index.scan(batch.column("text").to_pylist())
            rows = [(d, *r) for d, own in zip(batch.column("doc_id").to_pylist(), found, strict=True) for r in own]
            kinds = (batch.schema.field("doc_id").type, pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int32())
            names = ["doc_id", "license", "template", "containment", "first_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, p: Params = Params()) -> DataFrame:  # noqa: B008
    """(doc_id, license, template, containment, first_word, n_words): each template in each document.

    template: its place in the list; containment: of the best run as long as a window, the first of equals;
    first_word and n_words: where its shingles stand, in words of letters and digits. Templates
    under five words are left out. Null and empty texts have none. Rows that repeat each return
    their own; an empty table returns no rows; extra columns are not read. Rows don't move. The
    templates are a list that the caller holds, so their size is the caller's.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", raw_text().alias("text"))
    schema = f"doc_id {kind}, license string, template int, containment double, first_word long, n_words int"
    return rows.mapInArrow(_scan((templates, p)), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """Documents with license notices: doc_id, license, template, containment, first_word, n_words."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
