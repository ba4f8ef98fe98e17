"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template is a set of shingles of five words (runs of letters and digits, lower-cased). It matches a place in a document whose surroundings hold
at least CONTAINMENT of its shingles. A changed word destroys five shingles, a removed or added one four, so a matching copy of s shingles has at
most 0.05 s edits and therefore an unbroken run of ceil(0.8 s / (floor(0.05 s) + 1)) shingles. The window width is chosen so that some window of
the document lies inside that run whatever its alignment (windows of a document begin every half width, those of a template everywhere). That
window equals a template window, so it agrees in every band: such a match is retrieved with certainty. Windows that differ a little are found too,
with probability 1 - (1 - J^2)^8 at similarity J. The surroundings in which a retrieved template is verified reach its own length beyond it on both
sides, so an insertion as long as the template itself doesn't part a notice. Templates of up to four shingles stand unbroken or not at all.

One pass over whole texts without a shuffle; templates are a fixed small list that travels with the code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, ship, slices
from .textbytes import LOWER, mix, shingles, span_hashes, utf8

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 8, 2

#: Public license notices: fixed values.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_PART = np.ones(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_rng = np.random.default_rng(29)
_XOR, _ODD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32), _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from . import textbytes

    spaced = np.where(_PART[data], np.uint8(0x20), LOWER[data])
    return textbytes.words(at, spaced)


def _shingled(column: pa.Array):
    at, data = utf8(column)
    starts, ends, first = _words(at, data)
    hashes, begin = shingles(span_hashes(LOWER[data], starts, ends), first, SHINGLE)
    return at, data, starts, ends, first, hashes, begin


def width_for(size: int) -> int:
    """The largest window of which one lies inside the unbroken run of every matching copy of a template of `size` shingles."""
    edits = int((1 - CONTAINMENT) * size / 4)
    run = int(np.ceil(CONTAINMENT * size / (edits + 1)))
    return max([w for w in (1, 2, 4, 8) if w + max(1, w // 2) - 1 <= run], default=1)


def _minima(hashes: np.ndarray, width: int, k: int) -> np.ndarray:
    """Smallest value of hash function k in every window of `width` shingles."""
    x = ((hashes >> np.uint64(32)).astype(np.uint32) ^ _XOR[k]) * _ODD[k]
    x ^= x >> np.uint32(15)
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def _band(hashes: np.ndarray, width: int, band: int, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at), width * 64 + band, np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + _minima(hashes, width, band * ROWS + r)[at])
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names, self.sets, self.index = list(templates), [], {}
        *_, hashes, begin = _shingled(pa.array(list(templates.values())))
        for t, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
            own = hashes[a:b]
            self.sets.append(np.unique(own))
            width = width_for(len(own))
            place = np.arange(len(own) - width + 1)
            for band in range(BANDS if width > 2 else 1):
                table = self.index.setdefault((width, band), {})
                for key, p in zip(_band(own, width, band, place).tolist(), place.tolist(), strict=True):
                    table.setdefault(key, []).append((t, p))
        self.sizes = np.diff(begin).tolist()
        self.filters = {}
        for key, table in self.index.items():
            self.filters[key] = np.zeros(1 << 16, bool)
            self.filters[key][[k & 0xFFFF for k in table]] = True

    def candidates(self, hashes: np.ndarray, begin: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, template, shingle at which the template would begin)."""
        out: set[tuple[int, int, int]] = set()
        for (width, band), table in self.index.items():
            step = max(1, width // 2)
            n = np.maximum(np.diff(begin) - width + 1, 0)
            count = -(-n // step)
            row = np.repeat(np.arange(len(n)), count)
            at = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
            if not len(at):
                continue
            key = _band(hashes, width, band, at)
            maybe = np.flatnonzero(self.filters[width, band][(key & np.uint64(0xFFFF)).astype(np.int64)])
            for i in maybe.tolist():
                for t, p in table.get(int(key[i]), ()):
                    out.add((int(row[i]), t, int(at[i]) - p))
        return out

    def scan(self, column: pa.Array):
        """(row, template, first word, last word, containment, first character, end character) of every match."""
        at, data, starts, ends, first, hashes, begin = _shingled(column)
        by: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for row, t, place in self.candidates(hashes, begin):
            size = self.sizes[t]
            slack = size if size > 4 else 0
            a, b = max(int(begin[row]), place - slack), min(int(begin[row + 1]), place + size + slack)
            inside = np.flatnonzero(np.isin(hashes[a:b], self.sets[t]))
            share = len(np.unique(hashes[a:b][inside])) / len(self.sets[t])
            if share >= CONTAINMENT:
                by.setdefault((row, t), []).append((share, a + int(inside[0]), a + int(inside[-1])))
        for (row, t), found in sorted(by.items()):
            taken: list[tuple[int, int]] = []
            for share, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if any(a <= y and x <= b for x, y in taken):
                    continue
                taken.append((a, b))
                lead = int(begin[row])
                word = a - lead, b - lead + SHINGLE - 1
                low, high = int(starts[first[row] + word[0]]), int(ends[first[row] + word[1]])
                text = data[int(at[row]) : high].tobytes()
                cut = len(text[: low - int(at[row])].decode())
                yield row, t, word[0], word[1], share, cut, len(text.decode())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row a match: doc_id, template, first_word, last_word, containment, start_char, end_char (exclusive).

    Of overlapping matches of one template the fullest is returned; matches of different templates may overlap (a notice holds its own line).
    Null, empty and short texts match nothing. Repeated rows each give their matches.
    """
    ship(docs.sparkSession)
    chosen = dict(templates or TEMPLATES)
    schema = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64()), ("start_char", pa.int64()), ("end_char", pa.int64())])

    def run(batches):
        scanner = Scanner(chosen)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r], scanner.names[t], *rest) for r, t, *rest in scanner.scan(part.column("text"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(frugal(run), "doc_id bigint, template string, first_word bigint, last_word bigint, containment double, start_char bigint, end_char bigint")
