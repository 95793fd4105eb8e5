"""License scans: winnowed template fingerprints pick candidates, a banded alignment settles them.

Templates are few and fixed, so their inverted index (gram hash to template and place) goes to every
task; its size is checked.  Document grams that it knows are gathered by template and diagonal, and
the words around each gathered stretch are aligned with the template inside a narrow band.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import text_of
from scorelake.llm.decontaminate import CHUNK, Words, _chunks, _powers, winnowed

#: Words of a gram, and grams of a winnowing window: every 5 shared words hold a kept gram.
GRAM, WINDOW = 3, 3
#: Templates of fewer words are found by grams of two words, all of them kept: what covers them without insertions holds one.
SHORT, SHORT_GRAM = 20, 2
#: Words that an alignment may drift to either side (a fourth of a longer template), and the share of a template's words it must cover.
BAND, COVERAGE = 8, 0.8
#: Grams of all templates, at most; 24 bytes each.
INDEX_GRAMS = 1_000_000

# Public license notices, as they are printed in files.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "AGPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."),
    "MIT-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"),
    "Artistic-2.0-notice": "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is "
        "changed."),
}
# Identifiers that a tag line in a file's head can name; every word of such a line must be there.
TAG = "SPDX-License-Identifier: "
IDENTIFIERS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only MIT MPL-2.0 Unlicense WTFPL Zlib").split()
TEMPLATES |= {f"SPDX-{i}": TAG + i for i in IDENTIFIERS}


class Index:
    """Sorted gram hashes of all templates with template and place, and the templates' word hashes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        raw = [templates[n].encode() for n in self.names]
        words = Words(raw, _powers(sum(map(len, raw)) + len(raw) + 1))
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        size = np.array([len(w) for w in self.words], np.int64)
        self.needed = [len(w) if templates[n].startswith(TAG) else math.ceil(COVERAGE * len(w) - 1e-9) for n, w in zip(self.names, self.words)]
        #: Per gram size: sorted hashes, their templates and places; all grams of a template.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for gram, wanted in ((GRAM, size >= SHORT), (SHORT_GRAM, size < SHORT)):
            h, valid = words.grams(gram)
            at = np.flatnonzero(valid & wanted[words.text[:len(h)]])
            at = at[np.argsort(h[at], kind="stable")]
            self.grams[gram] = h[at], words.text[at], at - words.first[words.text[at]]
        if sum(len(h) for h, _, _ in self.grams.values()) > INDEX_GRAMS:
            raise ValueError("too many license templates for an index that every task holds")


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched words, first word, end): the template against a stretch of words."""
    return tuple(int(x[0]) for x in align_many(template, words[None, :], band))


def align_many(template: np.ndarray, words: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched words, first word and end for stretches of one length, a row each.

    Longest common subsequence within a band around the diagonal; the stretch's extra words widen it
    to the right.  Of equal ones the last to begin, then the first to end.
    """
    n, m = len(template), words.shape[1]
    slack = max(0, m - n) + band
    best = np.zeros((len(words), m + 1), np.int64)  # matches above 32 bits of the first matched word: the best within the first j words
    for i in range(n):
        low, high = min(m, max(0, i - band)), min(m, i + slack + 1)
        before, place = best[:, low:high], np.arange(low, high)
        longer = np.where(before >> 32 > 0, before + (1 << 32), (1 << 32) | place)
        way = np.maximum(best[:, low + 1:high + 1], np.where(words[:, low:high] == template[i], longer, 0))
        best[:, low:] = np.maximum.accumulate(np.concatenate([best[:, low:low + 1], way, best[:, high + 1:]], axis=1), axis=1)
    last = best[:, -1]
    return last >> 32, last & 0xFFFFFFFF, np.argmax(best == last[:, None], axis=1)


def _band(size: int) -> int:
    """Short templates drift less, so that neighbouring copies stay apart."""
    return min(max(BAND, size // 4), size // 2)


def _stretches(index: Index, words: Words, hits: dict[tuple[int, int], set[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each template and length the stretches (first word, text) around the gathered hits, with a band of words to either side.

    hits: diagonals by (text, template).  Words put in between move the rest of a long template to later
    diagonals: up to the last one within three fourths of its length it is one stretch as well.
    """
    out: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for (of, template), found in hits.items():
        first, last = int(words.first[of]), int(words.first[of + 1])
        size = len(index.words[template])
        drift = _band(size)
        starts = np.array(sorted(found))
        later = starts[np.searchsorted(starts, starts + size * 3 // 4) - 1]
        for start, far in zip(starts.tolist(), later.tolist()):
            for stop in {start, far if size >= SHORT else start}:
                a, b = max(first, start - drift), min(last, stop + size + drift)
                if b - a >= index.needed[template]:
                    out[template, b - a].add((a, of))
    return {k: sorted(v) for k, v in out.items()}


def scan(index: Index, texts: list[bytes], powers) -> list[list[tuple]]:
    """Per text (template, start, end, matched, coverage); bytes offsets of the first and last matched word."""
    words = Words(texts, powers)
    gathered: dict[tuple[int, int, int], int] = {}
    for gram, (known, templates, places) in index.grams.items():
        h, valid = words.grams(gram)
        at = winnowed(h, valid, WINDOW) if gram == GRAM else np.flatnonzero(valid)
        low = np.searchsorted(known, h[at])
        hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h[at]) if len(known) else np.zeros(0, np.int64)
        high = np.searchsorted(known, h[at[hit]], side="right")
        for k, top in zip(hit.tolist(), high.tolist()):
            of = int(words.text[at[k]])
            for e in range(int(low[k]), top):
                template, start = int(templates[e]), int(at[k]) - int(places[e])
                # hits of one template on neighbouring diagonals are one candidate
                gathered.setdefault((of, template, start // max(1, min(BAND, len(index.words[template]) // 2) // 2)), start)
    hits: dict[tuple[int, int], set[int]] = defaultdict(set)
    for (of, template, _), start in gathered.items():
        hits[of, template].add(start)
    found: list[set[tuple]] = [set() for _ in texts]
    for (template, size), stretches in _stretches(index, words, hits).items():
        held = np.concatenate([[0], np.cumsum(np.isin(words.hash, index.words[template]))])
        start = np.array([a for a, _ in stretches])
        enough = np.flatnonzero(held[start + size] - held[start] >= index.needed[template])
        for some in np.array_split(enough, max(1, len(enough) * size // (1 << 19))):
            if not len(some):
                continue
            rows = words.hash[start[some][:, None] + np.arange(size)]
            for k, matched, s, e in zip(some.tolist(), *(x.tolist() for x in align_many(index.words[template], rows, _band(len(index.words[template]))))):
                if matched >= index.needed[template]:
                    a, of = stretches[k]
                    found[of].add((matched, matched / len(index.words[template]), -(a + s), -(a + e), -template))
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out: list[list[tuple]] = []
    for of, own in enumerate(found):
        starts, ends, rows = [], [], []  # of the matches that stay; they do not overlap
        for matched, coverage, s, e, template in sorted(own, reverse=True):
            s, e = -s, -e
            k = bisect_left(starts, e)
            if not k or ends[k - 1] <= s:
                starts.insert(k, s)
                ends.insert(k, e)
                rows.append((int(words.start[s] - base[of]), int(words.end[e - 1] - base[of]), index.names[-template], matched, coverage))
        out.append(sorted(rows))
    return out


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text); its size is checked before it is fetched.  Missing values are left out."""
    known = table.where("license IS NOT NULL AND text IS NOT NULL")
    if (known.agg(F.sum(F.length("text"))).first()[0] or 0) > 8 * INDEX_GRAMS:
        raise ValueError("too many license templates for an index that every task holds")
    return {r.license: r.text for r in known.collect()}


def licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per license text found: doc_id, license, start, end, n_matched, coverage.

    start and end are code points of the whole text, end exclusive; n_matched the template's words
    found in order, coverage their share of it, ``COVERAGE`` at least.  Of matches that overlap in a
    document the one with most words stays, then the higher coverage, the earlier place and the
    later end.  Documents without a license, null or empty ones give no row.  ``templates`` are the
    built-in notices unless given, as names and texts or as a table (license, text).  Words put into a
    text in one place are bridged up to three fourths of the template's length.
    """
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK * 2)
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for start, chunk in _chunks(texts):
                for i, found in enumerate(scan(index.value, chunk, powers)):
                    for s, e, name, matched, coverage in found:
                        before = len(chunk[i][:s].decode("utf-8", "surrogatepass"))
                        rows.append((ids[start + i], name, before, before + len(chunk[i][s:e].decode("utf-8", "surrogatepass")), matched, coverage))
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field("doc_id").type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "license", "start", "end", "n_matched", "coverage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, license string, start bigint, end bigint, n_matched bigint, coverage double")
