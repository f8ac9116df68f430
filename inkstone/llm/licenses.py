"""Licence scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

A document is scanned whole, line by line and paragraph by paragraph (blank lines apart). A unit with b distinct bigrams can reach
a Dice coefficient of t with a template of c only if min(b, c) >= t / (2 - t) * max(b, c); so units are measured first
and meet only the templates within these bounds, and of those only the ones that share a bigram. Notices inside a line or over
several paragraphs are found by windows of words: where a document has enough of a template's bigrams, windows from the least to the greatest size
that can match are placed where they hold most of them and cut back to the first and the last. A window counts where it overlaps no better match and
none of the same licence. Row-local: one pass, no shuffle; the templates are a fixed list and the full texts in license_texts.

Normalisation: ASCII lower case, words of letters, digits and non-ASCII characters; so punctuation, line breaks and
comment marks do not count. Templates may have placeholders (years, holders) that simply cost a few bigrams.

Defined cases: null and empty text match nothing; units of one word have one pseudo-bigram; of templates that tie, the name that
sorts first wins; repeated units count each; a very long text is scanned whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import bisect
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, blocks, grams
from ._store import bound_arrow_batches

DICE = 0.8

# Fixed public licence texts and notices, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((n, pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode()) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")),
)
#: Window sizes, in parts of a template's words.
SIZES = (2 / 3, 0.8, 1, 1.25, 1.5)


def bigram_sets(words: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """The distinct bigram hashes of the chosen units; first has each unit's first word and the total last."""
    out = []
    for u in chosen:
        w = words[first[u] : first[u + 1]]
        h, _ = grams(w, np.array([0, len(w)]), 2)
        out.append(np.unique(h if len(w) > 1 else w))
    return out


class Templates:
    """Templates by size, and the union of their bigrams."""

    def __init__(self, templates, dice: float):
        self.names = [n for n, _ in templates]
        self.sets, self.words = [], []
        for block in blocks(pa.array([t for _, t in templates], pa.string()), lower=True):
            starts, ends, first = block.spans(ALNUM)
            self.sets += bigram_sets(block.hashes(starts, ends), first, np.arange(block.rows))
            self.words += np.diff(first).tolist()
        self.dice, self.ratio = dice, dice / (2 - dice)
        self.sizes = np.array([len(s) for s in self.sets])
        self.bigrams = np.unique(np.concatenate(self.sets))
        self.has = np.array([np.isin(self.bigrams, x) for x in self.sets]).T  # bigram x template

    def best(self, unit: np.ndarray) -> tuple[str, float] | None:
        n = len(unit)
        if n > self.sizes.max() / self.ratio:
            return None
        found = []
        for i in np.flatnonzero((np.minimum(self.sizes, n) >= self.ratio * np.maximum(self.sizes, n))):
            common = len(np.intersect1d(unit, self.sets[i], assume_unique=True))
            if 2 * common >= self.dice * (n + self.sizes[i]):
                found.append((-2 * common / (n + self.sizes[i]), self.names[i]))
        return (min(found)[1], -min(found)[0]) if found else None


def windows(known: Templates, slots: np.ndarray, pairs: np.ndarray) -> list[tuple[float, str, int, int]]:
    """(-score, license, first word, end) of the windows of a document that match a template, best first, none overlapping.

    `slots` has for each bigram of the document its place in known.bigrams, or -1; `pairs` has its hash.
    """
    telling = np.flatnonzero(slots >= 0)
    mine = slots[telling]
    found = []
    for t in np.flatnonzero(known.has[mine].sum(axis=0) >= known.ratio * known.sizes):
        inside = known.has[mine, t]
        at, kind = telling[inside], mine[inside]
        c, least = known.sizes[t], known.ratio * known.sizes[t]
        if len(np.unique(kind)) < least:
            continue
        for part in SIZES:
            size = max(1, round(part * (known.words[t] - 1)))
            # the best window begins at one of the template's bigrams
            count = np.searchsorted(at, at + size) - np.arange(len(at))
            # fullest first, then in order; those that are passed over are set to zero
            order = np.flatnonzero(count >= least)
            for k in order[np.argsort(-count[order], kind="stable")].tolist():
                n = int(count[k])
                if not n:
                    continue
                a, b = int(at[k]), int(at[k + n - 1]) + 1
                common = len(np.unique(kind[k : k + n]))
                total = len(np.unique(pairs[a:b]))
                good = 2 * common >= known.dice * (total + c)
                if good:
                    found.append((-2 * common / (total + c), known.names[t], a, b + 1))
                # windows that begin nearby hold about the same; after a match, all that overlap it are passed over
                near = size if good else max(1, size // 16)
                count[np.searchsorted(at, a - near, "right") : np.searchsorted(at, a + near)] = 0
    taken, places = [], []
    for w in sorted(found, key=lambda w: (w[0], w[2] - w[3], w[1])):
        # those taken do not overlap, so only the neighbours can
        k = bisect.bisect(places, (w[2],))
        if (k == len(places) or places[k][0] >= w[3]) and (k == 0 or places[k - 1][1] <= w[2]):
            places.insert(k, (w[2], w[3]))
            taken.append(w)
    return taken


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row per document: doc_id, license (of the best match), score, n_matches, and matches (unit, start and end in bytes, license, score)."""
    bound_arrow_batches(docs.sparkSession)
    known = Templates(templates, dice)
    kind = pa.struct([("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                starts, ends, first = block.spans(ALNUM)
                words = block.hashes(starts, ends)
                pairs, at = grams(words, first, 2)
                # a word that begins a bigram of some template
                slot = np.minimum(np.searchsorted(known.bigrams, pairs), len(known.bigrams) - 1)
                telling = np.zeros(len(words) + 1, np.int64)
                equal = known.bigrams[slot] == pairs
                telling[at[equal] + 1] = 1
                places = np.full(len(words), -1, np.int64)
                places[at[equal]] = slot[equal]
                spread = np.zeros(len(words), pairs.dtype)
                spread[at] = pairs
                telling = np.cumsum(telling)
                l_starts, l_ends, l_first = block.lines()
                w_first = np.searchsorted(starts, l_starts)
                w_last = np.searchsorted(starts, l_ends)
                hits: list[list] = [[] for _ in range(block.rows)]

                def weigh(name: str, row: int, a: int, b: int, wa: int, wb: int) -> None:
                    n = wb - wa
                    if not n or telling[wb] == telling[wa]:
                        return
                    unit = bigram_sets(words[wa:wb], np.array([0, n]), np.array([0]))[0]
                    if m := known.best(unit):
                        hits[row].append({"unit": name, "start": int(a), "end": int(b), "license": m[0], "score": float(m[1])})

                has = telling[first[1:]] > telling[first[:-1]]
                for row in np.flatnonzero(has):
                    base = block.off[row]
                    la, lb = int(l_first[row]), int(l_first[row + 1])
                    weigh("document", row, 0, block.off[row + 1] - base, first[row], first[row + 1])
                    opened = None
                    for i in range(la, lb + 1) if lb - la > 1 else ():
                        blank = i == lb or w_first[i] == w_last[i]
                        if not blank:
                            weigh("line", row, l_starts[i] - base, l_ends[i] - base, w_first[i], w_last[i])
                            opened = i if opened is None else opened
                        elif opened is not None:
                            if i - opened > 1 and not (opened == la and i == lb):
                                weigh("paragraph", row, l_starts[opened] - base, l_ends[i - 1] - base, w_first[opened], w_last[i - 1])
                            opened = None
                    units = [np.array([u[c] for u in hits[row]]) for c in ("start", "end", "license", "score")]
                    for score, name, wa, wb in windows(known, places[first[row] : first[row + 1]], spread[first[row] : first[row + 1]]):
                        a, b = int(starts[first[row] + wa] - base), int(ends[first[row] + wb - 1] - base)
                        if not len(units[0]) or ((b <= units[0]) | (a >= units[1]) | ((units[2] != name) & (units[3] < -score))).all():
                            hits[row].append({"unit": "window", "start": a, "end": b, "license": name, "score": float(-score)})
                best = [min(((-h["score"], h["license"]) for h in x), default=None) for x in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), pa.array([b[1] if b else None for b in best], pa.string()), pa.array([-b[0] if b else None for b in best], pa.float64()), pa.array([len(x) for x in hits], pa.int64()), pa.array(hits, pa.list_(kind))],
                    names=["doc_id", "license", "score", "n_matches", "matches"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, license string, score double, n_matches long, matches array<struct<unit:string,start:long,end:long,license:string,score:double>>")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Query: licences named in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
