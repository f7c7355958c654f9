"""Licence scans: texts against licence templates by the Dice coefficient of their word bigrams.

A text is normalised (lower case, ASCII punctuation is space) and taken in units:
every line, every paragraph of several lines, and the whole text if it has several
paragraphs.  A unit and a template agree by ``2 * common / (own + template)`` over
their distinct word bigrams.  As that can reach ``LEAST_PERCENT`` only if the numbers of
bigrams are close, most units never meet a template: a unit is looked at only if
its size is within the bounds of some template, and counted only against those.

Licences inside longer texts are *passages*: runs of consecutive sentences, across
lines and paragraphs.  A sentence ends with its line, or with ``.``, ``!``, ``?``, ``:`` or ``;``
before white space.  A template is looked for only in texts that hold so many of its
bigrams as the smallest similar unit must share with it.  There, runs begin and end at
sentences that share a bigram with it (any other run is no more similar without its ends) and grow while
their bigrams are within its bounds.  Of runs that
overlap the most similar counts, of equals the one with fewer sentences, then the earlier, then the
first by name.  A passage is left out where a reported line, paragraph or text overlaps it
that has the same licence or is as similar.

Defined cases: null texts and units of fewer than two words match nothing; of
several templates the most similar one counts, of equals the first by name;
repeated rows each get their result; an empty table gives an empty result; without
templates nothing is found; texts of any length are taken whole; other columns are left alone.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import U, Words, mixed, slices, utf8

LEAST_PERCENT = 80

# Licence texts and notices, fixed values.
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
        " any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public"
        " License for more details. You should have received a copy of the GNU Affero General Public License along with this"
        " program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details. You should have received a copy of the GNU General Public License along with this"
        " program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA"
        " 02110-1301 USA.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS"
        ' PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED'
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,"
        " OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
        " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option)"
        " any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public"
        " License for more details. You should have received a copy of the GNU Lesser General Public License along with this"
        " library; if not, see <https://www.gnu.org/licenses/>.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        ' Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
        " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or"
        " authors of this software dedicate any and all copyright interest in the software to the public domain. We make this"
        " dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this"
        " dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software"
        ' under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
        " EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum() and i != 10]] = 32


class Templates:
    """Templates as sets of bigram hashes, with the sizes a similar unit can have."""

    def __init__(self, texts: dict[str, tuple[str, ...]], least: int):
        self.least = least
        self.names, sets = [], []
        for name in sorted(texts):
            for text in texts[name]:
                data, starts = utf8(pa.array([text]))
                data = np.where(data == 10, np.uint8(32), _PLAIN[data])
                self.names.append(name)
                sets.append(np.unique(Words(data, starts).shingles(2)[0]))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.least_size = -(-self.sizes * least // (200 - least))
        self.most_size = self.sizes * (200 - least) // least
        #: Bigrams that the smallest similar unit shares with each template.
        self.least_common = -(-least * (self.least_size + self.sizes) // 200)
        self.fits = np.zeros(self.most_size.max(initial=0) + 1, bool)
        for lo, hi in zip(self.least_size, self.most_size):
            self.fits[lo : hi + 1] = True
        self.sets = sets
        hashes = np.concatenate(sets or [np.zeros(0, U)])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def match(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units of bytes, ascending and apart: unit, template and Dice coefficient of each similar pair."""
        bounds = np.stack((begins, ends), axis=1).ravel()
        words = Words(data, np.append(bounds, len(data)) if len(bounds) else np.zeros(1, np.int64))
        # every other text is a unit, the rest lies between units
        n_words = words.counts()[: 2 * len(begins) : 2]
        most = len(self.fits)
        unit = np.flatnonzero((n_words >= 2) & (n_words - 1 >= self.least_size.min(initial=1 << 40)))
        found = []
        for u in unit:
            a, b = words.first[2 * u], words.first[2 * u + 1]
            found.append((u, a, b))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # neighbouring words in one unit
        owner = np.concatenate([np.full(b - a - 1, u) for u, a, b in found])
        at = np.concatenate([np.arange(a, b - 1) for u, a, b in found])
        pair = _bigrams(words.hashes, at)
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        fresh = np.concatenate(([True], (np.diff(owner) != 0) | (pair[1:] != pair[:-1])))
        owner, pair = owner[fresh], pair[fresh]
        size = np.bincount(owner, minlength=len(begins))
        fits = (size < most) & self.fits[np.minimum(size, most - 1)]
        keep = fits[owner]
        owner, pair = owner[keep], pair[keep]
        lo, hi = np.searchsorted(self.hashes, pair, "left"), np.searchsorted(self.hashes, pair, "right")
        times = hi - lo
        who = np.repeat(owner, times)
        which = self.owners[np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
        key, common = np.unique(who * len(self.names) + which, return_counts=True)
        who, which = key // len(self.names), key % len(self.names)
        allowed = (size[who] >= self.least_size[which]) & (size[who] <= self.most_size[which])
        both = size[who] + self.sizes[which]
        good = allowed & (200 * common >= self.least * both)
        return who[good], which[good], (2.0 * common / both)[good]


def _bigrams(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same hashes as ``Words.shingles(2)`` gives."""
    factors = mixed(np.arange(1, 3, dtype=U)) | U(1)
    return mixed(U(2) + hashes[at] * factors[0] + hashes[at + 1] * factors[1])


_LINE, _PARAGRAPH, _DOCUMENT = "line", "paragraph", "document"


def _units(starts: np.ndarray, data: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(scope, begins, ends, row, first line)`` for each kind of unit."""
    newline = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate((starts, newline + 1)))
    begins, ends = cut[:-1], np.append(cut[1:-1], len(data)) if len(cut) > 1 else cut[:-1]
    begins, ends = begins[begins < len(data)], ends[begins < len(data)]
    row = np.searchsorted(starts, begins, "right") - 1
    first = np.searchsorted(begins, starts[:-1], "left")
    line = np.arange(len(begins)) - first[row]
    yield _LINE, begins, ends, row, line
    blank = np.array([not (data[a:b] != 32).any() or not ((data[a:b] != 32) & (data[a:b] != 10)).any() for a, b in zip(begins, ends)], bool)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | blank[:-1])) & ~blank if len(begins) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    full = np.flatnonzero(~blank)
    if len(full):
        head = np.flatnonzero(new)
        last = full[np.append(np.flatnonzero(np.diff(group[full])), len(full) - 1)]
        several = last > head
        yield _PARAGRAPH, begins[head[several]], ends[last[several]], row[head[several]], line[head[several]]
        whole = np.flatnonzero(np.bincount(row[head], minlength=len(starts) - 1) > 1)
        yield _DOCUMENT, starts[whole], starts[whole + 1], whole, np.zeros(len(whole), np.int64)


_PASSAGE = "passage"
_SENTENCE_ENDS = np.zeros(256, bool)
_SENTENCE_ENDS[list(b".!?:;")] = True


def _sentences(data: np.ndarray, plain: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where sentences begin, as places in the bytes of some texts, with the end of all."""
    blank = np.append(np.isin(data[1:], (32, 9, 10, 13)), True)
    ends = np.flatnonzero((plain == 10) | (_SENTENCE_ENDS[data] & blank)) + 1
    return np.unique(np.concatenate((starts, ends[ends < len(data)])))


class Passages:
    """Runs of sentences of some texts that are similar to a template."""

    def __init__(self, templates: Templates, data: np.ndarray, plain: np.ndarray, starts: np.ndarray):
        self.templates, self.cuts = templates, _sentences(data, plain, starts)
        self.words = words = Words(np.where(plain == 10, np.uint8(32), plain), self.cuts)
        n = len(words.hashes)
        text_of_word = np.searchsorted(starts, words.begin, "right") - 1
        at = np.flatnonzero(text_of_word[1:] == text_of_word[:-1])  # the next word is in the same text
        self.pair = np.zeros(n, U)
        self.pair[at] = _bigrams(words.hashes, at)
        self.is_pair = np.zeros(n, bool)
        self.is_pair[at] = True
        lo, hi = (np.searchsorted(templates.hashes, self.pair[at], side) for side in ("left", "right"))
        times = hi - lo
        self.hit_at = np.repeat(at, times)
        index = np.arange(len(self.hit_at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        self.hit_owner, self.hit_text = templates.owners[index], text_of_word[self.hit_at]

    def candidates(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Text, template and the words where its bigrams begin, of texts with enough different ones."""
        key = self.hit_text * len(self.templates.names) + self.hit_owner
        order = np.lexsort((self.pair[self.hit_at], key))
        k, p = key[order], self.pair[self.hit_at][order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))[: len(k)]
        which, distinct = np.unique(k[fresh], return_counts=True)
        good = which[distinct >= self.templates.least_common[which % len(self.templates.names)]]
        if not len(good):
            return
        chosen = np.isin(key, good)
        key, at = key[chosen], self.hit_at[chosen]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        for g, lo, hi in zip(good.tolist(), np.searchsorted(key, good, "left"), np.searchsorted(key, good, "right")):
            yield g // len(self.templates.names), g % len(self.templates.names), at[lo:hi]

    def runs(self, template: int, hits: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """First sentence, last sentence and coefficient of each similar run that begins and ends with a hit."""
        t, first = self.templates, self.words.first
        size, most, least = int(t.sizes[template]), int(t.most_size[template]), t.least
        # a bigram counts where both its words are in the run
        begins = np.unique(np.searchsorted(first, hits, "right") - 1)
        ends = np.unique(np.searchsorted(first, hits + 1, "right") - 1)
        wanted = set(t.sets[template].tolist())
        last = int(ends[-1])
        is_end = np.zeros(last + 1, bool)
        is_end[ends] = True
        for i in begins.tolist():
            own: set[int] = set()
            common, after = 0, int(first[i + 1])
            # the run is no more similar than without its first sentence once that one's hits have come again
            only_here = wanted.intersection(self.pair[first[i] : after][self.is_pair[first[i] : after]].tolist())
            for j in range(i, last + 1):
                # with this sentence: the bigram that leads into it, and those inside
                for w in range(max(int(first[i]), int(first[j]) - 1), int(first[j + 1]) - 1):
                    p = int(self.pair[w])
                    if w >= after:
                        only_here.discard(p)
                    if p not in own and self.is_pair[w]:
                        own.add(p)
                        common += p in wanted
                if len(own) > most or not only_here:
                    break
                if is_end[j] and 200 * common >= least * (len(own) + size):
                    yield i, j, 2.0 * common / (len(own) + size)

    def found(self) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, template, first and end byte and coefficient of passages, which do not overlap."""
        runs: dict[int, list[tuple]] = {}
        for text, template, hits in self.candidates():
            runs.setdefault(text, []).extend((-d, j - i, i, template, j) for i, j, d in self.runs(template, hits))
        for text, own in runs.items():
            taken: list[tuple[int, int]] = []  # ascending and apart
            for d, _, i, template, j in sorted(own):
                k = bisect(taken, (i, j))
                if (k == 0 or taken[k - 1][1] < i) and (k == len(taken) or taken[k][0] > j):
                    taken.insert(k, (i, j))
                    yield text, template, int(self.cuts[i]), int(self.cuts[j + 1]), -d


_FOUND = "doc_id long, license string, scope string, line long, dice double"


def _scan(texts: dict[str, tuple[str, ...]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, least)
        for batch in batches:
            data, starts = utf8(batch.column(1))
            out: list[tuple] = []
            for lo, hi in slices(starts):
                raw, at_0 = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
                plain = _PLAIN[raw]
                reported: dict[int, list[tuple]] = {}
                for scope, begins, ends, row, line in _units(at_0, plain):
                    unit, which, dice = templates.match(plain, begins, ends)
                    best: dict[int, tuple] = {}
                    for u, w, d in zip(unit.tolist(), which.tolist(), dice.tolist()):
                        if u not in best or d > best[u][1]:
                            best[u] = (w, d)
                    for u, (w, d) in best.items():
                        out.append((lo + int(row[u]), templates.names[w], scope, int(line[u]), d))
                        reported.setdefault(int(row[u]), []).append((int(begins[u]), int(ends[u]), templates.names[w], d))
                for row, w, begin, end, d in Passages(templates, raw, plain, at_0).found():
                    name, units = templates.names[w], reported.get(row, ())
                    if not any(a < end and begin < b and (other == name or e >= d) for a, b, other, e in units):
                        line = int(np.count_nonzero(plain[at_0[row] : begin] == 10))
                        out.append((lo + row, name, _PASSAGE, line, d))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()),
                ],
                names=["doc_id", "license", "scope", "line", "dice"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: int = LEAST_PERCENT) -> DataFrame:
    """``doc_id, license, scope, line, dice``: units that are a licence, with the number of their first line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates, least), _FOUND)
