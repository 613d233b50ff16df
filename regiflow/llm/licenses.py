"""Licence scan: text passages against licence templates.

Text and templates are normalised to lower-case words of letters and digits.
A passage is compared with a template by the Dice coefficient over the
multisets of their word bigrams.  At a coefficient of t or more the passage has
between t / (2 - t) and (2 - t) / t times the template's bigrams, and the two
share at least t / (2 - t) of them; passages outside these bounds are never
compared, and neither are texts without one of a template's anchor words
(chosen so that too few bigrams are left without them).

One pass over the texts, no shuffle.  The templates are a parameter; they are
a small table that every task holds.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect, bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9]+")

# Licence notices and permission texts (fixed values).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
    FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AUTHOR_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FREE_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Whole texts of the short licences (fixed values), without their titles and copyright lines.
FULL_TEXTS = (
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. {_AS_IS}"""),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"""{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"""),
    ("ISC", f"""{_FREE_USE}, provided that the above copyright notice and this permission notice appear in all copies.
        {_AUTHOR_DISCLAIMS}"""),
    ("0BSD", f"{_FREE_USE}. {_AUTHOR_DISCLAIMS}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
        the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
        whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
        TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY
        DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
        in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
)
TEMPLATES = NOTICES + FULL_TEXTS


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Template:
    """A template with its bigram counts and bounds at a threshold."""

    license: str
    number: int
    words: list[str]
    threshold: float
    grams: Counter = field(init=False)
    anchors: list[str] = field(init=False)

    def __post_init__(self):
        self.grams = Counter(bigrams(self.words))
        self.size = sum(self.grams.values())
        ratio = self.threshold / (2 - self.threshold)
        self.least, self.most = math.ceil(ratio * self.size - 1e-9), math.floor(self.size / ratio + 1e-9)
        # Longest words first, until the bigrams without any of them are too few for a match.
        self.anchors = []
        for w in sorted(set(self.words), key=lambda w: (-len(w), w)):
            if sum(n for g, n in self.grams.items() if not set(g) & set(self.anchors)) < self.least:
                break
            self.anchors.append(w)

    def dice(self, grams: list[tuple[str, str]]) -> float:
        shared = sum((Counter(grams) & self.grams).values())
        return 2 * shared / (len(grams) + self.size)


def compiled(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    return [Template(name, i, words_of(text), threshold) for i, (name, text) in enumerate(templates)]


def _best_from(grams: list, hits: list[int], t: Template, k: int, end: int):
    """The closest passage (Dice, first, last bigram) that begins on hit ``k``
    and ends on a hit before ``end``; None below the threshold."""
    x, shared, best = hits[k], 0, None
    have: Counter = Counter()
    for j in range(k, len(hits)):
        y = hits[j]
        if y >= end or y - x >= t.most:
            break
        g = grams[y]
        have[g] += 1
        if have[g] <= t.grams[g]:
            shared += 1
            score = 2 * shared / (y - x + 1 + t.size)
            if score >= t.threshold - 1e-9 and (best is None or score > best[0]):
                best = score, x, y
    return best


def _passages(grams: list, hits: list[int], t: Template):
    """Passages (Dice, first, last bigram) that match ``t``, of every size
    within bounds: the closest one first, then those that share no word with
    it.  A closest passage begins and ends on a hit."""
    heap = []
    for k in range(len(hits) - t.least + 1):
        if hits[k + t.least - 1] - hits[k] < t.most:        # else too few hits for a match
            best = _best_from(grams, hits, t, k, hits[-1] + 1)
            if best:
                heap.append((-best[0], best[1], best[2], k))
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    while heap:
        score, x, y, k = heapq.heappop(heap)
        i = bisect(taken, (x, y))
        if i and taken[i - 1][1] + 1 >= x:
            continue
        if i < len(taken) and taken[i][0] <= y + 1:         # what fits before the next one
            best = _best_from(grams, hits, t, k, taken[i][0] - 1)
            if best:
                heapq.heappush(heap, (-best[0], best[1], best[2], k))
            continue
        taken.insert(i, (x, y))
        yield -score, x, y


def findings(text: str, templates: list[Template]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, licence, template number, Dice) of the matches in one
    text, in code points, by start; of overlapping matches the longest, then
    the closest stays, and the other's template is sought again around it."""
    low = text.lower()
    if len(low) != len(text):               # a letter whose lower case is longer: keep positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    present = {a for a in {a for t in templates for a in t.anchors} if a in low}
    near = [t for t in templates if not present.isdisjoint(t.anchors)]
    if not near:
        return []
    places = list(_WORD.finditer(low))
    grams = bigrams([m.group() for m in places])
    at: dict = {}
    known = set().union(*(t.grams for t in near))
    for i, g in enumerate(grams):
        if g in known:
            at.setdefault(g, []).append(i)
    heap, hits_of = [], {}

    def put(t: Template, hits: list[int]) -> None:
        for score, x, y in _passages(grams, hits, t):
            heapq.heappush(heap, (x - y, -score, x, t.number, y))

    for t in near:
        hits = sorted(i for g in t.grams for i in at.get(g, ()))
        if len(hits) >= t.least:
            hits_of[t.number] = t, hits
            put(t, hits)
    taken: list[tuple[int, int]] = []           # first and last bigram, by place
    out = []
    while heap:
        _, score, x, number, y = heapq.heappop(heap)
        t, hits = hits_of[number]
        i = bisect(taken, (x, y))
        if i and taken[i - 1][1] + 1 >= x or i < len(taken) and taken[i][0] <= y + 1:
            # Other passages of the template may lie in what is left free around this one.
            low_end, high_end = x - t.most, y + t.most
            while i and taken[i - 1][1] >= low_end:
                i -= 1
            start = low_end
            while start <= high_end:
                stop = min(high_end + 1, taken[i][0] - 1) if i < len(taken) else high_end + 1
                put(t, hits[bisect_left(hits, start):bisect_left(hits, stop)])
                if i == len(taken):
                    break
                start = max(start, taken[i][1] + 2)
                i += 1
            continue
        taken.insert(i, (x, y))
        out.append((places[x].start(), places[y + 1].end(), t.license, number, -score))
    return sorted(out)


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, n_findings, licenses, findings)``, one row per row of
    ``docs``: ``licenses`` are the distinct names, sorted; a finding has
    ``start``, ``end`` (code points), ``license``, ``template`` and ``dice``.

    Defined results: a null text counts as empty; texts without a match have
    empty arrays; repeated rows are scanned each; null ids stay null; an empty
    table gives no rows; other columns are not read.
    """
    schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
                                 ("template", pa.int32()), ("dice", pa.float64())]))

    def run(batches):
        known = compiled(templates, threshold)
        for batch in batches:
            found = [findings(t.as_py(), known) for t in batch.column(1)]
            rows = [[dict(zip(("start", "end", "license", "template", "dice"), f)) for f in fs] for fs in found]
            names = [sorted({f[2] for f in fs}) for fs in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(names, pa.list_(pa.string())),
                 pa.array(rows, schema)],
                ["doc_id", "n_findings", "licenses", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_findings long, licenses array<string>, "
             "findings array<struct<start:bigint,end:bigint,license:string,template:int,dice:double>>")
