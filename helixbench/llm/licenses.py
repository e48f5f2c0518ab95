"""License scans by patience alignment of texts with license templates.

Words that occur once in a stretch of the text and once in the template anchor each other; the longest run of
anchors that rises in both is kept, and the gaps between them are aligned in the same way, down to gaps without a
common unique word, whose equal words at both ends match. The coverage is the share of the template's words that
are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
#: The texts of common short licenses, the notices that point to long ones, and lines that name one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": _MIT,
    "MIT text": f"{_MIT} {_WARRANTY}",
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD conditions": _BSD,
    "BSD-2-Clause text": f"{_BSD} {_BSD_WARRANTY}",
    "BSD-3-Clause text": (
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission. {_BSD_WARRANTY}"
    ),
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "Unlicense dedication": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "GPL-3.0 terms": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All rights reserved": "All rights reserved.",
}


def _low(text: str) -> str:
    """The text in lower case, letter by letter: places stay those of the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str) -> list[str]:
    return _WORD.findall(_low(text))


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first value, whose second values rise (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[pile], at[pile] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        seen, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if seen[w] == 1}
        anchors = rising(sorted((place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place))
        low, first = a, c
        for i, j in anchors:
            out.append((i, j))
            work.append((low, i, first, j))
            low, first = i + 1, j + 1
        if anchors:
            work.append((low, b, first, d))
    return sorted(out)


def masks(template: list[str]) -> dict[str, int]:
    """For each word the bits of its places in the template."""
    out: dict[str, int] = {}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


def common_length(text: list[str], where: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of the text and a template of ``size`` words, whose ``masks`` are
    given: all places of a row of the usual table at once, one bit each, clear where the row's value rises."""
    whole = (1 << size) - 1
    flat = whole
    for w in text:
        if there := where.get(w):
            met = flat & there
            flat = (flat + met | flat - met) & whole
    return size - flat.bit_count()


@lru_cache(maxsize=4)
def _finder(every: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds any of the words in a text, be it within a longer word."""
    found = ahocorasick.Automaton()
    for w in every:
        found.add_word(w, w)
    found.make_automaton()
    return found


class Scanner:
    """Templates and the words that a covered stretch must hold some of."""

    def __init__(self, templates: dict[str, str], least: float, spread: float):
        self.templates = {name: words(t) for name, t in templates.items()}
        self.least, self.spread = least, spread
        count = Counter(w for t in self.templates.values() for w in set(t))
        self.signs: dict[str, set[str]] = {}
        for name, t in self.templates.items():
            # The rarest and longest words, until the others alone could not reach the coverage.
            own, rest = set(), Counter(t)
            for w in sorted(rest, key=lambda w: (-len(w), count[w], w)):
                if sum(n for x, n in rest.items() if x not in own) / len(t) < least:
                    break
                own.add(w)
            self.signs[name] = own
        self.masks = {name: masks(t) for name, t in self.templates.items()}
        self.every = tuple(sorted({w for s in self.signs.values() for w in s}))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int, int, float]]:
        """(template, words matched, first word, last word, first character, end character, coverage) of each
        stretch of the text that covers a template, in order; of nested ones only the outer one."""
        low = _low(text or "")
        if next(_finder(self.every).iter(low), None) is None:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        tokens = [low[a:b] for a, b in spans]
        held: dict[str, list[int]] = {}
        for i, w in enumerate(tokens):
            held.setdefault(w, []).append(i)
        out = []
        for name, template in self.templates.items():
            at = sorted(i for w in self.signs[name] for i in held.get(w, ()))
            reach = int(self.spread * len(template))
            for a, b in _stretches(at, reach):  # no stretch is covered without a sign, so all lie within a reach of one
                for found in self._covered(tokens, template, self.masks[name], max(0, a - reach), min(len(tokens), b + reach), reach):
                    first, last = found[0][0], found[-1][0]
                    out.append((name, len(found), first, last, spans[first][0], spans[last][1], len(found) / len(template)))
        return sorted(_outer(out), key=lambda r: (r[2], r[0]))

    def _covered(self, tokens: list[str], template: list[str], where: dict[str, int], low: int, high: int, reach: int):
        """Alignments that cover the template, one after the other, none over another. Every window of ``reach`` words
        in low .. high-1 whose words alone could cover it is aligned, and where it does, again from its first word on
        in narrower windows too, as another copy close behind would leave few words unique. No alignment is longer
        than the longest common subsequence, which grows by at most one for each word that the window moves on: a
        window that lacks n words is followed by n - 1 that need no look."""
        need = -int(-self.least * len(template) // 1)
        wanted, seen, common = Counter(template), Counter(), 0
        a = b = low
        while a < high:
            while b < min(high, a + reach):
                seen[tokens[b]] += 1
                common += seen[tokens[b]] <= wanted[tokens[b]]
                b += 1
            step = 1
            if common >= need:
                lacking = need - common_length(tokens[a:b], where, len(template))
                found = self._at(tokens, template, a, b) if lacking <= 0 else []
                if lacking > 0:
                    step = lacking
                elif len(found) >= need:
                    start = found[0][0]
                    widths = {min(high - start, int(len(template) * x)) for x in (1.0, 1.1, 1.25, 1.5, self.spread)}
                    found = max((self._at(tokens, template, start, start + n) for n in sorted(widths)), key=lambda f: (len(f), -f[-1][0] if f else 0))
                    found = found if len(found) >= need else self._at(tokens, template, a, b)
                    yield found
                    step = found[-1][0] + 1 - a
            for i in range(a, min(a + step, b)):
                common -= seen[tokens[i]] <= wanted[tokens[i]]
                seen[tokens[i]] -= 1
            a += step
            b = max(a, b)

    @staticmethod
    def _at(tokens: list[str], template: list[str], a: int, b: int) -> list[tuple[int, int]]:
        return [(a + i, j) for i, j in align(tokens[a:b], template)]


def _outer(found: list[tuple]) -> list[tuple]:
    """Without stretches that lie within one of another template that matches more words."""
    return [x for x in found if not any(y[0] != x[0] and y[2] <= x[2] and x[3] <= y[3] and (y[1], x[0]) > (x[1], y[0]) for y in found)]


def _stretches(at: list[int], reach: int):
    """Runs of positions no further apart than ``reach``."""
    start = 0
    for i in range(1, len(at) + 1):
        if i == len(at) or at[i] - at[i - 1] > reach:
            yield at[start], at[i - 1] + 1
            start = i


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = 0.75, spread: float = 2.0) -> DataFrame:
    """(key, license, matched, template_words, coverage, first_word, last_word, start, end): each stretch of a text
    that covers at least ``least`` of a template's words in order; start and end count characters of the text as it
    is. A license that is broken up by other words counts as long as the stretch has at most ``spread`` words for each
    word of the template. Of stretches within each other only the one that matches most is reported (a license's name
    within its notice, for instance); stretches of one template never overlap. A text has as many rows as stretches,
    none if it is null, empty or free of licenses; repeated rows and null keys have rows of their own. Whole texts are
    read, one at a time; nothing is shuffled."""
    kind = df.schema[key].dataType.simpleString()
    scanner = Scanner(TEMPLATES if templates is None else templates, least, spread)
    sizes = {name: len(t) for name, t in scanner.templates.items()}

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(1)):
                for found in scanner.scan(t.as_py()):
                    rows.append(i)
                    out.append((found[0], found[1], sizes[found[0]], found[6], *found[2:6]))
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=["k", "license", "matched", "template_words", "coverage", "first_word", "last_word", "start", "end"])

    schema = f"k {kind}, license string, matched int, template_words int, coverage double, first_word long, last_word long, start long, end long"
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
