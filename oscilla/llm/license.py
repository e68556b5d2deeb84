"""License scanning by conditional compression.

A block of text that quotes a license compresses to almost nothing when the license's own words are the dictionary.
Blocks around a word that every template has one of, across line breaks, are aligned word by word with
each template, and what lies before and after a span that differs in few words once more. The lines of a span are
compressed alone and with the template as a zstandard raw dictionary; a candidate that saves no bytes is none. The differences are part of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either {}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
#: (license, kind, wording); ``<...>`` stands for any words of one slot, up to SLOT of them.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "notice", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "notice", "Released under the CC0 1.0 Universal license."),
    ("BSD", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "notice", "Copyright (c) <holder>. All rights reserved."),
    ("MIT", "full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "full", f"{_BSD_BEGIN} {_BSD_END}"),
    ("BSD-3-Clause", "full", f"{_BSD_BEGIN} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("Apache-2.0", "full", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "full", _GPL.format("version 3 of the License, or (at your option) any later version")),
    ("GPL-2.0", "full", _GPL.format("version 2 of the License, or (at your option) any later version")),
)
_TRIGGER = ("licen", "copyright", "permission", "permitted", "redistribut", "free software", "released under", "all rights reserved")
_TOKEN = re.compile(r"\w+(?:[.-]\w+)*|<\w+>")
_SPACE = re.compile(r"\s+")
#: Share of a template's words that may differ, words one slot may take, and the least number of characters around a trigger.
DIFFERENT, SLOT, AROUND = 0.15, 8, 1024


@dataclass(frozen=True)
class Found:
    license: str
    kind: str
    start: int
    end: int
    reduction: float
    missing: tuple[str, ...]
    added: tuple[str, ...]


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def align(template: list[str], block: list[str]) -> tuple[int, int, int, list[str], list[str]]:
    """(cost, start, end, missing, added) of the span of ``block`` nearest to ``template`` in whole words.

    Semi-global edit distance: what comes before and after the span is free; a slot takes up to SLOT words.
    """
    n, m = len(template), len(block)
    cost = np.zeros((n + 1, m + 1), dtype=np.int32)
    places = np.arange(m + 1)
    words = np.array(block, dtype=object)
    for i in range(1, n + 1):
        above = cost[i - 1]
        if template[i - 1][0] == "<":
            cost[i] = above
            for k in range(1, min(SLOT, m) + 1):
                cost[i, k:] = np.minimum(cost[i, k:], above[:-k])
            continue
        row = above + 1
        if m:
            row[1:] = np.minimum(row[1:], above[:-1] + 2 * (words != template[i - 1]))
        cost[i] = np.minimum.accumulate(row - places) + places
    end = int(np.argmin(cost[n]))
    i, j, missing, added = n, end, [], []
    while i:
        if template[i - 1][0] == "<":
            i, j = i - 1, j - min(range(min(SLOT, j) + 1), key=lambda k: (cost[i - 1, j - k], -k))
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            added.append(block[j - 1])
            j -= 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            missing.append(template[i - 1])
            i -= 1
        else:
            if template[i - 1] != block[j - 1]:
                missing.append(template[i - 1])
                added.append(block[j - 1])
            i, j = i - 1, j - 1
    return int(cost[n, end]), j, end, missing[::-1], added[::-1]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str, str], ...] = TEMPLATES):
        self.templates = [(name, kind, [w for w, _, _ in _words(text)]) for name, kind, text in templates]
        # Level 19 so that short matches count; slots have no words to offer.
        plain = [_SPACE.sub(" ", re.sub(r"<\w+>", "", text)).lower().encode() for _, _, text in templates]
        # Around a trigger there is room for the longest template, with half its length for white space and other words.
        self.around = max([AROUND, *(3 * len(p) // 2 for p in plain)])
        more = [max(w for w in words if w[0] != "<") for p, (_, _, words) in zip(plain, self.templates, strict=True) if not any(t in p.decode() for t in _TRIGGER)]
        self.triggers = (*_TRIGGER, *sorted(set(more)))
        self.trigger = re.compile("|".join(map(re.escape, self.triggers)))
        self.alone = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.compressors = [
            zstandard.ZstdCompressor(
                level=19, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            for p in plain
        ]

    def _blocks(self, text: str, low: str) -> Iterator[tuple[int, str]]:
        """What is around a trigger, whatever lines it is on; what overlaps is one block."""
        places = sorted({m.start() for m in self.trigger.finditer(low)})
        around = self.around
        spans: list[list[int]] = []
        for at in places:
            start, end = max(0, at - around), min(len(text), at + around)
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        for start, end in spans:
            # Blocks of bounded size that share more than any template's length: the alignment is quadratic.
            while end - start > 4 * around:
                yield start, text[start : start + 4 * around]
                start += 2 * around
            yield start, text[start:end]

    def _spans(self, k: int, plain: list[str]) -> Iterator[tuple[int, int, int, list[str], list[str]]]:
        """Every span of a block's words near enough to a template: the nearest, then those before and after it."""
        template = self.templates[k][2]
        literal = [w for w in template if w[0] != "<"]
        most = 2 * DIFFERENT * len(literal)
        left = [(0, len(plain))]
        while left:
            lo, hi = left.pop()
            own = set(plain[lo:hi])
            if sum(w not in own for w in literal) > most:  # each costs one at least
                continue
            cost, a, b, missing, added = align(template, plain[lo:hi])
            if b > a and cost <= most:
                yield cost, lo + a, lo + b, missing, added
                left += [(lo, lo + a), (lo + b, hi)]

    def _saved(self, k: int, text: str, start: int, end: int) -> tuple[int, int]:
        """Bytes a template saves of the lines of a span (of long ones, what is around it), and their size without it."""
        first, last = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        last = len(text) if last < 0 else last
        raw = _SPACE.sub(" ", text[max(first, start - self.around) : min(last, end + self.around)]).lower().encode("utf-8", "replace")
        alone = len(self.alone.compress(raw))
        return alone - len(self.compressors[k].compress(raw)), alone

    def scan(self, text: str) -> list[Found]:
        """Licenses of ``text`` by place; of overlapping findings the one that explains most words, then saves most."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not any(t in low for t in self.triggers):
            return []
        found: list[tuple[int, float, Found]] = []
        seen: set[tuple[int, int, int]] = set()
        for start, block in self._blocks(text, low):
            words = _words(block)
            for k, (name, kind, _) in enumerate(self.templates):
                for cost, a, b, missing, added in self._spans(k, [w for w, _, _ in words]):
                    place = (start + words[a][1], start + words[b - 1][2])
                    if (k, *place) in seen:  # blocks overlap
                        continue
                    seen.add((k, *place))
                    saved, alone = self._saved(k, text, *place)
                    if saved >= 4:
                        size = sum(w[0] != "<" for w in self.templates[k][2])
                        found.append((2 * cost - size, -saved / alone, Found(name, kind, *place, saved / alone, tuple(missing), tuple(added))))
        chosen: list[Found] = []
        for _, _, f in sorted(found, key=lambda x: (x[0], x[1], x[2].start, x[2].license)):
            if all(f.end <= c.start or f.start >= c.end for c in chosen):
                chosen.append(f)
        return sorted(chosen, key=lambda f: f.start)


_SCHEMA = "doc_id long, license string, kind string, start long, end long, reduction double, missing string, added string, exact boolean"


def find_licenses(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """One row for each license a row of ``docs`` quotes: doc_id, license, kind, start, end, reduction, missing, added, exact.

    start and end are code points; missing and added the template's and the block's differing words, joined by blanks.
    Null and empty texts have none; repeated rows are reported each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            rows = [
                (doc, f.license, f.kind, f.start, f.end, f.reduction, " ".join(f.missing), " ".join(f.added), not (f.missing or f.added))
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for f in scanner.scan(body.as_py())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                names=["doc_id", "license", "kind", "start", "end", "reduction", "missing", "added", "exact"],
            )

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return body.mapInArrow(run, _SCHEMA)
