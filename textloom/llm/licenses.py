"""Operator 9: licence scan by Dice coefficient over word bigrams.

Text and licence templates are normalised to lower-cased words (runs of letters
and digits).  A document's match with a template is its best window of as many
words as the template (a shorter document is one window): Dice = 2 |A and B| /
(|A| + |B|) over the sets of word bigrams.  A template is reported from
``THRESHOLD`` on.

Pruning loses nothing.  Size bounds: a window of a bigrams can reach t against a
template of b only if t b / (2 - t) <= a, so documents below that never meet the
template.  Anchors: such a window lacks at most b - ceil(t b / (2 - t)) of the
template's bigrams, so it holds one of that many plus one anchors; only windows
around anchors are measured, each step in constant time.

Templates are an argument: (name, text) each; ``TEMPLATES`` has the usual ones.
Those alike (two versions of one notice) can both match; the nearer one is named
first.

Defined cases: null text counts as empty; texts of fewer than two words match
nothing; templates of fewer than two words are an error.  Ties go to the earlier
template and the earlier window.  Repeated rows each get a row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pick, trimmed

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with {3}."

#: Usual licence notices, and short licences in full.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This program " + _FREE.format("General Public License", 2, "This program", "this program")),
    ("GPL-3.0", "This program " + _FREE.format("General Public License", 3, "This program", "this program")),
    ("LGPL-2.1", "This library " + _FREE.format("Lesser General Public License", 2.1, "This library", "this library")),
    ("LGPL-3.0", "This library " + _FREE.format("Lesser General Public License", 3, "This library", "this library")),
    ("AGPL-3.0", "This program " + _FREE.format("Affero General Public License", 3, "This program", "this program")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        words = words_of(text)
        if len(words) < 2:
            raise ValueError(f"licence template {name} has fewer than two words")
        self.name, self.length, self.bigrams = name, len(words), set(bigrams_of(words))
        self.least = max(1, -int(-threshold * len(self.bigrams) / (2 - threshold) // 1))
        # the longest bigrams are the rarest
        by_length = sorted(self.bigrams, key=lambda b: (-len(b[0]) - len(b[1]), b))
        self.anchors = set(by_length[: len(self.bigrams) - self.least + 1])

    def best(self, bigrams: list[tuple[str, str]], hits: list[int]) -> tuple[float, int]:
        """The best Dice of a window around ``hits``, and its first word."""
        width, n = self.length - 1, len(bigrams)
        if n < self.least:
            return 0.0, 0
        width = min(width, n)
        found, start, end = (0.0, 0), 0, -1
        counts: dict[tuple[str, str], int] = {}
        shared = 0
        covered = -1
        for hit in hits:
            for at in range(max(covered + 1, hit - width + 1, 0), min(hit, n - width) + 1):
                if at >= end or at < start:
                    counts, shared, start, end = {}, 0, at, at
                while start < at:
                    b = bigrams[start]
                    counts[b] -= 1
                    if not counts[b]:
                        del counts[b]
                        shared -= b in self.bigrams
                    start += 1
                while end < at + width:
                    b = bigrams[end]
                    if b not in counts:
                        shared += b in self.bigrams
                    counts[b] = counts.get(b, 0) + 1
                    end += 1
                dice = 2 * shared / (len(counts) + len(self.bigrams))
                if dice > found[0]:
                    found = (dice, at)
                covered = at
        return found


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [Template(n, t, threshold) for n, t in templates]
        self.anchors: dict[tuple[str, str], list[int]] = {}
        for i, t in enumerate(self.templates):
            for a in t.anchors:
                self.anchors.setdefault(a, []).append(i)
        self.first = {a[0] for a in self.anchors}

    def scan(self, text: str) -> list[tuple[str, float, int]]:
        """(licence, Dice, first word) of each template found, best first."""
        words = words_of(text)
        if self.first.isdisjoint(words):
            return []
        bigrams = bigrams_of(words)
        hits: dict[int, list[int]] = {}
        for at, b in enumerate(bigrams):
            for i in self.anchors.get(b, ()):
                hits.setdefault(i, []).append(at)
        found = [(*t.best(bigrams, hits[i]), i) for i, t in enumerate(self.templates) if i in hits]
        return [(self.templates[i].name, dice, at) for dice, at, i in sorted((f for f in found if f[0] >= self.threshold), key=lambda f: (-f[0], f[2]))]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (best, or null), dice, first_word, licenses (all, sorted) of each row."""
    Scanner(templates, threshold)  # a wrong template fails here, on the driver

    @trimmed
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates, threshold)
        for column in texts:
            found = [scanner.scan(t or "") for t in column.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0][0] if f else None for f in found], pa.string()),
                    pa.array([f[0][1] if f else None for f in found], pa.float64()),
                    pa.array([f[0][2] if f else None for f in found], pa.int64()),
                    pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                ],
                names=["license", "dice", "first_word", "licenses"],
            )

    scan = F.arrow_udf(run, "struct<license: string, dice: double, first_word: long, licenses: array<string>>")
    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")
