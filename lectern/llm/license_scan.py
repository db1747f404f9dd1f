"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into word runs whose winnowed hashes form an inverted index
(its size is bounded by the templates, not by the documents). A document's
winnowed hashes that hit the index give (template, diagonal) candidates; a
banded local alignment around the diagonal reports which share of the template
is matched and where in the text. Of matches at one place the longest tells the
license; words that tell related licenses apart must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_of
from lectern.llm.substring_dedup import U64, _flat, anchors

BAND, MIN_COVERAGE = 8, 0.8
#: Words of a run and of a winnowing window, for templates of at least ``SHORT`` words and for shorter ones.
SHORT, LONG_RUNS, SHORT_RUNS = 8, (3, 4), (2, 2)

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public license statements and notices, then whole texts (without their copyright lines).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    "MIT-warranty": WARRANTY,
    "BSD-2-Clause-text": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause-text": BSD_HEAD + BSD_THIRD + BSD_TAIL,
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}

#: Identifiers of the templates whose name is not one plus a part. The conditions that both BSD licenses share tell none of them.
IDENTIFIERS = {"BSD-conditions": "BSD-2-Clause OR BSD-3-Clause", "GPL-header": "GPL-3.0", "LGPL-header": "LGPL-2.1", "Zlib-text": "Zlib", "ISC-text": "ISC"}
PARTS = ("-notice", "-text", "-warranty", "-header", "-title")
#: Words that tell related licenses apart, and words before a version.
TELLING = frozenset(("affero", "lesser", "nc", "noncommercial", "nd", "noderivatives", "sa", "sharealike"))
BEFORE_VERSION = frozenset(("v", "version"))

#: Words in Spark and in Python: runs of letters and digits, lower-cased.
GAPS = "[^\\p{L}\\p{N}]+"
WORD = regex.compile(r"[\p{L}\p{N}]+")
SCHEMA = "doc_id long, license string, template string, coverage double, matched long, start long, end long"


def identifier(template: str) -> str:
    """The license that a template stands for."""
    return IDENTIFIERS.get(template) or next((template.removesuffix(part) for part in PARTS if template.endswith(part)), template)


def telling(words: list[str]) -> set[str]:
    """The words of a passage that tell its license from related ones: additions to a license, and versions."""
    return {w for w in words if w in TELLING} | {b for a, b in zip(words, words[1:]) if a in BEFORE_VERSION and b.isdecimal()}


def template_hashes(spark, templates: dict[str, str]) -> dict[str, np.ndarray]:
    """The hashed words of each template, hashed as documents are."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    return {r["name"]: np.array(r["w"], np.int64).view(U64) for r in rows.select("name", _words("text").alias("w")).collect()}  # a row per template


def _words(column: str):
    return F.transform(F.filter(F.split(F.lower(column), GAPS), lambda w: w != ""), lambda w: F.xxhash64(w))


def inverted_index(hashed: dict[str, np.ndarray], short: bool) -> dict[int, list[tuple[str, int]]]:
    """Fingerprint -> (template, word position), of the short templates or of the others."""
    index: dict[int, list[tuple[str, int]]] = {}
    for name, words in hashed.items():
        if (len(words) < SHORT) == short:
            values, _, places = _fingerprints(words, np.array([0, len(words)]), short)
            for value, at in zip(values.tolist(), places.tolist()):
                index.setdefault(value, []).append((name, at))
    return index


def _fingerprints(words: np.ndarray, edges: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    run, window = SHORT_RUNS if short else LONG_RUNS
    return anchors(words, edges, window, run)


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and the first and last word of the best local alignment within the band.

    ``diagonal`` is the document position of the template's first word. A match
    counts 2, a gap or an unlike word costs 1; of equal scores the one nearest to
    the diagonal counts. The band is no wider than half of the template.
    """
    band = min(band, len(template) // 2 + 1)
    width, low = 2 * band + 1, diagonal - band
    score, came = np.zeros((len(template) + 1, width + 2), int), {}
    best, best_at = 0, None
    for i, word in enumerate(template, 1):
        for b in range(1, width + 1):
            j = low + (i - 1) + (b - 1)  # document word of this cell
            if not 0 <= j < len(words):
                continue
            same = words[j] == word
            ways = (score[i - 1, b] + (2 if same else -1), score[i - 1, b + 1] - 1, score[i, b - 1] - 1)
            top = max(ways)
            if top <= 0:
                continue
            score[i, b], way = top, ways.index(top)
            came[i, b] = (way, same)
            if top > best or top == best and abs(b - band - 1) < abs(best_at[1] - band - 1):
                best, best_at = top, (i, b)
    matched, first, last, at = 0, -1, -1, best_at
    while at in came:
        i, b = at
        way, same = came[at]
        j = low + (i - 1) + (b - 1)
        if way == 0:
            if same:
                matched, first, last = matched + 1, j, max(last, j)
            at = (i - 1, b)
        else:
            at = (i - 1, b + 1) if way == 1 else (i, b - 1)
    return matched, first, last


def _matches(text: str, hits: list[tuple[str, int]], templates: dict[str, list[str]], least: float) -> list[tuple]:
    """Best alignments of one text: one for each place, the longest."""
    lowered = text.lower()
    found = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
    words = [lowered[a:b] for a, b in found]
    out, done = [], {}
    for name, diagonal in sorted(set(hits)):
        if (last := done.get(name)) is not None and diagonal - last <= BAND // 2:
            continue  # the same place again
        done[name] = diagonal
        matched, first, last = align(templates[name], words, diagonal)
        if matched >= least * len(templates[name]) and telling(words[first : last + 1]) == telling(templates[name]):
            out.append((identifier(name), name, matched / len(templates[name]), matched, found[first][0], found[last][1]))
    out.sort(key=lambda x: (-x[3], -x[2], x[4], x[1]))
    kept: list[tuple] = []
    for x in out:
        common = ((min(x[5], y[5]) - max(x[4], y[4]), x[0] == y[0]) for y in kept)
        if not any(shared > (0 if same else (x[5] - x[4]) / 2) for shared, same in common):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[4], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, template, coverage, matched (words), start, end (characters) of every match in the whole texts.

    license is the identifier of the template; coverage is the share of the
    template's words that the alignment matches. A text may match in several
    places; of matches that share a place (any overlap under one identifier, over half
    of the shorter one under two) the one with the most matched words stays, so
    a notice inside a whole text is not reported again. A match counts only if the additions to a license (Affero,
    Lesser, ShareAlike, NC ...) and the versions named in its span are those of its template. Null
    and empty texts match nothing and empty tables give empty results; repeated
    rows report alike; of equal matches at one place the one of larger coverage
    stays, then the earlier. Only doc_id and text are read; character places
    refer to the lower-cased text, which has the length of the text but for a
    few letters.
    """
    hashed = template_hashes(docs.sparkSession, templates)
    indexes = [(short, index, np.array(sorted(index), U64)) for short in (False, True) if (index := inverted_index(hashed, short))]
    plain = {k: WORD.findall(v.lower()) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, edges = _flat(batch["w"])
            hits: dict[int, list[tuple[str, int]]] = {}
            for short, index, known in indexes:
                values, rows, places = _fingerprints(words, edges, short)
                for at in np.flatnonzero(np.isin(values, known)):
                    row = int(rows[at])
                    for name, position in index[int(values[at])]:
                        hits.setdefault(row, []).append((name, int(places[at] - edges[row]) - position))
            out = [(batch["doc_id"][row].as_py(), *m) for row, own in hits.items() for m in _matches(batch["text"][row].as_py(), own, plain, min_coverage)]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "template", "coverage", "matched", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.select("doc_id", "text", _words("text").alias("w")).mapInArrow(run, SCHEMA)


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """Every license match of every document."""
    return scan(docs)
