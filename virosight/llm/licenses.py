"""License scan by patience alignment of texts with license templates.

Words that occur once in the template and once in the text are anchors.  The
longest increasing run of anchors is kept, and the gaps between its anchors
are aligned the same way.  Coverage is the share of the template's words that
find a partner.

A text may be long and hold a license anywhere, more than once too, so only
the neighbourhoods of a template's telling words (those that are not among
the common words) are aligned, each as a text of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.text import ALNUM, encoded

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_LIABILITY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NO_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."

#: Whole short licenses, and the notices and one-line marks of long ones.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + (_ISC := (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
    "agpl-3.0-notice": _GNU.format("program", "Affero General Public License", 3),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD_GRANT + _BSD_LIABILITY,
    "bsd-3-clause": _BSD_GRANT + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_LIABILITY,
    "bsd-grant": _BSD_GRANT,
    "bsl-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": _GNU.format("program", "General Public License", 3),
    "gpl-warranty": "This program " + _NO_WARRANTY.format("General Public License"),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC,
    "lgpl-2.1-notice": _GNU.format("library", "Lesser General Public License", "2.1"),
    "mit": "Released under the MIT License.",
    "mit-0": _MIT_GRANT + ". " + _AS_IS + _MIT_LIABILITY,
    "mit-full": _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + _MIT_LIABILITY,
    "mit-notice": _MIT_GRANT + ".",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-full": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Templates of a loaded table, and characters of all of them, at most: they go to every worker.
MAX_TEMPLATES, MAX_CHARS = 5_000, 50_000_000
#: Words too common to start a search from.
COMMON = frozenset(b"a above all and any are as at be by can do either following following for form free from in including is it its later may must not of on option or other out permit person persons public so source that the this to under use version whom with without work you your 0 2 3 4 v".split())
#: Least share of a template's words that counts as the license.
COVERAGE = 0.8

_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, whose second members increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs (place in the template, place in the text) of the patience alignment, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        t0, t1, x0, x1 = todo.pop()
        while t0 < t1 and x0 < x1 and template[t0] == text[x0]:
            pairs.append((t0, x0))
            t0, x0 = t0 + 1, x0 + 1
        while t0 < t1 and x0 < x1 and template[t1 - 1] == text[x1 - 1]:
            t1, x1 = t1 - 1, x1 - 1
            pairs.append((t1, x1))
        if t0 == t1 or x0 == x1:
            continue
        ours, theirs = Counter(template[t0:t1]), Counter(text[x0:x1])
        once = {w for w, n in ours.items() if n == 1 and theirs[w] == 1}
        if not once:
            continue
        place = {text[i]: i for i in range(x0, x1) if text[i] in once}
        anchors = _increasing([(i, place[template[i]]) for i in range(t0, t1) if template[i] in once])
        pairs += anchors
        for (a, b), (c, d) in zip([(t0 - 1, x0 - 1), *anchors], [*anchors, (t1, x1)], strict=True):
            todo.append((a + 1, c, b + 1, d))
    return sorted(pairs)


class Scanner:
    """Templates with their telling words."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words_of(text.encode()) for name, text in sorted(templates.items())}
        self.telling: dict[bytes, list[str]] = {}
        for name, own in self.templates.items():
            for w in dict.fromkeys(own):
                if w not in COMMON:
                    self.telling.setdefault(w, []).append(name)

    def scan(self, text: bytes | None, least: float) -> tuple[list[tuple[str, float, int, int, int]], float]:
        """Licenses found (name, coverage, words matched, first word, word after the last), best first, and the best coverage of any."""
        words = words_of(text)
        telling = self.telling
        seats: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in telling:
                for name in telling[w]:
                    seats.setdefault(name, []).append(i)
        found, most = [], 0.0
        for name, seat in seats.items():
            template = self.templates[name]
            m = len(template)
            best = (0, 0, 0)
            for start, end in self._places(seat, m, len(words)):
                pairs = align(words[start:end], template)
                if len(pairs) > best[0]:
                    best = len(pairs), start + pairs[0][1], start + pairs[-1][1] + 1
            most = max(most, best[0] / m)
            if best[0] >= least * m:
                found.append((name, best[0] / m, *best))
        return sorted(found, key=lambda f: (-f[1], -f[2], f[0])), most

    @staticmethod
    def _places(seat: list[int], m: int, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of words to align: one about each group of telling words that a single notice could hold."""
        reach = m + m // 4 + 2
        k = 0
        while k < len(seat):
            last = k
            while last + 1 < len(seat) and seat[last + 1] - seat[k] < reach:
                last += 1
            yield max(0, seat[k] - m // 2), min(n, seat[k] + reach)
            # A second notice may begin right behind the first, so the group is looked at again from half a notice on.
            k = next((j for j in range(k + 1, last + 1) if seat[j] - seat[k] >= max(1, m // 2)), last + 1)


def load_templates(table: DataFrame, name_col: str = "license", text_col: str = "text") -> dict[str, str]:
    """Templates of a table of license names and whole texts, as ``scan_licenses`` takes them.

    Rows with a null name or text take no part, and of equal names the least
    text does.  More templates or characters than the bounds are an error,
    found before anything is collected.
    """
    rows = table.where(F.col(name_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(name_col).cast("string").alias("n")).agg(F.min(text_col).alias("t"))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("t"))).first()
    if n > MAX_TEMPLATES or (chars or 0) > MAX_CHARS:
        raise ValueError(f"{n} templates of {chars} characters; at most {MAX_TEMPLATES} of {MAX_CHARS} go to the workers")
    return {r["n"]: r["t"] for r in rows.collect()}


_scanner: dict[tuple, Scanner] = {}


def _held(templates: dict[str, str]) -> Scanner:
    key = tuple(sorted(templates.items()))
    if key not in _scanner:
        _scanner.clear()
        _scanner[key] = Scanner(templates)
    return _scanner[key]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row per row: ``id_col, best_coverage, found``.

    ``found`` holds a struct (license, coverage, n_words, start, end) for each
    template of which ``least`` of the words are covered, best first; start
    and end are byte offsets in the UTF-8 of the original text.
    ``best_coverage`` is the most that any template reaches.  Null, empty and
    wordless texts have none.  Of templates of equal coverage the one with
    more words comes first, then the first by name.  Whole texts of any length
    are scanned.  Repeated rows stay; an empty table gives no row, and an
    empty set of templates finds nothing; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _held(templates)
        for batch in batches:
            rows, most = [], []
            for text in encoded(batch.column(1)):
                found, best = scanner.scan(text, least)
                spans = [m.span() for m in _WORD.finditer(text.translate(ALNUM))] if found else []
                rows.append([{"license": f[0], "coverage": f[1], "n_words": f[2], "start": spans[f[3]][0], "end": spans[f[4] - 1][1]} for f in found])
                most.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.float64()), pa.array(rows, kind)], names=["_id", "best_coverage", "found"])

    schema = f"_id {dict(docs.dtypes)[id_col]}, best_coverage double, found array<struct<license:string,coverage:double,n_words:long,start:long,end:long>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the best license (null if none), its coverage, and all licenses found by name; odd rows as in ``scan_licenses``."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.try_element_at("found", F.lit(1))["license"].alias("license"), F.round("best_coverage", 6).alias("best_coverage"),
        F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.col("found.license")), ",").alias("licenses"),
    )
