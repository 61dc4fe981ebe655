"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Each template of m shingles is looked for in windows of w shingles, the least power
of two with w >= 2 m, one from every fourth shingle on: every run of m shingles lies
inside one of them. A window that holds a share c of the template has a Jaccard similarity of
at least c m / (w + (1 - c) m) to it, above 0.19 at c = 0.8. With BANDS bands of one
MinHash each, the chance to miss such a window is below 0.81 ** BANDS, about 1.4e-6.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabstat.llm import kernel as K
from tabstat.llm import spread as S

SHINGLE = 5
PERCENT = 80
BANDS = 64
_BLOCK = 4

# Texts of short licenses, notices that licenses ask for, and lines in common use.
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
# The licenses whose texts share most of their words.
FAMILIES = {"AGPL": "GPL", "LGPL": "GPL", "CC": "CC", "BSD": "BSD", "GPL": "GPL", "0BSD": "ISC", "ISC": "ISC"}


def family(name: str) -> str:
    """Of licenses of one family, only the best fit is reported at one place."""
    head = name.partition("-")[0]
    return FAMILIES.get(head, head)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, in order, and the first one of each text."""
    words = K.Words(K.LOWER[data], offsets, K.ALNUM_WORDS)
    grams = K.window_hashes(words.hashes(), size)
    whole = np.flatnonzero(words.room()[: len(grams)] >= size)
    return grams[whole], np.searchsorted(whole, words.first)


class Index:
    """Templates by window width, with their MinHash of every band."""

    def __init__(self, templates, size: int, bands: int):
        self.size = size
        self.factors = K.mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.names, self.sets, self.levels = [], [], {}
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            found = np.unique(shingles(data, np.array([0, len(data)]), size)[0])
            if not len(found):
                raise ValueError(f"template of {name} is shorter than a shingle")
            self.levels.setdefault(max(2 * _BLOCK, 1 << int(2 * len(found) - 1).bit_length()), []).append(len(self.names))
            self.names.append(name)
            self.sets.append(found)
        # By width and band: the sorted MinHashes of the templates, and whose they are.
        self.buckets = {}
        for width, own in self.levels.items():
            for j, factor in enumerate(self.factors):
                least = np.array([(self.sets[t] * factor).min() for t in own], np.uint64)
                order = np.argsort(least, kind="stable")
                self.buckets[width, j] = least[order], np.array(own)[order]

    def candidates(self, values: np.ndarray, block: np.ndarray) -> set[tuple[int, int]]:
        """(first block of the window, template) of all band collisions, looked up by the window's MinHash."""
        found: set[tuple[int, int]] = set()
        top = max(self.levels)
        for j, factor in enumerate(self.factors):
            least = np.minimum.reduceat(values * factor, block)
            width = 1
            while width * _BLOCK < top:
                # Past the end of the slice a window has only what is left.
                least = np.minimum(least, np.append(least[width:], np.repeat(least[-1:], min(width, len(least)))))
                width *= 2
                if (width * _BLOCK, j) in self.buckets:
                    known, own = self.buckets[width * _BLOCK, j]
                    at = np.flatnonzero(S.is_in(least, known))
                    low, high = (np.searchsorted(known, least[at], side) for side in ("left", "right"))
                    for a, x, y in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                        found.update((a, t) for t in own[x:y].tolist())
        return found


def best_of_family(hits: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Of (start, end, name, shingles found, shingles of the template), those that no better hit of another license of the family overlaps."""
    out, groups = [], {}
    for h in hits:
        groups.setdefault(family(h[2]), []).append(h)
    for own in groups.values():
        if len({h[2] for h in own}) > 1:
            own.sort()
            starts, widest = [h[0] for h in own], max(h[1] - h[0] for h in own)
            own = [h for h in own if not any(o[2] != h[2] and o[3] * h[4] > h[3] * o[4] and o[1] > h[0] for o in own[bisect.bisect_right(starts, h[0] - widest) : bisect.bisect_left(starts, h[1])])]
        out += own
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Licenses whose template is contained in a window of the text.

    A template is contained when 100 * (its distinct shingles in the window) >=
    percent * (its distinct shingles). Words are runs of letters, digits and
    non-ASCII characters, with A-Z lower-cased. Returns one row per document:
    ``id``, ``licenses`` (sorted distinct names) and ``spans`` (for each name the
    first shingle of the first window and the best share in percent). Windows start
    at every _BLOCK shingles of a text. Where windows of licenses of one family
    overlap, the one with the higher share counts, both if they tie.

    Null, empty and short texts hold no shingle and have empty arrays. Null and
    repeated ids are scanned row by row. Other columns are not read.
    """
    S.tune(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, size, bands))
    span = pa.struct([("license", pa.string()), ("start", pa.int64()), ("share", pa.int32())])

    def find(batches):
        for batch in batches:
            out = []
            for low, high, data, offsets in K.text_slices(batch.column(1)):
                values, first = shingles(data, offsets, index.value.size)
                rows: list[dict] = [{} for _ in range(high - low)]
                hits: dict[int, list] = {}
                if len(values):
                    row = np.repeat(np.arange(high - low), np.diff(first))
                    inside = np.arange(len(values)) - first[row]
                    block = np.flatnonzero(inside % _BLOCK == 0)
                    width = {t: w for w, own in index.value.levels.items() for t in own}
                    for b, t in sorted(index.value.candidates(values, block)):
                        a = int(block[b])
                        r = int(row[a])
                        window, own = values[a : min(a + width[t], first[r + 1])], index.value.sets[t]
                        n = int(np.isin(own, window).sum())
                        if 100 * n >= percent * len(own):
                            hits.setdefault(r, []).append((int(inside[a]), int(inside[a]) + width[t], index.value.names[t], n, len(own)))
                    for r, own in hits.items():
                        for start, _, name, n, m in best_of_family(own):
                            first_, best = rows[r].get(name, (start, 0))
                            rows[r][name] = (min(start, first_), max(best, 100 * n // m))
                out += rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(x) for x in out], pa.list_(pa.string())), pa.array([[{"license": k, "start": x[k][0], "share": x[k][1]} for k in sorted(x)] for x in out], pa.list_(span))],
                ["id", "licenses", "spans"],
            )

    return S.texts(docs, id_col, text_col).mapInArrow(S.lean(find), "id bigint, licenses array<string>, spans array<struct<license: string, start: bigint, share: int>>")
