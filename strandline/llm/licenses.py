"""License scans by conditional compression.

A confirmed wording has some words of its template in a row (see ``LicenseScanner``), so the places of such
runs, in the whole text, are all the candidates there are; no trigger words are needed. The text at a
candidate place is a block. A block is compressed alone and with each template as a zstandard raw
dictionary; a template that saves nothing is out. The others are confirmed, those of greatest gain first,
by the exact wording: the words of the template that it lacks and those that it has between them. Of
confirmed wordings that overlap the one of which its template saves most stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread

# Notices by which texts name their license, and whole license texts without their copyright line.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
)
_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, program: str = "program") -> str:
    article = "it under the terms of the GNU " + name + " as published by the Free Software Foundation"
    which = f", either version {version} of the License, or (at your option) any later version. "
    return f"This {program} is free software: you can redistribute it and/or modify {article}{which}{_WARRANTY.replace('program', program)}GNU {name} for more details."


def _creative(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-text": _MIT,
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT-full": _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-full": _CLAUSES + _AS_IS,
    "BSD-3-Clause-full": _CLAUSES + _THIRD + _AS_IS,
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-full": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-2.0-or-later": _gnu("General Public License", "2"),
    "GPL-3.0-or-later": _gnu("General Public License", "3"),
    "AGPL-3.0-or-later": _gnu("Affero General Public License", "3"),
    "LGPL-2.1-or-later": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0-or-later": _gnu("Lesser General Public License", "3", "library"),
    "CC-BY-4.0-text": _creative("Attribution"),
    "CC-BY-SA-4.0-text": _creative("Attribution-ShareAlike"),
    "CC-BY-NC-4.0-text": _creative("Attribution-NonCommercial"),
    "CC-BY-ND-4.0-text": _creative("Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0-text": _creative("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0-text": _creative("Attribution-NonCommercial-NoDerivatives"),
}
# Identifiers that stand alone in a line for tools.
SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
TEMPLATES |= {f"{i}-spdx": f"SPDX-License-Identifier: {i}" for i in SPDX} | {
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-terms": "under the terms of the MIT License",
    "Apache-2.0-short": "Licensed under the Apache License 2.0.",
    "Apache-2.0-terms": "under the terms of the Apache License, Version 2.0",
    "GPL-2.0-terms": "terms of the GNU GPL v2",
    "GPL-3.0-terms": "terms of the GNU GPL v3",
    "GPL-2.0-short": "Licensed under the GNU GPL v2",
    "GPL-3.0-short": "Licensed under the GNU GPL v3",
}
#: Spellings that are taken for one.
_SPELLING = {"licence": "license", "licenced": "licensed", "gplv2": "gpl-v2", "gplv3": "gpl-v3"}
#: One word may differ for so many words of the template.
WORDS_PER_DIFFERENCE = 12
#: Words that never may differ: numbers, and such as tell licenses apart.
_DECISIVE = re.compile(r".*\d|attribution|by$|by-|cc$|lesser$|affero$|library$|no$|not$|nor$|only$").match
#: Words of a run that makes a place a candidate, at most (fewer where a template's wordings may have no longer run).
ANCHOR = 4
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


@dataclass(frozen=True)
class Found:
    start: int
    stop: int
    license: str
    gain: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]


def may_differ(words: int) -> int:
    """How many words of a template of so many may be missing, and how many may be extra."""
    return words // WORDS_PER_DIFFERENCE


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text, in one spelling."""
    return [_SPELLING.get(w, w) for w in _WORD.findall(text)]


def _apart(places: list, words: int) -> list:
    """Those of ((template, first, last), ...) that overlap none before them."""
    taken, out = np.zeros(words, bool), []
    for place in places:
        _, first, last = place[0]
        if not taken[first:last].any():
            taken[first:last] = True
            out.append(place)
    return out


class LicenseScanner:
    """Finds the licenses of ``templates`` (name -> notice or text) in texts.

    A wording with at most m missing and m extra words consists of at most 2 m + 1 runs of the
    template's words, so its longest run has (words - m) / (2 m + 1) of them. Every run of so many words
    of a template, or of ANCHOR if that is less, is looked at.
    """

    def __init__(self, templates: dict[str, str]):
        import ahocorasick
        import zstandard

        self.names = list(templates)
        self.words = [words_of(t.lower()) for t in templates.values()]
        if not all(self.words):
            raise ValueError("a template without words")
        # of any m + 1 words of a template a wording keeps one: texts without the longest of them need no closer look
        self.telling = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        other = {v: k for k, v in _SPELLING.items()}
        for w in {w for words in self.words for w in sorted(set(words), key=lambda w: (-len(w), w))[: may_differ(len(words)) + 1]}:
            self.telling.add_word(w)
            if w in other:
                self.telling.add_word(other[w])
        self.telling.make_automaton()
        self.number = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}), 1)}
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            m = may_differ(len(words))
            size = min(ANCHOR, -(-(len(words) - m) // (2 * m + 1)))
            ids = np.array([self.number[w] for w in words], np.int64)
            for at, key in enumerate(self._grams(ids, size).tolist()):
                places[size][key].append((t, at))
        self.places = {size: (dict(found), np.array(sorted(found), np.int64)) for size, found in places.items()}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.gains = lru_cache(maxsize=2000)(self._gains)

    def _grams(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of so many words; 0 where one of them is in no template. Wraps at 64 bits; places are confirmed by words."""
        n = max(0, len(ids) - size + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            part = ids[j : j + n]
            out = out * np.int64(len(self.number) + 1) + part
            known &= part > 0
        return np.where(known, out, 0)

    def _gains(self, block: str) -> list[int]:
        """Bytes that each template saves of a block; both are words with one space between, whatever stands there in the text."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return [alone - len(c.compress(data)) for c in self.given]

    def begins(self, own: list[str]) -> list[tuple[int, int]]:
        """(template, word of the text at which its first word would stand) of every candidate place."""
        get, out = self.number.get, set()
        ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        for size, (places, keys) in self.places.items():
            grams = self._grams(ids, size)
            at = np.flatnonzero(np.isin(grams, keys))
            out.update((t, p - q) for p in at.tolist() for t, q in places[int(grams[p])])
        return sorted(out)

    def confirm(self, template: int, own: list[str], begin: int) -> tuple[int, int, tuple[str, ...], tuple[str, ...]] | None:
        """First and past-the-last word, missing and extra words of the wording that begins about there; None if too many differ."""
        want = self.words[template]
        may = may_differ(len(want))
        low = max(0, begin - may)
        part = own[low : max(0, begin + len(want) + may)]
        if sum((Counter(want) - Counter(part)).values()) > may:
            return None
        runs = [r for r in SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks() if r.size]
        near = [r for r in runs if abs((r.b - r.a) - (begin - low)) <= 1 + may]
        if not near:
            return None
        first, last = near[0].b, near[-1].b + near[-1].size
        have = {i for r in near for i in range(r.a, r.a + r.size)}
        hit = {i for r in near for i in range(r.b, r.b + r.size)}
        missing = tuple(w for i, w in enumerate(want) if i not in have)
        extra = tuple(part[i] for i in range(first, last) if i not in hit)
        if max(len(missing), len(extra)) > may or any(map(_DECISIVE, missing + extra)):
            return None
        return low + first, low + last, missing, extra

    def scan(self, text: str) -> list[Found]:
        """The licenses of a whole text by place: all that are confirmed and overlap none of a greater gain (of equal gains: fewer differing words, then name)."""
        low = text.lower()
        if len(low) != len(text):  # a letter that is lower-cased to two
            low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
        if next(self.telling.iter(low), None) is None:
            return []
        own = words_of(low)
        ranked = []
        for t, begin in self.begins(own):
            n = len(self.words[t])
            first, last = max(0, begin - may_differ(n)), min(len(own), begin + n + may_differ(n))
            if first < last and (gain := self.gains(" ".join(own[first:last]))[t]) > 0:
                ranked.append((gain, t, begin))
        confirmed = {}
        for _, t, begin in sorted(ranked, key=lambda r: -r[0]):
            if (got := self.confirm(t, own, begin)) is not None and (t, *got[:2]) not in confirmed:
                # the block without what stands beside the wording
                gain = self.gains(" ".join(own[got[0] : got[1]]))[t]
                confirmed[t, got[0], got[1]] = (gain, got[2], got[3])
        if not confirmed:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        differing = lambda item: len(item[1][1]) + len(item[1][2])
        # of one template's wordings the one with fewest differing words, then among templates the greatest gain
        own_best = []
        for t in {t for t, _, _ in confirmed}:
            places = sorted((i for i in confirmed.items() if i[0][0] == t), key=lambda i: (differing(i), -i[1][0], i[0][1], i[0][2]))
            own_best += _apart(places, len(own))
        rank = lambda i: (-i[1][0], differing(i), self.names[i[0][0]], i[0][1], i[0][2])
        kept = _apart(sorted(own_best, key=rank), len(own))
        return sorted((Found(spans[a][0], spans[b - 1][1], self.names[t], gain, missing, extra) for (t, a, b), (gain, missing, extra) in kept), key=lambda f: f.start)


_SCANNERS: dict[tuple, LicenseScanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses array<struct<license, start, stop, gain, missing, extra>>) of every row, by place in the whole text.

    start and stop are code points. Null and empty texts have none; texts are scanned whole, however long.
    Rows repeat as they come; other columns, also such as are named like the result's, are ignored; an
    empty table gives no rows.
    """
    known = tuple((templates or TEMPLATES).items())
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("gain", pa.int32()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known not in _SCANNERS:
            _SCANNERS[known] = LicenseScanner(dict(known))
        scanner = _SCANNERS[known]
        for batch in batches:
            rows = [[{"license": f.license, "start": f.start, "stop": f.stop, "gain": f.gain, "missing": list(f.missing), "extra": list(f.extra)} for f in scanner.scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "licenses"])

    ddl = "doc_id long, licenses array<struct<license:string,start:int,stop:int,gain:int,missing:array<string>,extra:array<string>>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many notices, and name:start:stop:differing words of each, comma-joined."""
    found = scan_licenses(read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"))
    line = lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["stop"].cast("string"), (F.size(f["missing"]) + F.size(f["extra"])).cast("string"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", line), ",").alias("licenses"))
