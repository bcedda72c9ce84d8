"""Licence scan: winnowed fingerprints, an inverted index, banded alignment (operator 8).

Word k-grams of the templates are hashed and winnowed (the smallest hash of every window is kept), which guarantees that a
shared run of K + WINDOW - 1 words shares a fingerprint. A notice of SHORT words or fewer may lose all of those to one edit, so
it is indexed by every pair of neighbouring words: with COVERAGE of its words matched and nothing put between them, a pair is
left. The index maps a fingerprint to the templates and places that have it. Fingerprints of a text that fall on nearly one
diagonal make a candidate; a banded alignment of template and text words then gives the matched coverage and the span.
Coverage counts words alike: a notice of five words matches with its licence's name exchanged, at 0.8, where no template fits
better. The templates are a fixed list, so the index is a small broadcast.
"""
from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .decontaminate import LETTERS

K, WINDOW = 3, 3                                    # words of a fingerprint, fingerprints of a winnowing window
SHORT = 40                                          # words up to which a template is indexed by pairs
BAND = 8                                            # words that text and template may run apart in an alignment
COVERAGE = 0.8                                      # share of template words that must match
TEMPLATE_WORDS = 100_000                            # all templates together, at most

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = _BSD_2 + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB_CLAUSES = """1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"""

# Public licence texts and customary notices (name, wording).
TEMPLATES = (
    ("MIT", _MIT), ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", _BSD_3), ("ISC", _ISC), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("GPL-3.0", _GPL), ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2."), ("GPL-3.0", "licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_DISCLAIMER}"), ("BSD-3-Clause", f"{_BSD_3} {_BSD_DISCLAIMER}"), ("ISC", f"{_ISC} {_ISC_DISCLAIMER}"), ("Zlib", f"{_ZLIB}: {_ZLIB_CLAUSES}"), ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("AGPL-3.0", _GPL.replace("GNU General", "GNU Affero General")), ("LGPL-3.0", _GPL.replace("GNU General", "GNU Lesser General")),
    ("GPL-2.0", _GPL.replace("version 3", "version 2")), ("MPL-2.0", _MPL), ("EPL-2.0", _EPL),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
)
MATCH = "array<struct<licence:string,template:int,coverage:double,first_word:long,last_word:long>>"


def _grams(numbers: np.ndarray, k: int = K) -> np.ndarray:
    """A hash per k words; the largest value where a word is in no template. Depends on the words alone."""
    n = len(numbers) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for at in range(k):
        word = numbers[at:n + at]
        h = (h ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= word > 0
    return np.where(known, h >> np.uint64(1), np.uint64(2**64 - 1))


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every window, the last of equals; all places where there are fewer than WINDOW."""
    n = len(grams) - WINDOW + 1
    if n < 1:
        return np.arange(len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(n) + WINDOW - 1 - view.argmin(1))


def align(template: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, last) of the best alignment of the whole template inside ``text``, whose ends are free.

    One row per template word and 2 * BAND + 1 diagonals beyond the difference of lengths. Match 1, gap or difference 0: the
    number of matched words is what counts; of equal results the shortest span is taken.
    """
    m, n = len(template), len(text)
    low, high = min(n - m, 0) - BAND, max(n - m, 0) + BAND
    before: dict[int, tuple[int, int, int]] = {}
    for i in range(m):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(n, i + high + 1)):
            best = max(before.get(j, (0, 0, 0)), row.get(j - 1, (0, 0, 0)))
            if template[i] == text[j]:
                count, start, _ = before.get(j - 1, (0, 0, 0))
                start = start if count else -j                       # larger: a later start
                best = max(best, (count + 1, start, -j))
            row[j] = best
        before = {**{j: v for j, v in before.items() if j > max(row, default=-1)}, **row}
    count, start, last = max(before.values(), default=(0, 0, 0))
    return count, -start, -last


class Index:
    """Numbers of the template words, the templates, and the inverted index of their fingerprints."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in templates]
        self.templates = []
        for _, wording in templates:
            self.templates.append(np.array([self.number.setdefault(w, zlib.crc32(w) | 1) for w in wording.encode().translate(LETTERS).split()], np.int64))
        if sum(map(len, self.templates)) > TEMPLATE_WORDS or min(map(len, self.templates), default=K) < K:
            raise ValueError(f"templates need {K} words each and {TEMPLATE_WORDS} together at most")
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, numbers in enumerate(self.templates):
            short = len(numbers) <= SHORT
            grams = _grams(numbers, 2 if short else K)
            for at in (range(len(grams)) if short else winnow(grams).tolist()):
                (self.pairs if short else self.places)[int(grams[at])].append((t, at))
        self.prints, self.pair_prints = np.array(sorted(self.places), np.uint64), np.array(sorted(self.pairs), np.uint64)

    def _hits(self, numbers: np.ndarray) -> dict[int, list[int]]:
        """Diagonals of each template's fingerprints in the text."""
        grams, pairs = _grams(numbers), _grams(numbers, 2)
        places = winnow(grams)
        hits: dict[int, list[int]] = defaultdict(list)
        for found, keys, own in ((places[np.isin(grams[places], self.prints)], grams, self.places), (np.flatnonzero(np.isin(pairs, self.pair_prints)), pairs, self.pairs)):
            for at in found.tolist():
                for t, place in own[int(keys[at])]:
                    hits[t].append(at - place)
        return hits

    def matches(self, text: str | None, coverage: float) -> list[dict]:
        words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(LETTERS).split()
        numbers = np.fromiter(map(self.number.get, words, iter(lambda: 0, None)), np.int64, len(words))
        found = []
        for t, diagonals in self._hits(numbers).items():
            template = self.templates[t]
            shared = np.concatenate([[0], np.cumsum(np.isin(numbers, template))])
            for start, stop in self._groups(sorted(diagonals), len(template)):
                a, b = max(0, start - BAND), min(len(words), stop + len(template) + BAND)
                if shared[b] - shared[a] < coverage * len(template):           # too few words of the template are there
                    continue
                count, first, last = align(template, numbers[a:b])
                if count >= coverage * len(template):
                    found.append({"licence": self.names[t], "template": t, "coverage": count / len(template), "first_word": a + first, "last_word": a + last})
        return self._longest(found)

    @staticmethod
    def _groups(diagonals: list[int], length: int) -> list[tuple[int, int]]:
        """Ranges of nearly equal diagonals."""
        out: list[list[int]] = []
        for d in diagonals:
            if out and d - out[-1][1] <= BAND and d - out[-1][0] <= 2 * BAND:
                out[-1][1] = d
            else:
                out.append([d, d])
        return [(a, b) for a, b in out]

    def _longest(self, found: list[dict]) -> list[dict]:
        """Of matches that overlap the one with most matched words stays, then the better covered, then the earlier template."""
        kept: list[dict] = []
        for m in sorted(found, key=lambda m: (-m["coverage"] * len(self.templates[m["template"]]), -m["coverage"], m["template"], m["first_word"])):
            if all(m["last_word"] < k["first_word"] or m["first_word"] > k["last_word"] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m["first_word"])


def scan(docs: DataFrame, name: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with an array column ``name``: licence, template (its place in the list), coverage, first and last matched word.

    Word places count from 0 over the whole text. Null and empty texts match nothing. Rows are neither moved nor lost.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))          # TEMPLATE_WORDS at most

    def matches(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.matches(t, coverage) for t in text])
    matches.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return docs.withColumn(name, F.pandas_udf(matches, MATCH)("text"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    return found.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("found.licence")), ",").alias("licences"),
                        F.coalesce(F.array_max("found.coverage"), F.lit(0.0)).alias("best_coverage"), F.to_json("found").alias("matches"))
