"""License scans by Dice coefficient over word bigrams.

Texts are normalised (lower case, no punctuation, no copyright lines) and compared with templates by
2 |A and B| / (|A| + |B|) over sets of word bigrams, the whole text as well as each paragraph and each line
of it, since notices stand inside longer documents. A score of t needs |A| between t / (2 - t) |B| and
(2 - t) / t |B|: passages beyond these bounds of every template are not looked at, and templates beyond
them are not compared. With ``inside``, which the query sets, windows of words anywhere in the text are
compared too: where a text holds enough of a template's bigrams to reach t at all, the best end is taken for
every start, and of the stretches that no reported one overlaps the most alike are reported. Templates are few and fixed; documents are scanned where they lie, without a shuffle.

Edge cases: null and empty texts match nothing; ties go to the first name in order; repeated rows each get
a row; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

THRESHOLD = 0.9
#: A window of more bigrams than this many times the different ones that can reach the threshold is mostly repeated.
REPEATED = 8

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts and the notices by which works refer to them.
TEMPLATES = {
    "MIT": [f"MIT License\n{_GRANT}\n{_AS_IS}", f"{_GRANT}\n{_AS_IS}", "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "BSD-2-Clause": [f"{_BSD}\n{_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD}\n{_BSD_THIRD}\n{_BSD_AS_IS}"],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."""],
    "AGPL-3.0": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "0BSD": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Unlicense": ["""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""],
}

_COPYRIGHT = re.compile(r"^\W*copyright\s*(?:\(c\)|©|\d{4}).*$", re.IGNORECASE | re.MULTILINE)
_SPLIT = re.compile(r"[^\w]+|_")
_WORD = re.compile(r"[^\W_]+")


def all_templates() -> dict[str, list[str]]:
    """TEMPLATES and the full licence texts in ``license_texts``."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text())
    return out


def normalised(text: str) -> list[str]:
    """Words of a passage."""
    if "opyright" in text or "OPYRIGHT" in text:
        text = _COPYRIGHT.sub("", text)
    return [w for w in _SPLIT.split(text.lower()) if w]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Template(NamedTuple):
    name: str
    grams: frozenset


class Matcher:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [Template(n, frozenset(bigrams(normalised(t)))) for n in sorted(templates) for t in templates[n]]
        self.having = defaultdict(list)
        for i, t in enumerate(self.templates):
            for g in t.grams:
                self.having[g].append(i)
        sizes = [len(t.grams) for t in self.templates]
        self.least, self.most = self.bounds(min(sizes))[0], self.bounds(max(sizes))[1]

    def bounds(self, size: int) -> tuple[float, float]:
        """Sizes that can reach the threshold against a set of this size."""
        return self.threshold / (2 - self.threshold) * size, (2 - self.threshold) / self.threshold * size

    def best(self, passage: str) -> tuple[str, float] | None:
        """The template most alike, if the threshold is reached."""
        if len(passage) < self.least:
            return None
        words = normalised(passage)
        if not self.least <= len(words) - 1:
            return None
        grams = bigrams(words)
        if not self.least <= len(grams) <= self.most:
            return None
        low, high = self.bounds(len(grams))
        shared = Counter(i for g in grams if g in self.having for i in self.having[g])
        found = [(2 * n / (len(grams) + len(t.grams)), t.name) for i, n in shared.items() if low <= len((t := self.templates[i]).grams) <= high]
        score, name = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0.0, ""))
        return (name, score) if score >= self.threshold else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(name, score, start, end) of the whole text, its paragraphs and its lines, in code points; each stretch once."""
        if not text:
            return []
        spans = {(0, len(text))}
        for split in ("\n\n", "\n"):
            at = 0
            for part in text.split(split):
                if part:
                    spans.add((at, at + len(part)))
                at += len(part) + len(split)
        found = [(*hit, a, b) for a, b in sorted(spans) if (hit := self.best(text[a:b]))]
        return sorted(found, key=lambda x: (x[2], -x[3]))

    def held(self, grams: set) -> list[int]:
        """Templates of which so many bigrams are there that a part of the text can reach the threshold."""
        shared = Counter(i for g in grams & self.having.keys() for i in self.having[g])
        return [i for i, n in shared.items() if n >= self.bounds(len(self.templates[i].grams))[0]]

    def _repeated(self, grams: list, words: list, hits: dict, late: dict) -> list[tuple[str, float, int, int]]:
        """Windows from starts behind which little is new, for templates (late: {start: templates}): the places where each
        bigram stands next are kept in order from the end of the text on, so a window costs its different bigrams only."""
        places: list[int] = []  # of the next place of each bigram, negative, rising
        there: dict = {}
        out = []
        for a in range(len(grams) - 1, min(late) - 1, -1):
            if (old := there.get(grams[a])) is not None:
                del places[bisect_left(places, -old)]
            there[grams[a]] = a
            places.append(-a)
            for i in late.get(a, ()):
                name, own = self.templates[i]
                at = -np.array(places[-int(self.bounds(len(own))[1]) :][::-1], np.int64)
                shared = np.cumsum(hits[i][at])
                score = 2 * shared / (np.arange(1, len(at) + 1) + len(own))
                e = int(score.argmax())
                if score[e] >= self.threshold:
                    out.append((name, float(score[e]), words[a][1], words[int(at[e]) + 1][2]))
        return out

    def windows(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """The matches of scan and, where none of them is, windows of words that reach the threshold, most alike first."""
        found = self.scan(text)
        if not text or not (held := self.held(bigrams(normalised(text)))):
            return found
        plain = _COPYRIGHT.sub(lambda m: " " * len(m[0]), text) if "opyright" in text or "OPYRIGHT" in text else text
        words = [(w, m.start(), m.end()) for m in _WORD.finditer(plain) for w in _SPLIT.split(m[0].lower()) if w]
        grams = [(a[0], b[0]) for a, b in zip(words, words[1:])]
        before, seen = np.empty(len(grams), np.int64), {}  # where the same bigram stood last
        for p, g in enumerate(grams):
            before[p] = seen.get(g, -1)
            seen[g] = p
        more, hits, late = [], {}, defaultdict(list)
        for i in held:
            name, own = self.templates[i]
            hit = hits[i] = np.fromiter((g in own for g in grams), bool, len(grams))
            low, high = self.bounds(len(own))
            for a in np.flatnonzero(hit).tolist():
                size = 2 * int(high) + 2
                while True:  # until the window holds more bigrams than can reach the threshold
                    new = before[a : a + size] < a
                    many = np.cumsum(new)
                    if many[-1] > high or a + size >= len(grams) or size > REPEATED * high:
                        break
                    size *= 2
                if many[-1] <= high and a + size < len(grams):  # mostly what stood before
                    late[a].append(i)
                    continue
                shared = np.cumsum(new & hit[a : a + size])
                if shared[-1] < low:
                    continue
                score = 2 * shared / (many + len(own))
                e = int(score.argmax())
                if score[e] >= self.threshold:
                    more.append((name, float(score[e]), words[a][1], words[a + e + 1][2]))
        if late:
            more += self._repeated(grams, words, hits, late)
        starts, ends = [], []  # what is taken, as stretches apart from one another
        for a, b in sorted((a, b) for _, _, a, b in found):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for hit in sorted(more, key=lambda x: (-x[1], x[2] - x[3], x[2], x[0])):
            k = bisect_left(starts, hit[3])
            if not k or ends[k - 1] <= hit[2]:
                found.append(hit)
                starts.insert(k, hit[2])
                ends.insert(k, hit[3])
        return sorted(found, key=lambda x: (x[2], -x[3]))


def scan_licenses(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, inside: bool = False) -> DataFrame:
    """(doc_id, matches): every match of every whole text; inside: of windows of words, too."""
    templates = dict(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in slices(batches):
            found = [[{"license": n, "score": s, "start": a, "end": b} for n, s, a, b in (matcher.windows(t) if inside else matcher.scan(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "matches"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(narrow, run, "doc_id long, matches array<struct<license:string,score:double,start:long,end:long>>")


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, license, score, n_matches, licenses): the best match and all names."""
    best = F.sort_array(F.transform("matches", lambda m: F.struct((-m["score"]).alias("s"), m["license"].alias("license"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.expr("get(best, 0).license").alias("license"),
        F.expr("-get(best, 0).s").alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("matches.license")))).alias("licenses"),
    )
