"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them.

A template's k-word shingles are hashed and winnowed (the smallest hash of every ``WINDOW`` in a row is kept), and
the kept ones are filed in an inverted index. Texts are first searched for the anchors, a word of each filed
shingle, so most are done with after one pass. In the others each shingle is looked up; hits near the same diagonal
are one candidate, which is aligned with the template word by word within a band around that diagonal. The words that tell
a licence from its relatives (its family, version and deciding clauses) weigh more than others: each such phrase has to
stand word for word in the matched span, or there is no match, however much of the rest agrees.

Templates are a fixed list; index and anchors go to the tasks with the function. Each text is scanned by itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, BAND = 3, 2, 6
WORDS = re.compile(r"\w+(?:[.+-]\w+)*")

# fixed values: licence notices and texts as they are published
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. "
)
ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB_TEXT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
    "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
    "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
    "distribution."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
#: Families with their versions: GNU by name, Creative Commons by its kinds.
GNU = {
    "gpl": ("GNU General Public License", ["1", "2", "3"]),
    "lgpl": ("GNU Lesser General Public License", ["2.1", "3"]),
    "agpl": ("GNU Affero General Public License", ["3"]),
}
CC_KINDS, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["1.0", "2.0", "2.5", "3.0", "4.0"]
APACHE_VERSIONS = ["1.0", "1.1", "2.0"]


def _templates() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Texts by name, and the phrases that must stand word for word in a match: family, version, deciding clause."""
    found = {
        "mit-notice": ("Released under the MIT License.", ["MIT License"]),
        "mit": (MIT_TEXT, ["free of charge", "sell copies of the software"]),
        "mit-full": (MIT_TEXT + MIT_DISCLAIMER, ["free of charge", "sell copies of the software"]),
        "isc": (ISC_TEXT, ["with or without fee"]),
        "isc-full": (ISC_TEXT + ISC_DISCLAIMER, ["with or without fee"]),
        "bsd": (BSD_CLAUSES.split(" 2. ")[0].replace("1. ", ""), ["redistribution and use"]),
        "bsd-2-clause": (BSD_CLAUSES + BSD_DISCLAIMER, ["redistribution and use", "binary form must reproduce"]),
        "bsd-3-clause": (BSD_CLAUSES + BSD_THIRD + BSD_DISCLAIMER, ["redistribution and use", "binary form must reproduce", "neither the name"]),
        "zlib": (ZLIB_TEXT, ["altered source versions must be plainly marked"]),
        "apache-2.0": (APACHE_NOTICE, ["Apache License", "version 2.0"]),
        "mpl-2.0": (MPL_NOTICE, ["Mozilla Public License", "v 2.0"]),
    }
    for v in APACHE_VERSIONS:
        found[f"apache-{v}-notice"] = (f"Licensed under the Apache License, Version {v}.", ["Apache License", f"version {v}"])
    for short, (name, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            found[f"{short}-{full}-notice"] = (f"This work is licensed under the {name}, version {v}.", [name, f"version {v}"])
            found[f"{short}-{full}"] = (GNU_NOTICE.format(name=name, version=v), [name, f"version {v}"])
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            found[f"cc-{kind.lower()}-{v}-notice"] = (f"Licensed under CC {kind} {v}.", [f"CC {kind} {v}"])
    return {n: t for n, (t, _) in found.items()}, {n: tuple(p) for n, (_, p) in found.items()}


TEMPLATES, DECIDING = _templates()

MATCHES = "template string, coverage double, matched_words int, start_word int, end_word int, start_char int, end_char int"


def split_words(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


def winnowed(words: list[str]) -> dict[tuple, list[int]]:
    """Kept shingles of a template with their positions."""
    import xxhash

    shingles = [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s)) for s in shingles]
    kept = defaultdict(list)
    chosen = set()
    for i in range(max(1, len(hashes) - WINDOW + 1)):
        part = range(i, min(i + WINDOW, len(hashes)))
        chosen.add(min(part, key=lambda j: (hashes[j], -j)))
    for i in sorted(chosen):
        kept[shingles[i]].append(i)
    return kept


def _phrase_in(phrase: list[str], words: list[str]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


class Index:
    def __init__(self, templates: Mapping[str, str], deciding: Mapping[str, Sequence[str]] = {}):
        self.words = {name: [w for w, _, _ in split_words(t)] for name, t in templates.items()}
        self.words = {name: w for name, w in self.words.items() if w}
        self.deciding = {name: [[w for w, _, _ in split_words(p)] for p in deciding.get(name, ())] for name in self.words}
        self.filed: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            for shingle, places in winnowed(words).items():
                self.filed[shingle] += [(name, p) for p in places]
        self.sizes = sorted({len(s) for s in self.filed})
        self.anchors = sorted({max(s, key=len) for s in self.filed})

    def scanner(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in self.anchors:
            found.add_word(word, word)
        if self.anchors:
            found.make_automaton()
        return found

    def candidates(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """(template, where it would begin in the text), one for each cluster of hits on nearby diagonals."""
        begins = defaultdict(list)
        for size in self.sizes:
            for i in range(len(words) - size + 1):
                for name, place in self.filed.get(tuple(words[i : i + size]), ()):
                    begins[name].append(i - place)
        for name, at in begins.items():
            at.sort()
            last = None
            for b in at:
                if last is None or b - last > BAND:
                    yield name, b
                    last = b


def align(template: list[str], words: list[str], begin: int) -> tuple[int, int, int]:
    """Best local alignment near the diagonal: (matched words, first word, end word) in ``words``.

    Match 1, mismatch and gap -1 within BAND words of the diagonal that starts at ``begin``.
    """
    best, width = (0, 0, 0, 0), 2 * BAND + 1
    row = [(0, 0, 0)] * width  # score, matched, first word; column c of row i is word begin + i + c - BAND
    for i, wanted in enumerate(template):
        new, left = [], (0, 0, 0)
        for c in range(width):
            j = begin + i + c - BAND
            cell = (0, 0, j + 1)
            if 0 <= j < len(words):
                score, matched, first = row[c]
                first = first if score > 0 else j
                if words[j] == wanted:
                    cell = (score + 1, matched + 1, first)
                elif score > 1:
                    cell = (score - 1, matched, first)
                skip = row[c + 1] if c + 1 < width else (0, 0, 0)  # a word of the template is missing
                for score, matched, first in (skip, left):
                    if score - 1 > cell[0]:
                        cell = (score - 1, matched, first)
                if cell[0] > best[0]:
                    best = (*cell, j + 1)
            new.append(cell)
            left = cell
        row = new
    return best[1], best[2], best[3]


def scan_text(index: Index, scanner, text: str, least: float) -> list[tuple]:
    if not text or not index.anchors or next(scanner.iter(text.lower()), None) is None:
        return []
    placed = split_words(text)
    words = [w for w, _, _ in placed]
    found = {}
    for name, begin in index.candidates(words):
        matched, first, end = align(index.words[name], words, begin)
        coverage = matched / len(index.words[name])
        if matched and coverage >= least and all(_phrase_in(p, words[first:end]) for p in index.deciding[name]):
            match = (name, coverage, matched, first, end, placed[first][1], placed[end - 1][2])
            if match > found.get((name, first), ("",)):
                found[name, first] = match
    return sorted(found.values(), key=lambda m: (m[3], m[0]))


def scan(
    df: DataFrame,
    key: str,
    text: str,
    templates: Mapping[str, str] = TEMPLATES,
    deciding: Mapping[str, Sequence[str]] = DECIDING,
    least: float = 0.7,
) -> DataFrame:
    """Rows (key, template, coverage, matched_words, start_word, end_word, start_char, end_char), one per match.

    Coverage is the share of the template's words that the alignment matches, in order; ends are exclusive, characters
    count in the text as it is. The ``deciding`` phrases of a template (none for names that are not there) must stand
    in the span word for word. Null and empty texts match nothing; repeated rows are reported once each; an empty
    table or no templates give no rows.
    """
    index = Index(templates, deciding)
    names = [f.split()[0] for f in MATCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = index.scanner()
        schema = pa.schema(
            [("key", pa.int64()), ("template", pa.string()), ("coverage", pa.float64())] + [(n, pa.int32()) for n in names[2:]]
        )
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("key"), batch.column("text")):
                hits = scan_text(index, scanner, t.as_py(), least)
                rows += [(k.as_py(), *h) for h in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("length(text) > 0")
    return rows.mapInArrow(run, "key bigint, " + MATCHES)
