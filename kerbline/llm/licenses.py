"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits in lower case (all characters beyond ASCII count as letters).
Templates are cut into ``GRAM``-word fingerprints, winnowed (the least hash of every ``WINDOW`` neighbours
stays) and kept in an inverted index: hash to (template, place). Every fingerprint of a document is looked
up. Hits of one template whose implied beginnings lie within the band of each other are one candidate.

A candidate is aligned with its template: word by word, within ``BAND`` of the implied diagonal (less than the template is long), for the
most matched words (then the shortest stretch). It is reported when the matched share of the template
reaches ``COVERAGE``, with the span of code points from its first to its last matched word. A candidate whose
stretch has too few of the template's words, in any order, need not be aligned. Where reports
of one document overlap, the one with more matched words stays (then the earlier one, then the template
listed first).

Templates torn apart by foreign or missing words are followed by chains: fingerprints that a template has
once, in the order of both texts, with the longest common subsequence of what lies between two of them, however
long it is. A foreign block of up to ``FOREIGN`` words (or the template's length, if that is more) does not end
a chain; a chain needs a tenth of the template's fingerprints. Both ways are taken for templates of every length.

The catalogue has a fixed size and is sent to the tasks; documents are scanned in one pass without a
shuffle, each text whole. Null and empty texts give no matches. Repeated rows each get their own result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import fresh

GRAM = 3
WINDOW = 2
BAND = 6
COVERAGE = 0.8
FOREIGN = 100

_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(what: str, name: str, sep: str, version: str) -> str:
    return (
        f"This {what} is free software{':' if sep == ',' else ';'} you can redistribute it and/or modify it under the terms of the GNU {name} as "
        f"published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version.")


#: Wording of public licence notices, by identifier.
TEMPLATES: dict[str, str] = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at"),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:"),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "All-rights-reserved": "All rights reserved.",
    "GPL-2.0-header": _gnu("program", "General Public License", ";", "2"),
    "LGPL-2.1-header": _gnu("library", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-header": _gnu("program", "Lesser General Public License", ",", "3"),
    "AGPL-3.0-header": _gnu("program", "Affero General Public License", ",", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-2-Clause": _CLAUSES + _DISCLAIMER,
    "BSD-3-Clause": _CLAUSES + _THIRD + _DISCLAIMER,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law."),
    # Whole licences, as published.
    **{f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}

_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_LETTERS).split()


def fingerprints(words: list[bytes]) -> np.ndarray:
    """A hash per place; none for fewer words than ``GRAM``."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    total = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        total = total * _FACTOR + h[i:n + i]
    return total ^ (total >> np.uint64(29))


def winnowed(prints: np.ndarray) -> list[int]:
    """Places of the least fingerprint of each window; the rightmost of equal ones."""
    if len(prints) <= WINDOW:
        return [int(prints.argmin())] if len(prints) else []
    return sorted({i + WINDOW - 1 - int(prints[i:i + WINDOW][::-1].argmin()) for i in range(len(prints) - WINDOW + 1)})


@dataclass
class Index:
    """Template words, and where the sorted fingerprints occur."""

    names: list[str]
    words: list[list[bytes]]
    hashes: np.ndarray
    places: list[list[tuple[int, int]]]
    once: list[set[int]]  # places of the fingerprints that a template has once
    sizes: list[int]


def build_index(templates: dict[str, str]) -> Index:
    words, places, once = [words_of(t) for t in templates.values()], defaultdict(list), []
    for t, w in enumerate(words):
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least")
        prints = fingerprints(w)
        often = Counter(prints.tolist())
        once.append(set())
        for i in winnowed(prints):
            places[int(prints[i])].append((t, i))
            if often[int(prints[i])] == 1:
                once[t].add(i)
    keys = sorted(places)
    return Index(list(templates), words, np.array(keys, dtype=np.uint64), [places[k] for k in keys], once, [len(x) for x in once])


@dataclass(frozen=True)
class Match:
    template: int
    matched: int
    first: int  # word places in the document
    last: int


def _band(template: list[bytes]) -> int:
    """Less than the template is long, so that one repetition of it is not taken for the next."""
    return min(BAND, len(template) - 1)


def align(template: list[bytes], words: list[bytes], start: int, t: int) -> Match | None:
    """The most matched words with the document place within the band of ``start`` plus the template place."""
    band = _band(template)
    width = 2 * band + 1
    # Cell c of row i stands for document place start + i - band + c; values are (matched, first, last).
    none = (0, 0, 0)
    above = [none] * width
    for i, w in enumerate(template):
        row, left = [], none
        for c in range(width):
            place = start + i - band + c
            best = above[c + 1] if c + 1 < width else none  # template word unmatched
            if left[0] > best[0] or (left[0] == best[0] and left[2] - left[1] < best[2] - best[1]):
                best = left  # document word unmatched
            if 0 <= place < len(words) and words[place] == w:
                n, first, _ = above[c]
                if n + 1 > best[0] or (n + 1 == best[0] and place - (first if n else place) < best[2] - best[1]):
                    best = (n + 1, first if n else place, place)
            row.append(best)
            left = best
        above = row
    n, first, last = max(above, key=lambda x: (x[0], x[1] - x[2]))
    return Match(t, n, first, last) if n else None


def _between(a: list[bytes], b: list[bytes]) -> int:
    """Matched words of two stretches, in order: their longest common subsequence, a row of bits per word of ``b``."""
    places: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(a):
        places[w] |= 1 << i
    all_bits = (1 << len(a)) - 1
    row = all_bits  # a zero where the number of matches rises by one
    for w in b:
        at = row & places.get(w, 0)
        if at:
            row = ((row + at) | (row - at)) & all_bits
    return len(a) - row.bit_count()


def _longest(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the hits, in the order of the document, that rises in the template too."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(hits)
    for k, (_, i) in enumerate(hits):
        at = bisect_left(tails, i)
        before[k] = ends[at - 1] if at else -1
        tails[at:at + 1] = [i]
        ends[at:at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(hits[k])
        k = before[k]
    return out[::-1]


def chains(template: list[bytes], words: list[bytes], hits: list[tuple[int, int]], least: int, t: int) -> list[Match]:
    """A match per stretch of hits (document place, template place) that holds ``least`` in order."""
    stretches: list[list[tuple[int, int]]] = []
    for hit in hits:
        last = stretches[-1][-1] if stretches else None
        if last is None or hit[0] - last[0] > max(FOREIGN, len(template)) + GRAM or hit[1] < last[1] - len(template) / 2:
            stretches.append([])
        stretches[-1].append(hit)
    out = []
    for stretch in stretches:
        chain = _longest(stretch)
        if len(chain) < least:
            continue
        (place, i), matched = chain[0], GRAM
        first = place
        if i:
            low = max(0, place - i - BAND)
            m = align(template[:i], words[low:place], place - i - low, t)
            if m:
                matched, first = matched + m.matched, low + m.first
        for p, j in chain[1:]:
            # Both stretches lie behind the last fingerprint; fingerprints may share words.
            step = min(p - place, j - i)
            matched += step if step < GRAM else GRAM + _between(template[i + GRAM:j], words[place + GRAM:p])
            place, i = p, j
        last = place + GRAM - 1
        rest = template[i + GRAM:]
        if rest:
            m = align(rest, words[last + 1:last + 1 + len(rest) + BAND], 0, t)
            if m:
                matched, last = matched + m.matched, last + 1 + m.last
        out.append(Match(t, matched, first, last))
    return out


def _common_words(template: list[bytes], words: list[bytes]) -> Callable[[int, int], int]:
    """A function of a stretch of the document: words it has in common with the template, in any order.

    No alignment inside the stretch matches more, so one that falls short need not be made.
    """
    number = {w: n for n, w in enumerate(dict.fromkeys(template))}
    wanted = np.bincount([number[w] for w in template])
    of_words = np.array([number.get(w, len(number)) for w in words])

    def common(start: int, end: int) -> int:
        had = np.bincount(of_words[max(0, start):max(0, end)], minlength=len(number) + 1)
        return int(np.minimum(had[:-1], wanted).sum())

    return common


def matches_of(index: Index, words: list[bytes]) -> list[Match]:
    prints = fingerprints(words)
    if not len(prints) or not len(index.hashes):
        return []
    at = np.minimum(np.searchsorted(index.hashes, prints), len(index.hashes) - 1)
    hits = np.flatnonzero(index.hashes[at] == prints)
    by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place in hits.tolist():
        for t, i in index.places[at[place]]:
            by_template[t].append((place, i))
    found = []
    for t, all_hits in by_template.items():
        template, until = index.words[t], None
        begins, needed = {place - i for place, i in all_hits}, COVERAGE * len(template)
        common = _common_words(template, words)
        for begin in sorted(begins):
            if until is not None and begin <= until:
                continue
            band = _band(template)
            until = begin + band
            if common(begin - band, begin + len(template) + band) < needed:
                continue
            m = align(template, words, begin, t)
            if m and m.matched >= needed:
                found.append(m)
        least = max(2, index.sizes[t] // 10)
        once = [(place, i) for place, i in all_hits if i in index.once[t]]
        if len({i for _, i in once}) >= least:
            found += [m for m in chains(template, words, once, least, t) if m.matched >= needed]
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.matched, m.first, m.template)):
        if all(m.last < k.first or k.last < m.first for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.first)


MATCH = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", into: str = "licenses") -> DataFrame:
    """Add ``into``: the matches (license, coverage, start, end) by place."""
    index = build_index(templates)
    keep = [c for c in docs.columns if c != into]
    source = fresh(docs, "__text")

    @F.pandas_udf(MATCH)
    def scan(column: pd.Series) -> pd.Series:
        out = []
        for x in column:
            found = matches_of(index, words_of(x)) if x else []
            if found:
                spans = [m.span() for m in _WORD.finditer(x)]
                found = [{"license": index.names[m.template], "coverage": m.matched / len(index.words[m.template]),
                          "start": spans[m.first][0], "end": spans[m.last][1]} for m in found]
            out.append(found)
        return pd.Series(out, dtype=object)

    return docs.withColumn(source, scan(F.col(text))).select(*[F.col(f"`{c}`") for c in keep], F.col(source).alias(into))
