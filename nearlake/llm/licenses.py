"""License scans by conditional compression.

Stretches of text around words that licenses use are compressed alone and with each template as
a raw zstandard dictionary. Templates are ranked by how much smaller that makes the stretch, and
all that make it smaller are confirmed by the exact differences in wording.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import text_of

# Public license texts and notices, by SPDX identifier.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TOP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU General Public License for more details."
)
_LGPL_NOTICE = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version {} of the License, or (at your option) any later version. This library is distributed in the hope "
    "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
    "the GNU Lesser General Public License for more details."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
    "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices "
    "in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in "
    "all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in "
    "the form of machine-executable object code generated by a source language processor."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_CC_KINDS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: Identifiers for which an SPDX line stands, and older forms of them.
_IDS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1"
).split()
_OLD_IDS = {i.removesuffix("-only"): i for i in _IDS if i.endswith("-only")}
#: Names by which notices call a license.
_NAMES = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("GPL-2.0-only", "GNU General Public License, version 2"),
    ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("GPL-2.0-only", "GNU General Public License v2.0"),
    ("GPL-3.0-only", "GNU General Public License v3.0"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
)
_SHORT = (("MIT", "MIT"), ("Apache-2.0", "Apache 2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("GPL-2.0-only", "GPLv2"), ("GPL-3.0-only", "GPLv3"), ("MPL-2.0", "MPL 2.0"), ("ISC", "ISC"))
_TITLES = (
    ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
)
_TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", _GPL_NOTICE.format(2)),
    ("GPL-3.0-or-later", _GPL_NOTICE.format(3)),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1-or-later", _LGPL_NOTICE.format("2.1")),
    ("LGPL-3.0-or-later", _LGPL_NOTICE.format("3")),
    ("AGPL-3.0-or-later", _GPL_NOTICE.replace("General", "Affero General").format(3)),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
TEMPLATES = (
    *_TEXTS,
    *_TITLES,
    *((f"CC-{k}-4.0", _CC.format(name)) for k, name in _CC_KINDS),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k, _ in _CC_KINDS),
    *((i, f"{verb} under the {name}.") for verb in ("Licensed", "Released") for i, name in _NAMES),
    *_NAMES,
    *((i, f"License: {name}") for i, name in _SHORT),
    *((i, f"SPDX-License-Identifier: {i}") for i in _IDS),
    *((i, f"SPDX-License-Identifier: {old}") for old, i in _OLD_IDS.items()),
)

TRIGGERS = ("licens", "licenc", "copyright", "warrant", "redistribut", "public domain", "spdx", "hereby granted", "creative commons")
TRIGGER = re.compile("|".join(TRIGGERS), re.I)
WORD = re.compile(r"\w+(?:[.+-]\w+)*")
#: Words that tell one license from another: a difference in them is never small.
TELLING = re.compile(r"\d|^(?:mit|isc|bsd|apache|gnu|gpl|lgpl|agpl|lesser|affero|mozilla|mpl|cc|cc0|by|sa|nc|nd|by-sa|by-nc|by-nc-sa|by-nd|mit-0|nc-sa|nc-nd|by-nc-nd|not|non|never|except|without|attribution\S*|sharealike|noncommercial)$")
#: Words around a trigger that belong to its stretch: few at first, more where that explains nothing.
AROUND = (40, 160)
#: Words around each trigger that are looked at alone where a longer stretch explains nothing.
NARROW = 20
#: The longest stretch looked at at once, and the words that two looks share.
LONGEST, OVERLAP = 1200, 400
DIFFERENT = 0.1
# Words that join licenses in an expression, that stand right before an identifier, and that may stand between a negation and what it denies.
JOINING = frozenset("and or with".split())
BEFORE_ID = frozenset("license licence licenses licences licensed spdx-license-identifier".split())
DENIED = re.compile(r"(?:\b(?:not|never|cannot|nor|neither|no longer)|n't)\s+(?:(?:yet|been|being|be|is|are|made|released|licensed|distributed|available|covered|provided|published|offered|governed|under|by|for|use|as|in|the|terms|of|a|an|any|either)\s+)*$", re.I)


@dataclass(frozen=True)
class Finding:
    license_id: str
    template: int
    start: int
    end: int
    reduction: float
    missing: tuple[str, ...]
    added: tuple[str, ...]


@lru_cache(1)
def _prepared() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, text in TEMPLATES:
        words = [w.lower() for w in WORD.findall(text)]
        raw = zstandard.ZstdCompressionDict((" " + " ".join(words) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=9)
        out.append((name, words, zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)))
    return out


def reductions(words: list[str]) -> list[tuple[int, float, int]]:
    """(bytes saved, part of the compressed size, template) for each template, the largest saving first."""
    data = " ".join(words).encode()
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(data))
    saved = [(alone - len(c.compress(data)), i) for i, (_, _, c) in enumerate(_prepared())]
    return [(n, n / alone, i) for n, i in sorted(saved, key=lambda s: (-s[0], s[1]))]


def wording(template: list[str], words: list[str]) -> tuple[int, int, tuple[str, ...], tuple[str, ...]] | None:
    """Where a template stands in the words, and which of its words are missing or others added there."""
    matched = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    if not matched:
        return None
    # stray words far from the longest match don't belong to it
    core = max(range(len(matched)), key=lambda k: matched[k].size)
    kept = [matched[core]]
    reach = max(3, len(template) // 5)
    for m in matched[core + 1 :]:
        if m.b - kept[-1].b - kept[-1].size > reach:
            break
        kept.append(m)
    for m in reversed(matched[:core]):
        if kept[0].b - m.b - m.size > reach:
            break
        kept.insert(0, m)
    start, end = kept[0].b, kept[-1].b + kept[-1].size
    here = {i for m in kept for i in range(m.a, m.a + m.size)}
    there = {i for m in kept for i in range(m.b, m.b + m.size)}
    return (
        start,
        end,
        tuple(w for i, w in enumerate(template) if i not in here),
        tuple(words[i] for i in range(start, end) if i not in there),
    )


def _confirmed(template: list[str], missing: tuple[str, ...], added: tuple[str, ...]) -> bool:
    allowed = max(1, int(DIFFERENT * len(template))) if len(template) > 4 else 0
    return len(missing) <= allowed and len(added) <= allowed and not any(TELLING.search(w) for w in missing + added)


def _gram(n: int) -> int:
    """Words in a row that a place has in common with a template of n words wherever the differences stand that are allowed, but for two beside each other in a short one."""
    return n if n <= 4 else 2 if n < 10 else 3


@lru_cache(1)
def _grams() -> dict[tuple[str, ...], list[tuple[int, int]]]:
    """From words in a row to (template, place in it)."""
    out: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for i, (_, words, _) in enumerate(_prepared()):
        g = _gram(len(words))
        for at in range(len(words) - g + 1):
            out.setdefault(tuple(words[at : at + g]), []).append((i, at))
    return out


def _anchors(words: list[str]) -> dict[int, list[tuple[int, int]]]:
    """For each template (where it would begin, place in it) of the words in a row that it shares."""
    grams, out = _grams(), {}
    for g in (2, 3, 4):
        for at in range(len(words) - g + 1):
            for i, place in grams.get(tuple(words[at : at + g]), ()):
                out.setdefault(i, []).append((at - place, place))
    return out


def _windows(n: int, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The ranges of words where a template of n words may stand: bounded ones, around anchors that agree on its beginning.

    With at most d words missing and d added, all but 2 d * g of its words in a row are found at one place.
    """
    g = _gram(n)
    d = max(1, int(DIFFERENT * n)) if n > 4 else 0
    anchors.sort()
    k = 0
    while k < len(anchors):
        first, stop, places = anchors[k][0], k, set()
        while stop < len(anchors) and anchors[stop][0] - first <= 2 * d:
            places.add(anchors[stop][1])
            stop += 1
        if len(places) >= max(1, n - g + 1 - 2 * d * g):
            yield max(0, first - d - 1), first + n + 3 * d + 1
        # the next one may begin within this one's slack
        k = next((j for j in range(k + 1, stop) if anchors[j][0] - first > d), stop)


def _search(words: list[str], places: list[tuple[int, int]], out: list[Finding], narrow: bool = True) -> None:
    """Findings in a look: of all templates that make it smaller every confirmed place, those that explain most first."""
    if len(words) < 2 or not TRIGGER.search(" ".join(words)):
        return
    anchors = _anchors(words)
    confirmed: dict[tuple[int, int, int], tuple] = {}
    for saved, reduction, i in reductions(words) if anchors else ():
        if saved <= 0:
            break
        name, template, _ = _prepared()[i]
        for a, b in _windows(len(template), anchors.get(i, [])):
            found = wording(template, words[a:b])
            if found and _confirmed(template, *found[2:]):
                start, end = a + found[0], a + found[1]
                # of confirmed templates the one that explains most, then with the fewest differences
                rank = (end - start - 2 * len(found[2]) - 2 * len(found[3]), reduction, -i, -start)
                confirmed[i, start, end] = rank, start, end, Finding(name, i, places[start][0], places[end - 1][1], round(reduction, 4), *found[2:])
    taken = bytearray(len(words))
    for _, start, end, finding in sorted(confirmed.values(), key=lambda c: c[0], reverse=True):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append(finding)
    if narrow and len(words) > 2 * NARROW + 1:
        _search_narrowly(words, places, taken, out)


def _search_narrowly(words: list[str], places: list[tuple[int, int]], taken: bytearray, out: list[Finding]) -> None:
    """Findings in windows around each trigger without one: there no text nearby hides what a short notice saves, or where it stands."""
    at = 0
    for k, word in enumerate(words):
        if k < at or taken[k] or not TRIGGER.search(word) and not TRIGGER.search(" ".join(words[k : k + 2])):
            continue
        a = next((i + 1 for i in range(k, max(at, k - NARROW) - 1, -1) if taken[i]), max(at, k - NARROW))
        b = next((i for i in range(k, min(len(words), k + NARROW + 1)) if taken[i]), min(len(words), k + NARROW + 1))
        found: list[Finding] = []
        _search(words[a:b], places[a:b], found, False)
        out += found
        # what was looked at isn't looked at again, but for what follows the last finding
        end = max((f.end for f in found), default=0)
        at = next((i for i in range(a, b) if places[i][0] >= end), b) if found else k + NARROW // 2


@lru_cache(1)
def _identifiers() -> dict[tuple[str, ...], tuple[str, int]]:
    """From the words of an identifier or a name without the word license to (identifier, template)."""
    line = {name: i for i, (name, text) in enumerate(TEMPLATES) if text.startswith("SPDX-License-Identifier: ")}
    named = [*((i, i) for i in _IDS), *((i, old) for old, i in _OLD_IDS.items()), *_NAMES, *_SHORT]
    out = {}
    for i, name in named:
        words = [w.lower() for w in WORD.findall(name)]
        for form in (words, words[:-1] if words[-1] == "license" else words, [w for w in words if w != "license"]):
            if form:
                out.setdefault(tuple(form), (i, line[i]))
    return out


def _expressions(words: list[str], spans: list[tuple[int, int]], out: list[Finding]) -> None:
    """Adds what an expression joins to a finding, before and after it, and identifiers right after the word license."""
    names = _identifiers()
    longest = max(map(len, names))
    begin = {s: k for k, (s, _) in enumerate(spans)}
    stop = {e: k + 1 for k, (_, e) in enumerate(spans)}
    taken = bytearray(len(words))
    for f in out:
        taken[begin[f.start] : stop[f.end]] = b"\1" * (stop[f.end] - begin[f.start])

    def named(a: int, forward: bool) -> tuple[int, int] | None:
        """The longest name that begins, or ends, at a word."""
        for n in range(longest, 0, -1):
            x, y = (a, a + n) if forward else (a - n, a)
            if 0 <= x and y <= len(words) and tuple(words[x:y]) in names and not any(taken[x:y]):
                return x, y
        return None

    def add(x: int, y: int) -> None:
        taken[x:y] = b"\1" * (y - x)
        name, template = names[tuple(words[x:y])]
        data = " ".join(words[x:y]).encode()
        alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(data))
        saved = alone - len(_prepared()[template][2].compress(data))
        out.append(Finding(name, template, spans[x][0], spans[y - 1][1], round(max(0, saved) / alone, 4), (), ()))

    for k, word in enumerate(words[:-1]):
        if word in BEFORE_ID and not taken[k + 1] and (found := named(k + 1, True)):
            add(*found)
    for f in list(out):
        a, b = begin[f.start], stop[f.end]
        while b + 1 < len(words) and words[b] in JOINING and (found := named(b + 1, True)):
            add(*found)
            b = found[1]
        while a >= 2 and words[a - 1] in JOINING and (found := named(a - 1, False)):
            add(*found)
            a = found[0]


def find_licenses(text: str) -> list[Finding]:
    """Confirmed licenses of a whole text by place; one that the words before it deny isn't one."""
    lower = text.lower()
    if not any(t in lower for t in TRIGGERS):
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[s:e].lower() for s, e in spans]
    hits = [m.start() for m in TRIGGER.finditer(text)]
    out: list[Finding] = []
    for around in AROUND:
        # findings don't overlap, so in order of their places the last that begins before a hit tells
        done = sorted((f.start, f.end) for f in out)
        starts = [s for s, _ in done]
        left = [h for h in hits if not ((k := bisect_right(starts, h)) and h < done[k - 1][1])]
        for a, b in _stretches(left, spans, around):
            while a < b:
                stop = min(b, a + LONGEST)
                found: list[Finding] = []
                _search(words[a:stop], spans[a:stop], found)
                # what lies in the overlap of two looks is found by one of them whole
                for f in found:
                    k = bisect_right(starts, f.start)
                    if (k == 0 or done[k - 1][1] <= f.start) and (k == len(done) or f.end <= starts[k]):
                        done.insert(k, (f.start, f.end))
                        starts.insert(k, f.start)
                        out.append(f)
                a = b if stop == b else stop - OVERLAP
    out = [f for f in out if not DENIED.search(text[max(0, f.start - 80) : f.start])]
    _expressions(words, spans, out)
    return sorted((f for f in out if not DENIED.search(text[max(0, f.start - 80) : f.start])), key=lambda f: (f.start, f.end, f.template))


def _stretches(hits: list[int], spans: list[tuple[int, int]], around: int) -> list[tuple[int, int]]:
    """Ranges of words around the hits, those that meet as one."""
    near: list[list[int]] = []
    at = 0
    for hit in hits:
        while at < len(spans) and spans[at][1] <= hit:
            at += 1
        if near and at - near[-1][1] <= 2 * around:
            near[-1][1] = at
        else:
            near.append([at, at])
    return [(max(0, a - around), min(len(spans), b + around + 1)) for a, b in near]


FINDINGS = "doc_id long, license_id string, template int, start long, end long, reduction double, exact boolean, missing array<string>, added array<string>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per license found in a document, with its place in code points (end exclusive).

    ``exact`` says that the wording has no difference; else ``missing`` and ``added`` hold the
    differing words. What an expression joins (A or B, A and B) gives a row for each license; a license that is denied (not
    released under ...) gives none. Documents without a license, null and empty texts give no rows, repeated
    rows repeated results, and an empty table none. Very long and repetitive texts take time in proportion to their length.
    """
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = [f.split()[0] for f in FINDINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, f.license_id, f.template, f.start, f.end, f.reduction, not (f.missing or f.added), f.missing, f.added)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for f in find_licenses(text.as_py())
            ]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, FINDINGS)
