"""License notices found by conditional compression.

What a template tells about a block is how much smaller the block gets when it is compressed with the template
as a raw Zstandard dictionary. Templates are tried in the order of that reduction. The wording confirms: block and
template are aligned word by word, words that either has alone are listed, few of them may differ, and
none that tells licenses apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.llm.common import LOWER, id_and_bytes, slices

#: What the public BSD, MIT and ISC licenses say after their copyright lines.
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_CLAUSES = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES'
    " OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,"
    " EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_OPENING = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
MIT_REST = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
    " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
    ' appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(kind: str, license_name: str, stop: str, version: str) -> str:
    return (
        f"This {kind} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {license_name} as published by the"
        f" Free Software Foundation{',' if stop == ':' else ';'} either version {version} of the License, or (at your option) any later version."
    )


#: Wordings of public license notices. BSD alone is the opening that the clauses of several licenses follow.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_OPENING),
    ("MIT", MIT_OPENING + MIT_REST),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("program", "General Public License", ":", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("program", "General Public License", ";", "2")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", ":", "3")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", ":", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSD", BSD_OPENING),
    ("BSD-2-Clause", BSD_OPENING + BSD_CLAUSES + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_OPENING + BSD_CLAUSES + BSD_THIRD + BSD_DISCLAIMER),
    ("ISC", ISC_BODY),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
#: An identifier line for each license that has one.
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name not in ("BSD", "proprietary"))
TEMPLATES += tuple((f"{name}{kind}", f"SPDX-License-Identifier: {name}{end}") for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0") for end, kind in (("-or-later", "-or-later"), ("-only", "")))
#: Words that take a notice back when they stand right before it, and what right behind it makes it another license.
DENIALS = frozenset("not never no isn aren wasn without unlike cannot".split())
LATER = ("or later", "or any later", "or newer", "or at your option any later")
EXCEPTION = re.compile(r"with (?:\S+ ){0,3}exceptions?\b")
BEFORE, BEHIND = 4, 6  # words on either side of a block that are read for these
#: What every template has at least one of, in lower case; a text without any has no candidate block.
MARKS = (b"licen", b"rights reserved", b"permission is hereby", b"permission to use", b"redistribut", b"free software", b"public domain", b"unencumbered", b"creative commons", b"cc0", b"cc by")
#: Words that tell licenses apart, as do all words with a digit. No block that has one more or one less is confirmed.
TELLING = frozenset("affero apache attribution bsd by commons creative domain eclipse except general isc lesser library mit mozilla neither no nor not only public without".split())
_MARK = re.compile(b"|".join(map(re.escape, MARKS)))
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_DIGIT = re.compile("[0-9]|-(?:sa|nc|nd|sharealike|noncommercial|noderivatives)")
IN = 12  # one word in so many may differ
REMEMBERED = 4000  # windows
FOUND = "array<struct<license: string, start: long, stop: long, gain: int, missing: array<string>, added: array<string>>>"


@dataclass(frozen=True)
class Aligned:
    """Block words [start, stop) that stand for a template, and the words that either has alone."""

    start: int
    stop: int
    missing: list[str]
    added: list[str]


def align(template: list[str], words: list[str]) -> Aligned:
    """The block with the fewest words missing or added, of these the one that stops first."""
    costs = [[0] * (len(words) + 1)]
    for i, word in enumerate(template, 1):
        above, row = costs[-1], [i]
        for j, other in enumerate(words):
            row.append(above[j] if word == other else 1 + min(above[j + 1], row[j]))
        costs.append(row)
    stop = j = min(range(len(words) + 1), key=costs[-1].__getitem__)
    i, missing, added = len(template), [], []
    while i:
        if j and template[i - 1] == words[j - 1]:
            i, j = i - 1, j - 1
        elif costs[i][j] == 1 + costs[i - 1][j]:
            i -= 1
            missing.append(template[i])
        else:
            j -= 1
            added.append(words[j])
    return Aligned(j, stop, missing[::-1], added[::-1])


def tells(words: list[str]) -> bool:
    return any(w in TELLING or _DIGIT.search(w) for w in words)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names = [name for name, _ in templates]
        self.texts = [text.encode().translate(LOWER) for _, text in templates]
        self.words = [[w.decode() for w in _WORD.findall(text)] for text in self.texts]
        self.counts = [Counter(words) for words in self.words]
        self.slack = [len(words) // IN for words in self.words]
        self.reach = 2 * max(map(len, self.texts)) + 64  # bytes on each side of a mark that are looked at
        self.seen: dict[tuple[bytes, int, int], list] = {}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = []
        self.marks: dict[bytes, list[tuple[int, int]]] = {mark: [] for mark in MARKS}  # of a mark: templates that have it, and as which of their words
        for k, text in enumerate(self.texts):
            raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False))
            begins = [m.end() for m in _WORD.finditer(text)]
            for mark in _MARK.finditer(text):
                self.marks[mark[0]].append((k, sum(end <= mark.start() for end in begins)))

    def gain(self, k: int, block: bytes) -> int:
        """Bytes by which the block gets smaller when template k is its dictionary."""
        return len(self.plain.compress(block)) - len(self.given[k].compress(block))

    def around(self, body: bytes, mark: re.Match, free: int) -> list[tuple[int, int, int, int, Aligned, str]]:
        """Confirmed blocks that hold the mark, none before `free`: reduction, template, start, stop, alignment, license. What a window gave is remembered, as texts of marks alone repeat theirs."""
        low = max(free, mark.start() - self.reach)
        window = (body[low : mark.end() + self.reach], mark.start() - low, min(1, low - free))
        if window not in self.seen:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            self.seen[window] = [(gain, k, a - low, z - low, got, name) for gain, k, a, z, got, name in self._around(body, mark, free, low)]
        return [(gain, k, a + low, z + low, got, name) for gain, k, a, z, got, name in self.seen[window]]

    def _around(self, body: bytes, mark: re.Match, free: int, low: int) -> list[tuple[int, int, int, int, Aligned, str]]:
        places = [m.span() for m in _WORD.finditer(body, low, mark.end() + self.reach) if low == free or m.start() > low]  # no half word
        words = [body[a:z].decode() for a, z in places]
        at = sum(z <= mark.start() for _, z in places)
        ranked = []
        for k, own in set(self.marks[mark[0]]):
            first, last = max(0, at - own - self.slack[k]), at - own + len(self.words[k]) + self.slack[k]
            near = words[first:last]
            if near and sum((self.counts[k] - Counter(near)).values()) <= self.slack[k]:
                gain = self.gain(k, body[places[first][0] : places[min(last, len(places)) - 1][1]])
                if gain >= min(12, len(self.texts[k]) // 3):
                    ranked.append((gain, k, first, near))
        out = []
        for gain, k, first, near in sorted(ranked, key=lambda x: (-x[0], x[1], x[2])):
            got = align(self.words[k], near)
            if len(got.missing) + len(got.added) <= self.slack[k] and not tells(got.missing + got.added) and got.start <= at - first < got.stop:
                name = self.named(k, words[max(0, first + got.start - BEFORE) : first + got.start], words[first + got.stop : first + got.stop + BEHIND])
                if name:
                    out.append((gain, k, places[first + got.start][0], places[first + got.stop - 1][1], got, name))
        return out

    def named(self, k: int, before: list[str], behind: list[str]) -> str:
        """The license of template k between these words; nothing where they take it back."""
        if DENIALS & set(before):
            return ""
        name, text = self.names[k], " ".join(behind)
        if name.startswith(("GPL", "LGPL", "AGPL")) and text.startswith(LATER):
            name += "-or-later"
        return f"{name} with exception" if EXCEPTION.match(text) else name


def licenses_of(own: Templates, body: bytes) -> list[dict]:
    """Blocks of a lower-case text, in order. Of the confirmed blocks around a mark the one of the largest reduction counts, of equal ones that of the most words, then of the earlier template."""
    found: list[dict] = []
    free = 0
    for mark in _MARK.finditer(body):
        if mark.start() < free:
            continue
        if confirmed := own.around(body, mark, free):
            gain, _, start, free, got, name = min(confirmed, key=lambda x: (-x[0], -len(own.words[x[1]]), x[1]))
            found.append({"license": name, "start": start, "stop": free, "gain": gain, "missing": got.missing, "added": got.added})
    return found


def find_licenses(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and found, array of license, start and stop (bytes of the block), gain (bytes saved), missing and added (words).

    A block lies around one of MARKS, where the mark's place in a template says; blocks don't overlap. Case, punctuation and
    white space don't count. Up to one word in twelve may be missing or added, none of TELLING and none with a digit. A word of DENIALS among the four before a block takes it
    back; "or later" behind one of the GNU licenses, and "with ... exception", are told in its name.
    Very long texts are looked at around marks only. Null or empty texts have none; a null id stays null; repeated rows each give a row;
    an empty table gives none. Other columns aren't read.
    """
    fields = [("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("gain", pa.int32()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]
    out = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct(fields)))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates)
        for batch in slices(batches):
            found = [licenses_of(own, body.translate(LOWER)) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, out.field("found").type)], schema=out)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, found {FOUND}")


def op4_license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: how many notices, their licenses, the largest reduction, words missing and added, and the blocks as JSON.

    Odd rows are those of find_licenses: every row gives one, without notices 0 and empty texts.
    """
    found = find_licenses(docs)
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_blocks"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["gain"])), F.lit(0)).cast("long").alias("best_gain"),
        F.size(F.flatten(F.transform("found", lambda x: x["missing"]))).cast("long").alias("n_missing"),
        F.size(F.flatten(F.transform("found", lambda x: x["added"]))).cast("long").alias("n_added"),
        F.to_json("found").alias("blocks"),
    )
