"""Licence recognition by sentences and ordered rules.

A text is cut into sentences at full stops, question and exclamation marks before white space. As a
notice may follow a heading or stand between lines without stops, a sentence is also tried from each
of its line starts to its end, and line by line. Sentences are normalised (A-Z lower-cased, everything
but letters and digits is one blank, so comment signs and line breaks vanish) and looked up among the
known licence sentences. The identifiers found, in text order, are matched against the rules, in
their order: a rule is a sequence of identifiers; it takes the identifiers it matches away from later
rules. Identifiers that no rule takes are reported as ``unmatched``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier.
SENTENCES = {
    "apache2_notice": ["Licensed under the Apache License, Version 2.0.",
                       'Licensed under the Apache License, Version 2.0 (the "License");'
                       " you may not use this file except in compliance with the License."],
    "apache2_copy": ["You may obtain a copy of the License at"
                     " http://www.apache.org/licenses/LICENSE-2.0",
                     "You may obtain a copy of the License at"
                     " https://www.apache.org/licenses/LICENSE-2.0",
                     "You may obtain a copy of the License at"
                     " https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or"
                     " agreed to in writing, software distributed under the License is distributed on"
                     ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express'
                     " or implied.",
                     "You may obtain a copy of the License at"
                     " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or"
                     " agreed to in writing, software distributed under the License is distributed on"
                     ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express'
                     " or implied.",
                     "Unless required by applicable law or agreed to in writing, software distributed"
                     ' under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR'
                     " CONDITIONS OF ANY KIND, either express or implied."],
    "apache2_see": ["See the License for the specific language governing permissions and limitations"
                    " under the License."],
    "mit_ref": ["Released under the MIT License.", "Licensed under the MIT License.",
                "This project is licensed under the MIT License.",
                "SPDX-License-Identifier: MIT"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of"
                  ' this software and associated documentation files (the "Software"), to deal in the'
                  " Software without restriction, including without limitation the rights to use,"
                  " copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
                  " Software, and to permit persons to whom the Software is furnished to do so,"
                  " subject to the following conditions:"
                  " The above copyright notice and this permission notice shall be included in all"
                  " copies or substantial portions of the Software."],
    "as_is_mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
                  " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
                  " PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "liability_mit": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
                      " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
                      " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE"
                      " OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose"
                  " with or without fee is hereby granted, provided that the above copyright notice"
                  " and this permission notice appear in all copies."],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification,"
                  " are permitted provided that the following conditions are met: 1.",
                  "Redistribution and use in source and binary forms, with or without modification,"
                  " are permitted provided that the following conditions are met:"],
    "bsd_grant_source": ["Redistribution and use in source and binary forms, with or without"
                         " modification, are permitted provided that the following conditions are met:"
                         " Redistributions of source code must retain the above copyright notice, this"
                         " list of conditions and the following disclaimer."],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list"
                   " of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this"
                   " list of conditions and the following disclaimer in the documentation and/or"
                   " other materials provided with the distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be"
                    " used to endorse or promote products derived from this software without specific"
                    " prior written permission."],
    "gpl2_ref": ["This work is licensed under the GNU General Public License, version 2.",
                 "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl3_ref": ["This work is licensed under the GNU General Public License, version 3.",
                 "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the"
                 " terms of the GNU General Public License as published by the Free Software"
                 " Foundation, either version 3 of the License, or (at your option) any later"
                 " version."],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the"
                  " terms of the GNU General Public License as published by the Free Software"
                  " Foundation; either version 2 of the License, or (at your option) any later"
                  " version."],
    "gpl2_only": ["This program is free software; you can redistribute it and/or modify it under the"
                  " terms of the GNU General Public License version 2 as published by the Free Software"
                  " Foundation."],
    "lgpl21_free": ["This library is free software; you can redistribute it and/or modify it under the"
                    " terms of the GNU Lesser General Public License as published by the Free Software"
                    " Foundation; either version 2.1 of the License, or (at your option) any later"
                    " version."],
    "lgpl3_free": [f"This {work} is free software: you can redistribute it and/or modify it under the"
                   " terms of the GNU Lesser General Public License as published by the Free Software"
                   " Foundation, either version 3 of the License, or (at your option) any later"
                   " version." for work in ("program", "library")],
    "agpl3_free": ["This program is free software: you can redistribute it and/or modify it under the"
                   " terms of the GNU Affero General Public License as published by the Free Software"
                   " Foundation, either version 3 of the License, or (at your option) any later"
                   " version."],
    "lgpl_hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY"
                  " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
                  " PARTICULAR PURPOSE."],
    "lgpl_details": ["See the GNU Lesser General Public License for more details."],
    "agpl_details": ["See the GNU Affero General Public License for more details."],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY"
                 " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
                 " PARTICULAR PURPOSE."],
    "gpl_details": ["See the GNU General Public License for more details."],
    "gpl_received": ["You should have received a copy of the GNU General Public License along with"
                     " this program."],
    "mpl2_notice": ["This Source Code Form is subject to the terms of the Mozilla Public License,"
                    " v."],
    "mpl2_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"
                  " http://mozilla.org/MPL/2.0/.",
                  "If a copy of the MPL was not distributed with this file, You can obtain one at"
                  " https://mozilla.org/MPL/2.0/."],
    "epl2_notice": ["This program and the accompanying materials are made available under the terms of"
                    f" the Eclipse Public License 2.0 which is available at {scheme}://www.eclipse.org/"
                    "legal/epl-2.0/" for scheme in ("http", "https")],
    "cc0_ref": ["To the extent possible under law, the author(s) have dedicated all copyright and"
                " related and neighboring rights to this software to the public domain worldwide."],
    "unlicense_free": ["This is free and unencumbered software released into the public domain."],
    "unlicense_anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
                         " this software, either in source code form or as a compiled binary, for any"
                         " purpose, commercial or non-commercial, and by any means."],
    "cc_by_nc4_ref": ["Licensed under CC BY-NC 4.0."],
    "cc_by4_ref": ["Licensed under CC BY 4.0.",
                   "This work is licensed under a Creative Commons Attribution 4.0 International"
                   " License."],
}

# Licence rules in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["apache2_notice", "apache2_copy", "apache2_see"]),
    ("MIT", ["mit_grant", "as_is_mit", "liability_mit"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_grant_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd_grant_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details", "gpl_received"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_details"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-2.0-only", ["gpl2_only", "gpl_hope", "gpl_details"]),
    ("GPL-2.0-only", ["gpl2_only"]),
    ("LGPL-2.1-or-later", ["lgpl21_free", "lgpl_hope", "lgpl_details"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "gpl_hope", "lgpl_details"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope", "lgpl_details"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl3_free", "gpl_hope", "agpl_details"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("MPL-2.0", ["mpl2_notice", "mpl2_copy"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("CC0-1.0", ["cc0_ref"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("Unlicense", ["unlicense_free"]),
    ("ISC", ["isc_grant"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("MIT", ["mit_ref"]),
    ("GPL-2.0-only", ["gpl2_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4_ref"]),
    ("CC-BY-4.0", ["cc_by4_ref"]),
]

# Further licences known by their tag line.
TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
        "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-or-later",
        "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {f"tag_{tag}": [f"SPDX-License-Identifier: {tag}"] for tag in TAGS}
RULES += [(tag, [f"tag_{tag}"]) for tag in TAGS]

_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[\W_]*([^\W_]+)")
_END = re.compile(r"(?<=[.!?])\s+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.translate(_LOWER)).strip()


class Recogniser:
    """Known sentences by their normalised form, and the rules over their identifiers."""

    def __init__(self, sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]]):
        self.known = {normalise(form): name for name, forms in sentences.items() for form in forms}
        self.first = {k.split(" ", 1)[0] for k in self.known}
        self.longest = max(map(len, self.known))
        self.rules = rules

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """``(begin, end, identifier)`` of the known sentences, in order, not overlapping; of those
        that begin at one place the longest counts."""
        cuts = [m.end() for m in _END.finditer(text)]
        ends = [*cuts, len(text)]
        out, after = [], 0
        for a, b in zip([0, *cuts], ends):
            line = a
            while line < b:
                stop = text.find("\n", line, b)
                stop = b if stop < 0 else stop
                if line >= after and self._may_begin(text, line, stop):
                    for end in (b, stop):  # to the sentence's end, or this line alone
                        name = self._look_up(text, line, end)
                        if name is not None:
                            out.append((line, end, name))
                            after = end
                            break
                line = stop + 1
        return out

    def _may_begin(self, text: str, line: int, stop: int) -> bool:
        word = _WORD.match(text, line, stop)
        return word is not None and word[1].translate(_LOWER) in self.first

    def _look_up(self, text: str, begin: int, end: int) -> str | None:
        """The identifier of a stretch; normalises no more than is needed to see it is too long."""
        size = 2 * self.longest
        while True:
            found = normalise(text[begin:min(end, begin + size)])
            if begin + size >= end:
                return self.known.get(found)
            if len(found) > self.longest + 1:
                return None
            size *= 2

    def match(self, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int, list[str]]]:
        """``(licence, begin, end, identifiers)`` by the rules, then what is unmatched."""
        left = list(found)
        out = []
        for licence, wanted in self.rules:
            i = 0
            while i + len(wanted) <= len(left):
                part = left[i:i + len(wanted)]
                if [p[2] for p in part] == wanted:
                    out.append((licence, part[0][0], part[-1][1], wanted))
                    del left[i:i + len(wanted)]
                else:
                    i += 1
        out += [("unmatched", a, b, [name]) for a, b, name in left]
        return sorted(out, key=lambda r: (r[1], r[2]))


def find_licenses(docs: DataFrame, sentences: dict[str, list[str]] | None = None,
                  rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per licence found in a row of ``docs(doc_id, text)``: ``doc_id, license, ordinal,
    begin, end, identifiers``.

    ``begin`` and ``end`` are code point positions of the first and behind the last sentence;
    ``ordinal`` counts a text's licences in order. Repeated rows have rows each, null ids stay null;
    null and empty texts, and texts without known sentences, have none. Other columns are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "license", "ordinal", "begin", "end", "identifiers"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(),
                 pa.list_(pa.string())]
        recogniser = Recogniser(sentences, rules)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for k, (licence, a, b, ids) in enumerate(
                        recogniser.match(recogniser.sentences(text))):
                    rows.append((batch.column(0)[i].as_py(), licence, k, a, b, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names=names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license string, ordinal int, begin long, end long,"
             " identifiers array<string>")
