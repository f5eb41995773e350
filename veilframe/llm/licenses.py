"""Licence scans by sentence rules.

A text is cut into fragments at line ends and at sentence ends followed by white space.  Runs of
fragments whose words, ASCII letters and digits in lower case, form a known licence sentence become that
sentence's identifier, so a sentence wrapped over lines is found too; other fragments become 0.  Licence rules are ordered
identifier sequences: at each identifier the first rule that fits the following ones without
a gap wins, and the scan goes on behind it.

Sentences are found by a trie of their words, so a scan takes time in proportion to the text, whatever runs of
dots, dashes or blanks it holds; texts without the first two words of any sentence are not cut at all.

Edge cases: null and empty texts hold no licence; a text may hold several and the same one twice;
repeated rows are scanned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Known licence sentences by identifier, as published with the licences.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-grant": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-nc4-short": "Licensed under CC BY-NC 4.0.",
    "cc-by4-short": "Licensed under CC BY 4.0.",
    "cc-by-sa4-short": "Licensed under CC BY-SA 4.0.",
    "cc0-short": "Released under CC0 1.0.",
    "all-rights": "All rights reserved.",
}

#: Identifiers that a line ``SPDX-License-Identifier: ...`` may name.
SPDX = ("Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

#: Licence and its sentences in order; earlier rules win.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and", "isc-as-is")),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-https")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-short",)),
    ("CC-BY-4.0", ("cc-by4-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("LicenseRef-AllRightsReserved", ("all-rights",)),
    *((name, (f"spdx-{name}",)) for name in SPDX),
)

WORD = re.compile(r"[0-9A-Za-z]+")
#: Where a fragment ends: a line end, or a mark with white space behind it.
BORDER = re.compile(r"\n|[.:;!?](?=\s)")
MARKS = re.compile(r"[.:;!?]*")


class Scanner:
    """Finds known sentences and rules; sentences are paths of words in a trie, with their identifier at key None."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.trie: dict = {}
        pairs = set()
        for name, sentence in sentences.items():
            words = [w.lower() for w in WORD.findall(sentence)]
            node = self.trie
            for w in words:
                node = node.setdefault(w, {})
            node[None] = name
            pairs.add(" ".join(words[:2]))
        self.by_first: dict[str, list] = {}
        for rule in rules:
            self.by_first.setdefault(rule[1][0], []).append(rule)
        # a word has one end, so no text is passed over twice
        self.starts = re.compile("(?<![0-9a-z])(?:" + "|".join(p.replace(" ", "[^0-9a-z]++") for p in sorted(pairs)) + ")(?![0-9a-z])", re.IGNORECASE | re.ASCII)

    def identifiers(self, text: str) -> list[tuple[str | None, int, int]]:
        """(sentence or None, start, end) of runs of fragments, in order; unknown fragments are single."""
        spans = [m.span() for m in WORD.finditer(text)]
        if not spans:
            return []
        words = [text[a:b].lower() for a, b in spans]
        starts = np.array([a for a, _ in spans])
        borders = np.fromiter((m.start() for m in BORDER.finditer(text)), np.int64)
        # the first word of each fragment
        first = np.unique(np.concatenate([[0], np.searchsorted(starts, borders)]))
        first = first[first < len(spans)].tolist()
        limits = set(first) | {len(spans)}
        after = dict(zip(first, [*first[1:], len(spans)]))
        end = lambda j: MARKS.match(text, spans[j - 1][1]).end()
        out, i = [], 0
        while i < len(spans):
            node, best, j = self.trie, None, i
            while j < len(spans) and (node := node.get(words[j])) is not None:
                j += 1
                if None in node and j in limits:
                    best = (node[None], j)
            name, j = best or (None, after[i])
            out.append((name, spans[i][0], end(j)))
            i = j
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, int, list[str]]]:
        """(licence, start, end, sentences) of the rules that fit, in text order."""
        if not text or not self.starts.search(text):
            return []
        ids, out, i = self.identifiers(text), [], 0
        while i < len(ids):
            rule = next(((name, seq) for name, seq in self.by_first.get(ids[i][0], ()) if tuple(x[0] for x in ids[i : i + len(seq)]) == seq), None)
            if rule:
                last = i + len(rule[1]) - 1
                out.append((rule[0], ids[i][1], ids[last][2], list(rule[1])))
                i = last + 1
            else:
                i += 1
        return out


MATCHES = "array<struct<license:string,start:bigint,end:bigint,sentences:array<string>>>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: id, licenses (distinct names, sorted), matches (name, character span, sentence identifiers)."""
    own = docs.select(id_col, text_col)
    scanner = Scanner(sentences, rules)

    def scan(batches):
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))]))
        for batch in batches:
            found = [[{"license": n, "start": a, "end": b, "sentences": s} for n, a, b, s in scanner.scan(t.as_py())] for t in batch.column(1)]
            names = [sorted({m["license"] for m in ms}) for ms in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], names=[id_col, "licenses", "matches"])

    return own.mapInArrow(scan, f"`{id_col}` {dict(own.dtypes)[id_col]}, licenses array<string>, matches {MATCHES}")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
