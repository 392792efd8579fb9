"""License scans: canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings and white space no longer matter), its SHA-256 is taken and hash-joined to the
digests of known licence texts. Entire licence texts are compared, never parts of them: the
whole document, and each stretch of it that begins as a known text does and has its length,
so that notices and licences inside other text are found however they are wrapped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_ids, table, tidy, with_ids

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TAIL = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]


def _bsd(clauses: int, numbered: bool) -> str:
    return _BSD_HEAD + " ".join(f"{i + 1}. {c}" if numbered else c for i, c in enumerate(_BSD_CLAUSES[:clauses])) + _BSD_TAIL


def _free(program: str, of: str, version: str, later: str = " (at your option) any later version.") -> str:
    """The notice that the GNU licences ask for at the head of a file."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {of} as published by the Free Software Foundation, "
        f"either version {version} of the License, or{later} {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {of} for more details."
    )


# Licence notices and short licences as their publishers word them.
LICENSES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _free("This program", "General Public License", "2")),
    ("GPL-3.0", _free("This program", "General Public License", "3")),
    ("AGPL-3.0", _free("This program", "Affero General Public License", "3")),
    ("LGPL-2.1", _free("This library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _free("This library", "Lesser General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _bsd(2, True)),
    ("BSD-2-Clause", _bsd(2, False)),
    ("BSD-3-Clause", _bsd(3, True)),
    ("BSD-3-Clause", _bsd(3, False)),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and "
        "this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
        "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        "generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# Longer licences, by (licence, words that the canonical text begins with, its bytes, its SHA-256).
DIGESTS: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "apache license version", 9821, "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", "apache license version", 8777, "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"),
    ("Apache-2.0", "apache license version", 8805, "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Artistic-1.0", "the artistic license", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "creative commons legal", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "gnu free documentation", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "gnu general public", 11766, "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "gnu general public", 9388, "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "gnu general public", 9416, "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "gnu general public", 17118, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "gnu general public", 14456, "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0", "gnu general public", 14484, "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "gnu general public", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "gnu general public", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "gnu general public", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "gnu library general", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "gnu library general", 22249, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "gnu library general", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "gnu lesser general", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "gnu lesser general", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "gnu lesser general", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "gnu lesser general", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license", 22339, "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "mozilla public license", 14271, "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("BSD-3-Clause", "redistribution and use", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
]

# Spellings that licence texts use for the same words.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"),
    ("sharealike", "share alike"),
    ("merchantibility", "merchantability"),
    ("fulfil", "fulfill"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https", "http"),
]

#: A line that only claims copyright says nothing of the licence.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
#: Everything but ASCII letters, digits and what isn't ASCII.
NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Words that a text begins with, by which stretches are found.
ANCHOR = 3
_LINE = re.compile(COPYRIGHT_LINE.encode())
_SPACED = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))
_SPELLED = {a.encode(): b.encode().split() for a, b in SPELLINGS}


def canonical(text: str | None) -> bytes:
    """Lower case, without copyright lines, one spelling, words joined by one space; null: empty."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    if b"\r" in low:
        low = low.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if b"copyright" in low or b"(c)" in low or b"\xc2\xa9" in low or b"all rights" in low:
        low = _LINE.sub(b" ", low)
    words = low.translate(_SPACED).split(b" ")
    if not _SPELLED.keys().isdisjoint(words):
        words = [x for w in words for x in _SPELLED.get(w, (w,))]
    return b" ".join(filter(None, words))


def catalogue(licenses: list[tuple[str, str]] | None = None, digests: list[tuple[str, str, int, str]] | None = None) -> list[tuple[str, str, int, str]]:
    """(licence, first words, bytes, digest) of each known text; of equal texts the licence first in order. Empty texts are none."""
    out: dict[str, tuple[str, str, int, str]] = {}
    for name, body in LICENSES if licenses is None else licenses:
        c = canonical(body)
        if c:
            row = (name, b" ".join(c.split(b" ")[:ANCHOR]).decode(), len(c), hashlib.sha256(c).hexdigest())
            out[row[3]] = min(row, out.get(row[3], row))
    for row in DIGESTS if digests is None else digests:
        out[row[3]] = min(row, out.get(row[3], row))
    return sorted(out.values())


def stretches(text: bytes, known: dict[bytes, list[tuple[int, str, str]]]) -> list[str]:
    """The licence of each stretch of a canonical text whose digest is known. known: first words -> (bytes, digest, licence)."""
    found, padded = [], b" " + text + b" "
    for anchor, rows in known.items():
        at = padded.find(anchor)
        while at >= 0:
            for size, digest, name in rows:
                end = at + 1 + size
                if end < len(padded) and padded[end] == 32 and hashlib.sha256(padded[at + 1 : end]).hexdigest() == digest:
                    found.append(name)
            at = padded.find(anchor, at + 1)
    return found


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, digests: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """For each row: doc_id, digest of its whole text, whole_license, licenses (sorted, distinct), n_license_spans.

    licenses: known texts (licence, text); digests: known texts by digest alone; None: the
    lists of this module. n_license_spans: stretches of the text that are a known text, one
    for each text and place, the whole text included. Null and empty texts have the digest of
    "" and no licence. Rows that repeat are scanned each for itself; a text of any length
    stays in its row and nothing is shuffled. An empty table gives no rows. Other columns are
    not read. The catalogue is broadcast: it has as many rows as it has texts.
    """
    rows = catalogue(licenses, digests)
    known: dict[bytes, list[tuple[int, str, str]]] = {}
    for name, anchor, size, digest in rows:
        known.setdefault(b" " + anchor.encode() + b" ", []).append((size, digest, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf.text:
                c = canonical(text)
                hits = stretches(c, known)
                out.append((hashlib.sha256(c).hexdigest(), ",".join(sorted(set(hits))), len(hits)))
            yield pd.DataFrame(out, columns=["digest", "licenses", "n_license_spans"]).assign(doc_id=pdf.doc_id.to_numpy())

    found = with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, digest string, licenses string, n_license_spans long")
    whole = docs.sparkSession.createDataFrame([(d, name) for name, _, _, d in rows], "digest string, whole_license string")
    return null_ids(found.join(F.broadcast(whole), "digest", "left").select("doc_id", "digest", "whole_license", "licenses", "n_license_spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _framed(text: str) -> str:
    """SQL of a canonical text whose words stand in < >, so that no two share a separator."""
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = rf"regexp_replace({out}, '\r\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"'<' || replace(trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g')), ' ', '><') || '>'"
    for other, one in SPELLINGS:
        out = f"replace({out}, '<{other}>', '<{one.replace(' ', '><')}>')"
    return out


def oracle() -> str:
    rows = ", ".join(f"('{name}', '<{anchor.replace(' ', '><')}>', {size}, '{digest}')" for name, anchor, size, digest in catalogue())
    plain = "replace(substr({0}, 2, length({0}) - 2), '><', ' ')"
    return rf"""
WITH known(license, anchor, size, digest) AS (VALUES {rows}),
framed AS (SELECT doc_id, row_number() OVER () AS r, {_framed('text')} AS f FROM documents),
whole AS (SELECT doc_id, r, f, sha256({plain.format('f')}) AS digest FROM framed),
parts AS (SELECT w.r, k.license, k.anchor, k.size, k.digest, string_split(replace(w.f, k.anchor, chr(1)), chr(1)) AS p FROM whole w JOIN known k ON contains(w.f, k.anchor)),
tails AS (SELECT r, license, digest, size, {plain.format('t')} AS t FROM (SELECT *, unnest(list_transform(range(2, len(p) + 1), lambda i: replace(chr(1) || array_to_string(p[i:], chr(1)), chr(1), anchor))) AS t FROM parts) x),
hits AS (SELECT r, list(license) AS found, count(*) AS n FROM tails WHERE sha256(left(t, size)) = digest AND (length(t) = size OR substr(t, size + 1, 1) = ' ') GROUP BY r)
SELECT w.doc_id, w.digest, k.license AS whole_license, coalesce(array_to_string(list_sort(list_distinct(h.found)), ','), '') AS licenses, coalesce(h.n, 0)::BIGINT AS n_license_spans
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN hits h ON h.r = w.r"""
