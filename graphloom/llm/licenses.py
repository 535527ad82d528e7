"""Licence scans by conditional compression.

A candidate block is compressed plainly and with each licence's wording as a raw zstandard dictionary; the licences are
ranked by how many bytes their wording saves. All that save any are confirmed word by word: what differs is listed, and
a block whose wording differs too much isn't reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mapped, raw_texts

_MIT = """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""
_BSD_CLAUSES = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_ISC = """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""
_APACHE = """licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."""
_GPL = """this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with this program. if not, see http://www.gnu.org/licenses/."""
_GPL_2 = """this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with this program; if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa."""
_LGPL_2 = """this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version. this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu lesser general public license for more details. you should have received a copy of the gnu lesser general public license along with this library; if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa."""
_LGPL = _GPL.replace("gnu general", "gnu lesser general")
_AGPL = _GPL.replace("gnu general", "gnu affero general")
_MPL = """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/."""
#: Public licences: (id, wording); several wordings of one licence, and its
#: conditions without the disclaimer, are templates of their own.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "licensed under the apache license, version 2.0."),
    ("MIT", _MIT),
    ("MIT", "released under the mit license."),
    ("MIT", "licensed under the mit license."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "this work is licensed under the gnu general public license, version 3."),
    ("GPL-2.0", _GPL_2),
    ("GPL-2.0", "this work is licensed under the gnu general public license, version 2."),
    ("LGPL-2.1", _LGPL_2),
    ("LGPL-3.0", _LGPL),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license, version 3."),
    ("AGPL-3.0", _AGPL),
    ("AGPL-3.0", "this work is licensed under the gnu affero general public license, version 3."),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-2-Clause", _BSD_CLAUSES),
    ("BSD-2-Clause", "released under the bsd 2-clause license."),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} {_BSD_THIRD}"),
    ("BSD-3-Clause", "released under the bsd 3-clause license."),
    ("ISC", _ISC),
    ("ISC", _ISC.split(". ")[0]),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license."),
    ("CC-BY-4.0", "licensed under cc by 4.0."),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license."),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0."),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license."),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0."),
    ("CC0-1.0", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. cc0 1.0 universal."),
    ("Unlicense", "this is free and unencumbered software released into the public domain."),
]
_GNU = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
TEMPLATES += [(name, f"spdx-license-identifier: {name.lower()}{end}") for name in dict.fromkeys(name for name, _ in TEMPLATES) for end in (("", "-only", "-or-later") if name in _GNU else ("",))]
#: A line is a candidate if it holds one of these; a block runs on over lines of licence wording.
KEYWORDS = (b"licen", b"copyright", b"permission", b"redistribut", b"warrant", b"public domain", b"cc by", b"cc-by", b"spdx")
#: Words of a block, and of a template, that may differ; words that occur in no licence end a block if they exceed LOOSE of a line.
MOST_DIFFERENT, LOOSE = 0.25, 0.4
#: An SPDX line, whose expression may name several licences; what stands after WITH is an exception.
_spdx = regex.compile(r"(?i)spdx-license-identifier:[ \t]*((?:[\w.+()-]+[ \t]+(?:and|or|with)[ \t]+)*[\w.+()-]+)")
_words = regex.compile(r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*")


def wording(text: str) -> list[str]:
    """The words of a text, lower-cased, without marks."""
    return _words.findall(text.lower())


def _one_each(line: regex.Match) -> str:
    """An SPDX line as one line for each licence of its expression."""
    named = regex.sub(r"(?i)\s+with\s+\S+", "", line[1])
    return "\n".join(f"spdx-license-identifier: {x.strip('()')}" for x in regex.split(r"(?i)\s+(?:and|or)\s+", named))


class Scanner:
    """The templates as dictionaries, made once in each worker."""

    def __init__(self, templates: list[tuple[str, str]], level: int = 6):
        self.templates = [(name, wording(text)) for name, text in templates]
        self.counts = [Counter(ws) for _, ws in self.templates]
        self.vocabulary = {w for _, ws in self.templates for w in ws}
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.keyed = []
        for _, ws in self.templates:
            d = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.keyed.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False))
        self.known: dict[str, list[dict]] = {}

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Ranges of the candidate blocks: runs of lines in licence wording that hold a keyword."""
        start, end, keyed, at = -1, -1, False, 0
        for line in text.split("\n"):
            low = line.lower().encode()
            key = any(k in low for k in KEYWORDS)
            words = wording(line) if key or start >= 0 or len(line) < 400 else []
            own = key or (len(words) >= (1 if start >= 0 else 2) and sum(w not in self.vocabulary for w in words) <= LOOSE * len(words))
            if not own and start >= 0 and not line.strip():  # a licence goes on over blank lines
                pass
            elif own:
                start = at if start < 0 else start
                end, keyed = at + len(line), keyed or key
            elif start >= 0:
                if keyed:
                    yield start, end
                start, keyed = -1, False
            at += len(line) + 1
        if start >= 0 and keyed:
            yield start, end

    def ranked(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(bytes saved, negative length of the wording, template), most saved first."""
        block = " ".join(words).encode()
        size = len(self.plain.compress(block))
        return sorted(((size - len(c.compress(block)), -len(self.templates[i][1]), i) for i, c in enumerate(self.keyed)), reverse=True)

    def confirm(self, words: list[str], i: int) -> dict | None:
        """Where the template's wording stands in the block and how it differs, if it differs little."""
        own = self.templates[i][1]
        matcher = SequenceMatcher(None, own, words, autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        # single words of the template that stand far from the rest don't belong to its wording
        while len(same) > 1 and sum(m.size for m in same) < (1 - MOST_DIFFERENT) * (same[-1].b + same[-1].size - same[0].b):
            head, tail = same[1].b - same[0].b - same[0].size, same[-1].b - same[-2].b - same[-2].size
            same = same[1:] if same[0].size * tail < same[-1].size * head else same[:-1]
        matched = sum(m.size for m in same)
        if not same or matched < (1 - MOST_DIFFERENT) * len(own):
            return None
        first, last = same[0].b, same[-1].b + same[-1].size
        # words missing at an end of the template are set against as many of the block there
        a, b, differences = 0, max(0, first - same[0].a), []
        for m in [*same, None]:
            x, y = (m.a, m.b) if m else (len(own), min(len(words), last + len(own) - a))
            b = y if x == a and m in (same[0], None) else b
            if x > a or y > b:
                differences.append(f"{' '.join(own[a:x])} -> {' '.join(words[b:y])}")
            a, b = (m.a + m.size, m.b + m.size) if m else (a, b)
        return {"first": first, "last": last, "matched": matched, "wording": len(own), "differences": differences}

    def scan_block(self, block: str) -> list[dict]:
        """The confirmed licences of a block, each where its wording stands; wording once explained isn't used again."""
        if block in self.known:
            return self.known[block]
        found, left = [], wording(_spdx.sub(_one_each, block))
        while len(left) >= 2:  # an SPDX line has two words
            best, there = None, Counter(left)
            for saved, _, i in self.ranked(left):
                # a template with too few of its words in the block can't be confirmed
                if saved > 0 and (self.counts[i] & there).total() >= (1 - MOST_DIFFERENT) * len(self.templates[i][1]) and (c := self.confirm(left, i)):
                    c |= {"license": self.templates[i][0], "saved": saved}
                    # of those confirmed, the one whose matched words most exceed the different ones
                    rank = (c["wording"] + c["last"] - c["first"] - 3 * c["matched"], -c["matched"])
                    if best is None or rank < best[0]:
                        best = (rank, c)
            if best is None:
                break
            c = best[1]
            found.append(c)
            left = left[: c["first"]] + left[c["last"] :]
        if len(self.known) > 20_000:
            self.known.clear()
        self.known[block] = found
        return found

    def scan(self, raw: bytes) -> list[dict]:
        """Licences of a text, with the block's place."""
        low = raw.lower()
        if not any(k in low for k in KEYWORDS):
            return []
        text, out = raw.decode(), []
        for i, j in self.blocks(text):
            for c in self.scan_block(text[i:j]):
                out.append({"license": c["license"], "start": i, "end": j, "saved": c["saved"], "matched": c["matched"], "wording": c["wording"], "differences": c["differences"]})
        return out


_scanners: dict[int, Scanner] = {}
_ROW = "array<struct<license: string, start: long, end: long, saved: long, matched: long, wording: long, differences: array<string>>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and licenses found, in order: id, the block's range in the text, bytes saved, words matched and in
    the template, and each difference ("template -> text").

    Whole texts of any length; null or empty texts have none. Equal ranks go to the longer template, then the earlier one.
    Rows are independent: repeated rows and null ids give their own rows, an empty table none; no other column is read and
    nothing is shuffled.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "saved", "matched", "wording")], ("differences", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(chosen))
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(chosen))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scanner.scan(x) for x in raw_texts(b, "text")], kind)], names=[id_col, "licenses"])

    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, licenses {_ROW}")
