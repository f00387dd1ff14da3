"""License scan by patience alignment of texts with license templates.

Words that are unique in both the text and the template are anchors; the longest
increasing subsequence of their places keeps those in the same order; the gaps between
them are aligned the same way. Where a gap has no anchor, equal words at its two ends are
matched. Coverage is the share of the template's words that found their place.

Coverage alone cannot tell licenses apart that differ in a word or a version. So templates have words that must
stand in the place found, and words of their kin that must not (``DECISIVE``).

A text is aligned in overlapping regions twice as long as the template, so every place where
the whole template fits lies in one region, however long the text is. A region is skipped
only where too few of the template's words occur in it for the coverage asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

#: Notices and texts of public licenses: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files, to deal in the Software without restriction.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
    " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
    " this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
    " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR"
    " IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain"
    " a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License"
    " is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
    " permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
    " Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
    " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
    " Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
    " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free"
    " Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT"
    " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT"
    " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT"
    " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce"
    " the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE"
    " IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce"
    " the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the"
    " name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written"
    " permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}
#: For each license of a kin: words that have to stand in the place found, and words of its kin that may not. Fixed values.
DECISIVE: dict[str, tuple[str, str]] = {
    "GPL-2.0": ("2", "lesser library affero"), "GPL-2.0-notice": ("2", "lesser library affero"),
    "GPL-3.0": ("3", "lesser library affero"), "GPL-notice": ("3", "lesser library affero"),
    "LGPL-2.1": ("lesser 2 1", ""), "LGPL-2.1-notice": ("lesser 2 1", ""),
    "LGPL-3.0": ("lesser 3", ""), "LGPL-3.0-notice": ("lesser 3", ""),
    "AGPL-3.0": ("affero 3", ""), "AGPL-3.0-notice": ("affero 3", ""),
    "CC-BY-4.0": ("cc by 4", "nc sa nd"), "CC-BY-SA-4.0": ("cc sa 4", "nc"), "CC-BY-ND-4.0": ("cc nd 4", "nc"),
    "CC-BY-NC-4.0": ("cc nc 4", "sa nd"), "CC-BY-NC-SA-4.0": ("cc nc sa 4", ""),
    "BSD-2-Clause": ("", "neither endorse"), "BSD-3-Clause": ("neither endorse", ""),
    "Apache-2.0": ("2", ""), "Apache-2.0-notice": ("2", ""), "MPL-2.0": ("2", ""),
}
WORD = re.compile(r"\w+")
MATCH = "struct<license:string,coverage:double,start:int,stop:int>"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first part, whose second parts rise too."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        ends[k : k + 1] = [y]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, rising in both."""
    matched, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 == a1 or b0 == b1:
            continue
        ours, theirs = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0)}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if ours[w] == 1 and theirs.get(w) == 1]
        if anchors:
            kept = increasing(anchors)
            matched += kept
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            work += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:])]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
    return sorted(matched)


class Template:
    def __init__(self, name: str, text: str, least: float, decisive: tuple[str, str] = ("", "")) -> None:
        self.name, self.least = name, least
        self.words = WORD.findall(text.lower())
        self.count = Counter(self.words)
        self.wanted, self.barred = (set(x.split()) for x in decisive)
        # without any of these words the coverage cannot be reached
        spare, self.needed = len(self.words) - self.must(), []
        for w in sorted(self.count, key=lambda w: (-len(w), w)):
            self.needed.append(w)
            spare -= self.count[w]
            if spare < 0:
                break

    def must(self) -> int:
        """Words of the template that have to match."""
        n = len(self.words)
        return next(i for i in range(n + 1) if i / n >= self.least)

    def find(self, words: list[str]) -> tuple[float, int, int] | None:
        """Best coverage and the words it spans, the earliest of equals."""
        m, best = len(self.words), None
        hits = [i for i, w in enumerate(words) if w in self.count]
        for start in sorted({s for i in hits for s in (i // m * m, i // m * m - m) if s >= 0}):
            region = words[start : start + 2 * m]
            here = Counter(w for w in region if w in self.count)
            if sum((here & self.count).values()) < self.must():
                continue
            # the template may come twice in a region: then no word is unique there, but it is in a half
            for lo, hi in ((0, 2 * m), *((s, s + m) for s in range(0, m + 1, max(1, m // 4)))):
                found = align(region[lo:hi], self.words)
                if found and len(found) >= self.must():
                    share, first, last = self._tight(words, start + lo + found[0][0], start + lo + found[-1][0], len(found))
                    here_too = set(words[first : last + 1])
                    if not self.wanted <= here_too or self.barred & here_too:
                        continue
                    if best is None or share > best[0]:
                        best = (share, first, last)
                    if share == 1.0:
                        break
        return best

    def _tight(self, words: list[str], first: int, last: int, matched: int) -> tuple[float, int, int]:
        """The coverage of a place once its surroundings are cut: words that also stand there are no anchors in a wide region."""
        m, best = len(self.words), (matched, first, last)
        for before in (0, m - matched, m // 4):
            for after in (0, m - matched, m // 4):
                lo = max(0, first - before)
                found = align(words[lo : last + 1 + after], self.words)
                if len(found) > best[0]:
                    best = (len(found), lo + found[0][0], lo + found[-1][0])
        return best[0] / m, best[1], best[2]


def scan_text(text: str, templates: list[Template], prefilter: bool = True) -> list[dict]:
    """Every template that the text covers, the best first, of equals the one with more words; spans are character offsets of the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter that lower-casing lengthens would shift the spans
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    open_ = [t for t in templates if not prefilter or any(w in low for w in t.needed)]
    if not open_:
        return []
    places = list(WORD.finditer(low))
    words, out = [m.group() for m in places], []
    for t in open_:
        if found := t.find(words):
            share, first, last = found
            out.append({"license": t.name, "coverage": share, "start": places[first].start(), "stop": places[last].end()})
    size = {t.name: len(t.words) for t in open_}
    return sorted(out, key=lambda x: (-x["coverage"], -size[x["license"]], x["start"], x["license"]))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = 0.8,
    decisive: dict[str, tuple[str, str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, license, coverage, start, stop, matches`` for every row of ``docs``.

    ``license`` is the template with the highest coverage of at least ``least``, of equals the one with more words, then the
    earlier, then the lower name; null with coverage 0 if there is none. ``matches`` holds all
    of them. ``decisive`` has, by template, words that have to stand in the place found and words that may not, each list
    space-joined; own templates have none by default. ``start`` and ``stop`` are character offsets. Null and empty texts match nothing, texts of
    any length are scanned whole. Rows with a null id and repeated rows are kept, other columns are not
    read. An empty table gives an empty table. One pass, no shuffle.
    """
    if templates is None:
        templates, decisive = TEMPLATES, DECISIVE if decisive is None else decisive
    chosen = [Template(n, t, least, (decisive or {}).get(n, ("", ""))) for n, t in sorted(templates.items())]
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [scan_text(t, chosen) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(fields))], names=["id", "matches"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, matches array<{MATCH}>")
    best = F.get("matches", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        best["start"].alias("start"),
        best["stop"].alias("stop"),
        "matches",
    )
