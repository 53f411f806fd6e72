"""License scans by conditional compression.

For each template, the words around license words, as far as the template reaches, are compressed by zstandard alone and with
the template's wording as a raw dictionary. Templates that save bytes are ranked by how many, and in that order held against
the words one by one: where few words differ, and none that names another license, the stretch is compressed by itself, and
of stretches that share words the one that saves most is confirmed, with the lines of its own first and last word. Blocks of
lines with license words that no confirmed finding touches are given the template that saves most bytes.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wording of public license notices and grants.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}
# The wordings of related licenses differ from these in names, numbers or a clause.
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
for _from, _to, _old, _new in (
    ("GPL-3.0-or-later", "AGPL-3.0-or-later", "GNU General", "GNU Affero General"), ("GPL-3.0-notice", "AGPL-3.0-notice", "GNU General", "GNU Affero General"),
    ("GPL-3.0-notice", "LGPL-3.0-notice", "GNU General", "GNU Lesser General"), ("LGPL-3.0-notice", "LGPL-2.1-notice", "version 3", "version 2.1"),
    ("LGPL-3.0-or-later", "LGPL-2.1-or-later", "version 3", "version 2.1"), ("CC-BY-4.0", "CC-BY-ND-4.0", "BY", "BY-ND"), ("CC-BY-4.0", "CC-BY-NC-SA-4.0", "BY", "BY-NC-SA"),
    ("CC-BY-4.0", "CC-BY-NC-ND-4.0", "BY", "BY-NC-ND"),
):
    TEMPLATES[_to] = TEMPLATES[_from].replace(_old, _new)
TEMPLATES["EPL-2.0"] = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
# Identifiers of public licenses; a tag that names one is a wording of its own.
TAGGED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]
TEMPLATES |= {f"{k}-tag": f"SPDX-License-Identifier: {k}" for k in TAGGED}
#: Words that name or deny a license: a finding differs in none of them.
NAMING = {"affero", "lesser", "not", "never", "only", "later", "noncommercial", "sharealike", "noderivatives"}
#: Words before a wording that deny it.
DENIALS = {"not", "never", "isn", "aren", "wasn", "no"}
#: A line with one of these words may be part of a license.
CUES = r"(?i)licen[cs]e|copyright|warrant(?:y|ies)|redistribut|hereby[^0-9A-Za-z]+granted|public[^0-9A-Za-z]+domain|rights[^0-9A-Za-z]+reserved|free[^0-9A-Za-z]+software|permission"
#: Lines without a cue that a block may hold between two with one.
GAP = 3
#: Share of the template's words that may differ in a confirmed finding.
DIFFER = 0.1
LEVEL = 10
_WORD = re.compile(r"[0-9A-Za-z]+(?:[.\-][0-9A-Za-z]+)*")
_CUE = re.compile(CUES)


def _line_starts(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, wording) of the candidate blocks: runs of lines with cues, and each such line of longer runs."""
    lines = text.split("\n")
    starts = _line_starts(text)
    hits = sorted({bisect_right(starts, at) - 1 for m in _CUE.finditer(text) for at in (m.start(), m.end() - 1)})
    runs: list[list[int]] = []
    for i in hits:
        if runs and i - runs[-1][-1] <= GAP + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    found = []
    for run in runs:
        found.append((run[0], run[-1], " ".join(lines[run[0] : run[-1] + 1])))
        if len(run) > 1:
            found += [(i, i, lines[i]) for i in run]
    return found


def wording(text: str, template: str) -> tuple[list[str], list[str], int]:
    """Words that the text lacks and has too many between the template's first and last word in it, and the template's words."""
    a, b = _WORD.findall(template.lower()), _WORD.findall(text.lower())
    ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    same = [k for k, o in enumerate(ops) if o[0] == "equal"]
    lacks = [w for op, i, j, _, _ in ops if op != "equal" for w in a[i:j]]
    extra = [w for op, _, _, m, n in ops[same[0] : same[-1]] if op != "equal" for w in b[m:n]] if same else b
    return lacks, extra, len(a)


def _weight(word: str) -> float:
    """What a differing word costs: a number or a name more than any finding may."""
    return 1e9 if word in NAMING or any(c.isdigit() for c in word) else 1


def aligned(a: list[str], b: list[str], limit: float) -> list[tuple[float, int, int]]:
    """(words that differ, start, end) for each end in b of a stretch from which a differs in at most `limit` words, lacking or
    too many: the best stretch of that end, by dynamic programming over the cells within the limit."""
    n, price = len(a), [_weight(w) for w in a]
    cost, start = [0.0, *[1e18] * n], [0] * (n + 1)
    last = 0
    while last < n and cost[last] + price[last] <= limit:
        cost[last + 1] = cost[last] + price[last]
        last += 1
    found = []
    for j, w in enumerate(b):
        extra = _weight(w)
        diagonal, diagonal_start = 0.0, j
        above, above_start, now = 0.0, j + 1, 0
        start[0] = j + 1
        for i in range(1, n + 1):
            if i > last + 1 and above + price[i - 1] > limit:
                break
            old, old_start = cost[i], start[i]
            best, at = old + extra, old_start
            if a[i - 1] == w and diagonal <= best:
                best, at = diagonal, diagonal_start
            if above + price[i - 1] < best:
                best, at = above + price[i - 1], above_start
            cost[i], start[i] = best, at
            diagonal, diagonal_start, above, above_start = old, old_start, best, at
            if best <= limit:
                now = i
        last = now
        if cost[n] <= limit:
            found.append((cost[n], start[n], j + 1))
    return found


def differences(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """The words that b lacks and has too many, as few as possible."""
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    i = j = 0
    lacks, extra = [], []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and common[i + 1][j] >= common[i][j + 1]:
            lacks.append(a[i])
            i += 1
        else:
            extra.append(b[j])
            j += 1
    return lacks, extra


class Scanner:
    """The templates as dictionaries; remembers what it has said about a wording."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {k: _WORD.findall(v.lower()) for k, v in templates.items()}
        self.reach = {k: int(len(v) * (1 + DIFFER)) + 1 for k, v in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        made = {k: zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in templates.items()}
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for k, d in made.items()}
        self.known: dict[str, tuple] = {}

    def judge(self, text: str) -> tuple:
        """(license, bytes alone, bytes saved, False, words lacking, words too many): the first template in rank, for a block without a confirmed one."""
        if text in self.known:
            return self.known[text]
        raw = text.encode()
        alone = len(self.alone.compress(raw))
        saves = {k: alone - len(c.compress(raw)) for k, c in self.given.items()}
        best = min(saves, key=lambda k: (-saves[k], len(self.templates[k]), k))
        lacks, extra, _ = wording(text, self.templates[best])
        out = (best, alone, saves[best], False, " ".join(lacks), " ".join(extra))
        if len(self.known) > 10_000:
            self.known.clear()
        if len(text) < 2_000:
            self.known[text] = out
        return out

    def saving(self, k: str, raw: bytes, alone: int) -> int:
        return alone - len(self.given[k].compress(raw))

    def candidates(self, text: str, places: list[tuple[int, int]], begins: list[int]) -> list[tuple[int, str, int, int]]:
        """(bytes saved, template, first word, word after the last), those that save most first: what each template's words around
        license words save."""
        cues = sorted({(max(0, bisect_right(begins, m.start()) - 1), bisect_left(begins, m.end())) for m in _CUE.finditer(text)})
        found, sizes = [], {}
        for k, reach in self.reach.items():
            regions: list[list[int]] = []
            for a, b in cues:
                low, high = max(0, a - reach), min(len(places), b + reach)
                if regions and low <= regions[-1][1]:
                    regions[-1][1] = high
                else:
                    regions.append([low, high])
            for low, high in regions:
                raw = text[places[low][0] : places[high - 1][1]].encode() if low < high else b""
                if (low, high) not in sizes:
                    sizes[low, high] = len(self.alone.compress(raw))
                saved = self.saving(k, raw, sizes[low, high])
                if saved > 0:
                    found.append((saved, k, low, high))
        return sorted(found, key=lambda x: (-x[0], x[1:]))

    def denied(self, words: list[str], at: int) -> bool:
        """Whether the words before a place deny what follows."""
        return bool(DENIALS.intersection(words[max(0, at - 2) : at]))

    def confirmed(self, text: str) -> list[tuple]:
        """(first line, last line, license, bytes alone, bytes saved, True, words lacking, words too many) of all confirmed templates."""
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in places]
        begins, lines = [s for s, _ in places], _line_starts(text)
        found = []
        for _, k, low, high in self.candidates(text, places, begins):
            a, own = self.words[k], []
            for c, s, e in sorted((c, low + s, low + e) for c, s, e in aligned(a, words[low:high], DIFFER * len(a))):
                if e > s and not self.denied(words, s) and all(e <= x or s >= y for x, y in own):
                    own.append((s, e))
                    raw = text[places[s][0] : places[e - 1][1]].replace("\n", " ").encode()
                    alone = len(self.alone.compress(raw))
                    found.append((-self.saving(k, raw, alone), c - len(a), len(self.templates[k]), k, s, e, alone))
        out, taken = [], []
        for less, _, _, k, s, e, alone in sorted(found):  # of findings that overlap, the one that saves most
            if less >= 0 or (at := bisect_right(taken, (s, len(words)))) and taken[at - 1][1] > s or at < len(taken) and taken[at][0] < e:
                continue
            taken.insert(at, (s, e))
            lacks, extra = differences(self.words[k], words[s:e])
            first, last = (bisect_right(lines, begins[i]) - 1 for i in (s, e - 1))
            out.append((first, last, k, alone, -less, True, " ".join(lacks), " ".join(extra)))
        return sorted(out)

    def scan(self, text: str) -> list[tuple]:
        """Confirmed findings, and what the candidate blocks without one resemble most."""
        sure = self.confirmed(text)
        touched = {i for r in sure for i in range(r[0], r[1] + 1)}
        rest = [(first, last, *self.judge(block)) for first, last, block in blocks(text) if touched.isdisjoint(range(first, last + 1))]
        return sorted(sure + rest)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each confirmed finding and each candidate block that none touches: id, first_line, last_line, license, bytes_alone, bytes_saved, confirmed, lacks, extra.

    Whole texts are read; lines are numbered from 0. confirmed findings differ from the template in a tenth of its words at
    most, and in no number and no word that names or denies a license; each has the lines of its own words, of which no two findings share any. Texts without license words, empty and null ones give no rows. Repeated rows give repeated
    findings; of templates that match the same words the one that saves most bytes there counts, then the one with most of its wording, then the shorter; ids may be null; other columns are not read.
    """
    kinds = [("first_line", T.LongType()), ("last_line", T.LongType()), ("license", T.StringType()), ("bytes_alone", T.LongType()), ("bytes_saved", T.LongType()), ("confirmed", T.BooleanType()), ("lacks", T.StringType()), ("extra", T.StringType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *[T.StructField(k, t) for k, t in kinds]])
    wanted = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch["text"]):
                for row in scanner.scan(text.as_py()):
                    at.append(k)
                    rows.append(row)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), *columns], names=["id", *[k for k, _ in kinds]])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").rlike(CUES))
    return rows.mapInArrow(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).withColumnRenamed("id", "doc_id")
