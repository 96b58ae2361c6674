"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts become words (letters and digits of ASCII in lower case, other bytes as they
are). Hashes of GRAM successive words are winnowed: of every WINDOW neighbours the least is kept,
so a shared run of WINDOW + GRAM - 1 words shares a fingerprint. The inverted index from
fingerprint to template and place has the size of the templates. Hits of a template whose
diagonals (place in the text less place in the template) lie within a band are one candidate; its
words are aligned within the band, and each disjoint alignment (a notice may stand there many times)
is reported with the share of the template's words that matched and the span of the first to the last
match.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import table
from tidewatch.session import ship

GRAM, WINDOW, BAND = 3, 2, 8
COVERAGE = 0.7
LEAST_WORDS = 4
# Notices and texts of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-title": "The MIT License (MIT)",
    "MIT-heading": "MIT License Copyright (c)",
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Identifiers of public licenses as they stand in source files.
IDENTIFIERS = (
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-1.1", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
CC_KINDS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_LICENSES = ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd"))
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU = {"GPL": "", "LGPL": "Lesser ", "AGPL": "Affero "}
GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
#: Ways to write a word of a kind in two words.
SPLIT = {b"noncommercial": (b"non", b"commercial"), b"sharealike": (b"share", b"alike"), b"noderivatives": (b"no", b"derivatives"), b"noderivs": (b"no", b"derivs")}
#: The words that mean the same kind.
SAME = {b"noncommercial": b"nc", b"sharealike": b"sa", b"noderivatives": b"nd", b"noderivs": b"nd"}
KINDS = {"CC": ("nc", "sa", "nd"), "GNU": ("lesser", "affero"), "BSD": ("2", "3", "4", "neither"), "": ()}


def _family(name: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """Of a template's name: its family, the kinds of that family it has, and the numbers of its version."""
    parts = name.removeprefix("SPDX-").split("-")
    version = tuple(next((p for p in parts if p[0].isdigit() and "." in p), "").split(".")) if any("." in p for p in parts) else ()
    if parts[0] == "CC":
        return "CC", tuple(p.lower() for p in parts if p.lower() in CC_KINDS), version
    if parts[0] in GNU and not name.startswith("SPDX"):
        return "GNU", tuple(GNU[parts[0]].lower().split()), version[: 1 if version[1:] == ("0",) else 2]
    if parts[0] == "BSD" and len(parts) > 2 and not name.startswith("SPDX"):
        return "BSD", ("neither",) if name == "BSD-3-Clause" else () if name == "BSD-2-Clause" else (parts[1],), ()
    return "", (), version


def _templates(fixed: dict[str, str]) -> dict[str, str]:
    """The fixed texts, and the notices of all members and versions of the families that differ in a few words alone."""
    out = dict(fixed)
    for version, port in CC_VERSIONS.items():
        for kinds in CC_LICENSES:
            name = "-".join(["CC-BY", *(k.upper() for k in kinds), version])
            out[f"{name}-notice"] = f"CC BY{''.join('-' + k.upper() for k in kinds)} {version}"
            out[f"{name}-long"] = f"This work is licensed under a Creative Commons {'-'.join(['Attribution', *(CC_KINDS[k] for k in kinds)])} {version} {port} License."
    for kind, word in GNU.items():
        for version in GNU_VERSIONS[kind]:
            full = version if "." in version else f"{version}.0"
            out[f"{kind}-{full}-notice"] = f"This work is licensed under the GNU {word}General Public License, version {version}."
    for version in ("1.1", "2.0"):
        out[f"Apache-{version}-notice"] = f"Licensed under the Apache License, Version {version}."
        out[f"MPL-{version}-short"] = f"Licensed under the Mozilla Public License, version {version}."
    return out | {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}


def _kind_words(words: list[bytes]) -> list[bytes]:
    """words with the ways to write a kind made one."""
    out, i = [], 0
    while i < len(words):
        whole = next((k for k, two in SPLIT.items() if tuple(words[i : i + 2]) == two), None)
        out.append(SAME.get(whole or words[i], whole or words[i]))
        i += 2 if whole else 1
    return out


def _holds(words: list[bytes], run: tuple[bytes, ...]) -> bool:
    """Whether the words of run stand there side by side."""
    return not run or any(tuple(words[i : i + len(run)]) == run for i in range(len(words) - len(run) + 1))


class Required:
    """What a span must hold to have a template's name: the kinds of its family that the name has and none of the
    others, and the numbers of its version side by side; of an identifier, all its words side by side."""

    def __init__(self, name: str, template: bytes):
        family, kinds, version = _family(name)
        self.kinds = {k.encode() for k in kinds}
        self.others = {k.encode() for k in KINDS[family]} - self.kinds
        if name in ("BSD-2-Clause", "BSD-3-Clause"):
            self.others &= {b"neither"}
        self.run = tuple(n.encode() for n in version)
        if name.startswith("SPDX-"):
            self.run = tuple(template.translate(FOLD).split())[2:]
        self.word = next((w.encode() for w in ("mit", "isc", "unlicense") if name.lower().startswith(w) and w.encode() in template.lower().translate(FOLD).split()), None)

    def met(self, words: list[bytes]) -> bool:
        own = _kind_words(words)
        held = set(own)
        return self.kinds <= held and not self.others & held and _holds(own, self.run) and (self.word is None or self.word in held)


FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
TEMPLATES = _templates(TEMPLATES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each GRAM words, the largest value where one is unknown (0)."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for g in range(GRAM):
        part = ids[g : g + n]
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        known &= part > 0
    return np.where(known, out >> np.uint64(1), np.uint64((1 << 64) - 1))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the least of every WINDOW hashes, the last of equal ones."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """Template words, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.required = [Required(name, text.encode()) for name, text in templates.items()]
        split = [t.encode().translate(FOLD).split() for t in templates.values()]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words), 1)}
        self.words = [np.array([self.ids[w] for w in words], np.int32) for words in split]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            hashes = gram_hashes(words)
            for at in winnowed(hashes):
                self.postings[int(hashes[at])].append((t, int(at)))
        self.known = np.array(sorted(self.postings), np.uint64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least and largest diagonal) of hits that lie within a band."""
        hashes = gram_hashes(ids)
        places = winnowed(hashes)
        places = places[np.isin(hashes[places], self.known)] if len(places) else places
        diagonals = defaultdict(set)
        for p in places.tolist():
            for t, at in self.postings[int(hashes[p])]:
                diagonals[t].add(p - at)
        out = []
        for t, own in diagonals.items():
            run = sorted(own)
            start = 0
            for i in range(1, len(run) + 1):
                if i == len(run) or run[i] - run[i - 1] > BAND:
                    out.append((t, run[start], run[i - 1]))
                    start = i
        return out


class Spans:
    """Disjoint spans of places, ends inclusive, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether start to end met no earlier span; only then it is kept."""
        i = bisect_left(self.starts, start)
        if (i < len(self.starts) and self.starts[i] <= end) or (i and self.ends[i - 1] >= start):
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def aligned(template: np.ndarray, text: np.ndarray, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """(matched words, first and last matched place) of disjoint banded alignments, best first, that
    match least words or more.

    Row i of the band holds text places i + low - BAND to i + high + BAND. A match scores 2, a
    mismatch, insertion or deletion -1; an alignment may begin and end anywhere in the text. One pass
    gives the best alignment up to each place; what lies between accepted ones is aligned again.
    """
    if len(text) < least:
        return []
    low, high = (min(max(d, -len(template)), len(text)) for d in (low, high))
    width, shift = high - low + 2 * BAND + 1, low - BAND
    before, words = [(0, 0, -1, -1)] * width, text.tolist()
    ends: dict[int, tuple[int, int, int, int, int]] = {}
    for i, word in enumerate(template.tolist()):
        row: list[tuple[int, int, int, int]] = []
        for b in range(width):
            j = i + shift + b
            cell = (0, 0, -1, -1)
            if 0 <= j < len(words):
                s, m, first, last = before[b]
                hit = words[j] == word
                cell = (s + 2, m + 1, j if first < 0 else first, j) if hit else (s - 1, m, first, last)
            if b + 1 < width and before[b + 1][0] - 1 > cell[0]:
                s, m, first, last = before[b + 1]
                cell = (s - 1, m, first, last)
            if b and row[b - 1][0] - 1 > cell[0]:
                s, m, first, last = row[b - 1]
                cell = (s - 1, m, first, last)
            if cell[0] < 0:
                cell = (0, 0, -1, -1)
            row.append(cell)
            if cell[1] >= least and cell[3] == j:
                end = (-cell[0], i, j, cell[1], cell[2])
                if j not in ends or end < ends[j]:
                    ends[j] = end
        before = row
    taken = Spans()
    out = [(m, first, last) for _, _, last, m, first in sorted(ends.values()) if taken.add(first, last)]
    if out:
        for a, b in zip([0, *(e + 1 for e in taken.ends)], [*taken.starts, len(words)], strict=True):
            out += [(m, first + a, last + a) for m, first, last in aligned(template, text[a:b], low - a, high - a, least)]
    return out


def found(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) of a whole text, in code points, end exclusive.

    Where reports overlap, the one with more matched words stays, then the one that covers more.
    """
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(FOLD).split()
    get = index.ids.get
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    hits = []
    for t, low, high in index.candidates(ids):
        template = index.words[t]
        first = max(0, low - BAND)
        part = ids[first : high + len(template) + BAND + 1]
        least = max(LEAST_WORDS, math.ceil(coverage * len(template)))
        for matched, a, b in aligned(template, part, low - first, high - first, least):
            if not index.required[t].met(words[a + first : b + first + 3]):  # a version may end it
                continue
            hits.append((matched, matched / len(template), t, a + first, b + first))
    if not hits:
        return []
    starts = _starts(data, words)
    taken = Spans()
    out = [h for h in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[3])) if taken.add(h[3], h[4])]
    spans, at, n = [], 0, 0
    for matched, share, t, a, b in sorted(out, key=lambda o: o[3]):
        chars = []
        for place in (starts[a], starts[b] + len(words[b])):
            n += len(data[at:place].decode("utf-8", "surrogatepass"))
            at = place
            chars.append(n)
        spans.append((index.names[t], share, matched, *chars))
    return spans


def _starts(data: bytes, words: list[bytes]) -> list[int]:
    folded, out, at = data.translate(FOLD), [], 0
    for w in words:
        at = folded.index(w, at)
        out.append(at)
        at += len(w)
    return out


ROWS = "doc_id long, license string, coverage double, matched_words int, start int, end int"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per license found in a document (ROWS); documents without any have none.

    Null and empty texts have none; texts are read whole, however long; a repeated row gives its
    rows again; other columns are not read; an empty table gives no rows. Of templates that match
    equally well at a place, the first stays.
    """
    ship(docs.sparkSession)
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in found(text.as_py() or "", index, coverage)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, ROWS)


def op9_license_alignment(spark, sf_dir: str) -> DataFrame:
    """The licenses found in every whole document, with coverage and span; see scan()."""
    return scan(table(spark, sf_dir, "documents"))
