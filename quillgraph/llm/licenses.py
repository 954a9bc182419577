"""License scans by conditional compression.

Candidates are word windows as long as a template, at every offset of the text,
and runs of whole segments around words that notices use (see ``windows`` and
``blocks``). A window is left out only if it shares too few words with every
template of its length, counted with repeats, to be confirmed. Each candidate is
compressed with Zstandard twice: alone, and with each template as a raw
dictionary. The more a template's wording is the candidate's, the smaller the
second result. Templates are ranked by the share of the size that they save, and
confirmed, or not, by the exact differences between the words: at most
``TOLERANCE`` of them may differ, and none that tells licences apart. Of the
confirmed the one with the fewest differences names the candidate, then the one
that saves most. Of candidates that overlap, the one that its template explains
best stays.

Edge cases: null and empty texts have no findings; texts of any length are
looked at whole; each repeated row gives its own findings; ties between
templates go by name; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillgraph.llm.common import parts, projection

#: Notices as the licences' own texts word them, and one-line forms in common use.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the terms of the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-4-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Runs of segments start at one with such a word, or at the one before.
CUES = re.compile(r"licen[cs]|copyright|permission|redistribut|warrant|creative commons|\bcc[ -]?(?:by|0)\b|public domain|free software|\bgpl\b|source code form", re.I)
WORDS = re.compile(r"[^\W_]+", re.UNICODE)
SEGMENT = re.compile(r"[^\n]*?(?:[.!?:;](?=\s)|\n|$)", re.S)
#: Share of a template's words that may differ.
TOLERANCE = 0.15

#: Words that tell licences apart: where one of them differs, a template is not confirmed.
TELLING = frozenset(
    "affero lesser nc nd sa noncommercial noderivatives noderivs sharealike commercial derivatives derivs apache mit isc bsd mozilla mpl gpl lgpl agpl gnu cc cc0 by attribution neither endorse advertising".split()
)
NUMBER = re.compile(r"v?\d+")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


@cache
def _prepared() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(" ".join(words(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words(text), zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return out


@cache
def _alone() -> tuple[zstandard.ZstdCompressor, int]:
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
    return plain, len(plain.compress(b""))


def savings(block: list[str]) -> list[tuple[float, int]]:
    """(share of the size saved, template) for all templates, the largest first."""
    plain, frame = _alone()
    data = " ".join(block).encode()
    size = max(1, len(plain.compress(data)) - frame)
    return sorted(((1 - max(0, len(z.compress(data)) - frame) / size, k) for k, (_, _, z) in enumerate(_prepared())), key=lambda x: (-x[0], x[1]))


def differences(block: list[str], template: list[str]) -> list[tuple[str, str]]:
    """What the block has in place of the template's words, both as text."""
    found = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    return [(" ".join(template[a:b]), " ".join(block[c:d])) for op, a, b, c, d in found if op != "equal"]


def differing(pairs: list[tuple[str, str]]) -> int:
    return sum(max(len(a.split()), len(b.split())) for a, b in pairs)


def telling(pairs: list[tuple[str, str]], template: list[str]) -> bool:
    """Whether a difference is one between licences: a name, a condition or a version.

    Words that are only written apart are the same. Numbers that are added to a
    template without any are those of a list.
    """
    numbered = any(NUMBER.fullmatch(w) for w in template)
    for a, b in pairs:
        if a.replace(" ", "") == b.replace(" ", ""):
            continue
        both = {*a.split(), *b.split()}
        if both & TELLING or {a, b} == {"", "library"} or {a, b} <= {"library", "lesser", "affero"}:
            return True
        if numbered and any(NUMBER.fullmatch(w) for w in both):
            return True
    return False


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of segments: from a segment with a cue, or the one before it, as many as a template is long.

    A segment is a line, or a part of one up to a stop, that has words.
    """
    lengths = sorted({len(t) for _, t, _ in _prepared()})
    spots = [m.span() for m in SEGMENT.finditer(text) if WORDS.search(text, *m.span())]
    counts = None
    for k, (a, b) in enumerate(spots):
        if not CUES.search(text, a, b):
            continue
        counts = counts or [len(WORDS.findall(text, *s)) for s in spots]
        for first in (k - 1, k) if k else (k,):
            total = 0
            for last in range(first, len(spots)):
                total += counts[last]
                if total > (1 + TOLERANCE) * lengths[-1]:
                    break
                if last >= k and any((1 - TOLERANCE) * n <= total <= (1 + TOLERANCE) * n for n in lengths):
                    yield spots[first][0], spots[last][1]


@cache
def _vocabulary() -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the templates' words, and how often each (row) is in each template (column); the last row is for other words."""
    known = {w: k for k, w in enumerate(sorted({w for _, t, _ in _prepared() for w in t}))}
    often = np.zeros((len(known) + 1, len(_prepared())), np.int64)
    for k, (_, t, _) in enumerate(_prepared()):
        np.add.at(often[:, k], [known[w] for w in t], 1)
    return known, often


def least(template: list[str]) -> float:
    """Words that a candidate must share with a template to be confirmed."""
    return len(template) - TOLERANCE * len(template)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of word windows as long as a template that share enough words with it, at every offset."""
    known, often = _vocabulary()
    other = len(known)
    said = np.fromiter((known.get(w.lower(), other) for w in WORDS.findall(text)), np.int64)
    counts = np.bincount(said, minlength=other + 1)
    shared = np.minimum(counts[:, None], often).sum(axis=0)
    spots, found = None, set()
    for k, (_, template, _) in enumerate(_prepared()):
        n = len(template)
        if shared[k] < least(template) or n > len(said):
            continue  # not even the whole text has the words
        inside = np.concatenate([[0], np.cumsum(often[said, k] > 0)])
        for i in np.flatnonzero(inside[n:] - inside[:-n] >= least(template)).tolist():
            if np.minimum(np.bincount(said[i : i + n], minlength=other + 1), often[:, k]).sum() >= least(template):
                spots = spots or [m.span() for m in WORDS.finditer(text)]
                found.add((spots[i][0], spots[i + n - 1][1]))
    yield from sorted(found)


def confirmed(block: list[str]) -> tuple | None:
    """(differing, -saving, name, differences, template's length) of the best template for a candidate, if any."""
    known, often = _vocabulary()
    counts = np.bincount([known.get(w, len(known)) for w in block], minlength=len(known) + 1)
    shared = np.minimum(counts[:, None], often).sum(axis=0)
    tried = []
    for saving, k in savings(block):
        name, template, _ = _prepared()[k]
        if shared[k] < least(template):
            continue  # more words differ than may
        pairs = differences(block, template)
        n = differing(pairs)
        if n <= TOLERANCE * len(template) and not telling(pairs, template):
            tried.append((n, -saving, name, pairs, len(template)))
    return min(tried) if tried else None


def scan(text: str | None) -> list[dict]:
    """The licences that a text states, in order of place."""
    if not text:
        return []
    found = []
    whole = dict.fromkeys(blocks(text) if CUES.search(text) else ())
    for start, end in [*whole, *(w for w in windows(text) if w not in whole)]:
        best = confirmed(words(text[start:end]))
        if best:
            n, saving, name, pairs, size = best
            found.append({"start": start, "end": end, "license": name, "saving": -saving, "differing": n, "differences": pairs, "size": size, "inside": (start, end) not in whole})
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (f["differing"] - f["size"], f["inside"], f["end"] - f["start"], f["start"])):  # most words explained first, then whole segments, then the tightest
        if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["start"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per finding: doc_id, start, end (code points), license, saving, differing, exact, differences, block."""
    names = ["doc_id", "start", "end", "license", "saving", "differing", "exact", "differences", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in scan(t):
                    said = "; ".join(f"{a or '-'} > {b or '-'}" for a, b in f["differences"])
                    rows.append((i, f["start"], f["end"], f["license"], f["saving"], f["differing"], not f["differing"], said, t[f["start"] : f["end"]]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    base = projection(docs, {"doc_id": doc_id, "text": text}, {"doc_id": "long", "text": "string"})
    return base.mapInArrow(run, "doc_id long, start long, end long, license string, saving double, differing long, exact boolean, differences string, block string")
