"""License scan: blocks that mention terms of use, compressed with each template as dictionary, then confirmed word by word."""

from __future__ import annotations

import bisect
import difflib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Notices as they are written out in works under each license; <...> stands for any words.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}

#: What a block must mention to be compared at all.
CUES = re.compile(r"licen[sc]|copyright|\ball rights reserved\b|redistribut|permission is|warrant|creative commons|\bcc[ -](?:by|0)|public domain|spdx|general public", re.I)
_PARTS = ("licen", "copyright", "all rights reserved", "redistribut", "permission is", "warrant", "creative commons", "cc by", "cc-by", "cc 0", "cc-0", "public domain", "spdx", "general public")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
LEAST_WORDS = 0.9  # of a template that a block holds in order


@dataclass(frozen=True)
class Found:
    license: str
    start: int
    end: int
    reduction: float
    matched: float
    missing: tuple[str, ...]
    exact: bool


class Scanner:
    """Compressors for the templates; one per worker."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.entries = []
        for name, notices in templates.items():
            for notice in notices:
                words = tuple(w.lower() for w in _WORD.findall(notice))
                raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.entries.append((name, words, frozenset(words), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False)))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.width = max((_width(own) for _, own, _, _ in self.entries), default=0)
        self.known: dict[str, list[tuple]] = {}

    def block(self, text: str) -> list[tuple]:
        """Licenses of one block: (name, first and last character, reduction, matched share, missing words, exact), by their place."""
        if text in self.known:
            return self.known[text]
        spans = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [w for w, _, _ in spans]
        data = " ".join(words).encode()
        size = max(1, len(self.plain.compress(data)))
        present = set(words)
        ranked = sorted(((1 - len(c.compress(data)) / size, name, own) for name, own, own_set, c in self.entries if 2 * len(own_set & present) >= len(own_set)), key=lambda x: (-x[0], x[1], x[2]))
        found: list[tuple] = []
        for reduction, name, own in ranked:
            for blocks in _alignments(own, words):
                kept = {i for b in blocks for i in range(b.a, b.a + b.size)}
                missing = tuple(w for i, w in enumerate(own) if i not in kept)
                first, last = blocks[0].b, blocks[-1].b + blocks[-1].size - 1
                found.append((name, spans[first][1], spans[last][2], round(float(reduction), 6), len(kept) / len(own), missing, not missing and last - first + 1 == len(own)))
        out: list[tuple] = []
        begins: list[int] = []
        for f in sorted(found, key=lambda f: (-f[6], -f[4], -(f[2] - f[1]), f[0], f[1])):  # of overlapping ones the closest wording stays
            k = bisect.bisect_left(begins, f[2])  # those kept from here on begin behind it
            if not k or out[k - 1][2] <= f[1]:
                begins.insert(k, f[1])
                out.insert(k, f)
        if len(self.known) > 50_000:
            self.known.clear()
        if len(text) < 2000:
            self.known[text] = out
        return out

    def scan(self, text: str) -> Iterator[Found]:
        """Blocks reach from cue to cue and by the longest template beyond; places are of the whole text."""
        for cue in _candidates(text, self.width):
            for name, a, b, reduction, matched, missing, exact in self.block(text[cue[0] : cue[1]]):
                yield Found(name, cue[0] + a, cue[0] + b, reduction, matched, missing, exact)


def _width(own: tuple[str, ...]) -> int:
    """Words over which a template may spread."""
    return int(1.5 * len(own) + 4)


def _alignments(own: tuple[str, ...], words: list[str]) -> Iterator[list[difflib.Match]]:
    """Every place of a template among words: the matching runs around the longest one, and again on the words before and after. Nine tenths
    of the template are there, close together, and no word is missing that tells licenses apart. Long ranges are looked at in windows that overlap
    by what a template may spread over, so time is proportional to the words; a place in two windows may come twice."""
    need, width = LEAST_WORDS * len(own), _width(own)
    mine = set(own)
    held = [0, *itertools.accumulate(w in mine for w in words)]
    ranges: list[list[int]] = []  # whose words could be enough
    for s, word in enumerate(words):
        if word in mine and held[min(s + width, len(words))] - held[s] >= need:
            if ranges and s <= ranges[-1][1]:
                ranges[-1][1] = min(s + width, len(words))
            else:
                ranges.append([s, min(s + width, len(words))])
    windows = [(at, min(high, at + 3 * width)) for low, high in ranges for at in range(low, max(low + 1, high - width), 2 * width)]
    for low, high in windows:
        for blocks in _placed(own, words[low:high], need, width):
            yield [difflib.Match(b.a, low + b.b, b.size) for b in blocks]


def _placed(own: tuple[str, ...], words: list[str], need: float, width: int) -> Iterator[list[difflib.Match]]:
    mine = set(own)
    held = [0, *itertools.accumulate(w in mine for w in words)]
    match = difflib.SequenceMatcher(None, own, words, autojunk=False)
    open_at = [(0, len(words))]
    while open_at:
        low, high = open_at.pop()
        if held[high] - held[low] < need:
            continue
        anchor = match.find_longest_match(0, len(own), low, high)
        start = max(low, anchor.b + anchor.size - width)
        near = difflib.SequenceMatcher(None, own, words[start : min(high, anchor.b + width)], autojunk=False).get_matching_blocks()
        blocks = [difflib.Match(b.a, start + b.b, b.size) for b in near if b.size]
        kept = {i for b in blocks for i in range(b.a, b.a + b.size)}
        first, last = anchor.b, anchor.b + anchor.size
        if len(kept) >= need and blocks[-1].b + blocks[-1].size - blocks[0].b <= width and not any(_names(w) for i, w in enumerate(own) if i not in kept):
            first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
            yield blocks
        open_at += [(low, first), (last, high)]


def _names(word: str) -> bool:
    """Words that change which license a notice names."""
    return bool(re.search(r"\d", word)) or word in {"affero", "lesser", "apache", "mit", "mozilla", "noncommercial", "sharealike", "by-nc", "by-sa", "by", "neither", "cc0", "not"}


def _candidates(text: str, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of the text from `width` words before a cue to as many behind it, those that overlap as one: whatever the lines, a notice with a cue lies in one."""
    small = text.lower()
    if not any(part in small for part in _PARTS):  # one of these is in every cue
        return
    cues = [m.start() for m in CUES.finditer(text)]
    if not cues:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    low = high = -1
    for cue in cues:
        at = bisect.bisect_right(starts, cue) - 1
        if high < 0 or at - width > high:
            if high >= 0:
                yield spans[low][0], spans[high][1]
            low = max(0, at - width)
        high = min(len(spans) - 1, at + width)
    yield spans[low][0], spans[high][1]


_SCANNERS: dict[int, Scanner] = {}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per license found in a whole text: key, license, start and end (characters), reduction (share of the compressed size that the
    template saves), matched (share of its words that are there in order), missing (array<string>: its words that are not) and exact.

    Candidate blocks are the words around cues, as far as the longest template reaches. Each is compressed with every template that shares half of its words as raw
    dictionary, and each of these is confirmed by the differences in wording, wherever and however often it stands: nine tenths of the
    words in order and close together, and none missing that tells licenses apart. Of overlapping findings the closest wording stays, ties by name. Null
    and empty texts have no rows; null keys stay; each of repeated rows is scanned; an empty table gives an empty one; other columns are left out."""
    chosen = TEMPLATES if templates is None else templates
    rows = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("reduction", T.DoubleType()),
        T.StructField("matched", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("exact", T.BooleanType()),
    ])
    kinds = {"license": pa.string(), "start": pa.int64(), "end": pa.int64(), "reduction": pa.float64(), "matched": pa.float64(), "missing": pa.list_(pa.string()), "exact": pa.bool_()}
    name = hash(tuple(sorted(chosen.items())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCANNERS:
            _SCANNERS[name] = Scanner(chosen)
        own = _SCANNERS[name]
        for batch in batches:
            found = [(i, f) for i, value in enumerate(batch.column(1)) for f in own.scan(value.as_py() or "")]
            columns = [pa.array([getattr(f, c) for _, f in found], kind) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=[key, *kinds])

    return rows.mapInArrow(run, schema)
