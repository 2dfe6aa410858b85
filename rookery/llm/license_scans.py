"""Operator 10: licence notices, by MinHash bands over overlapping windows of shingles.

Texts are lower-cased runs of letters and digits, in shingles of five. A template of L shingles
is sought in windows of about its own length: its text is seen in blocks of `b` shingles (1, 4,
16 or 64: the largest up to a quarter of L), and a window is as many neighbouring blocks as any
run of L shingles can touch. A window that holds `CONTAINED` = 0.8 of a template's shingles has a
Jaccard similarity J with it of at least 0.8 L / (window + 0.2 L). Each band is one MinHash value; it
agrees with probability J, so of n bands at least one agrees with probability 1 - (1 - J)^n.
n is chosen for each template so that no more than one match in `MISSED` is missed. Where all shingles
are needed and the window has just the template's length, J is 1 and one band never misses.

Windows whose band agrees with a template's are verified: the share of the template's shingles,
compared as strings, that the window contains. All this is local to a row, with no shuffle, and
the templates are constants.

Defined cases: null and empty texts and texts of fewer than five words match nothing; very long texts are seen
whole, window by window; of windows that hold equally much of a template the first is told; ids are carried as they are, null and
repeated ones too, and repeated rows get equal results; an empty table gives no rows. Columns of `docs` may have any names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, documents, field, held, let, whole

SHINGLE = 5
CONTAINED = 0.8
MISSED = 1000
_WORD = r"[\p{L}\p{N}]+"

#: Notices, and passages of licence texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "This project is licensed under the MIT License",
    "bsd-2-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-conditions": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0": "either version 2 of the License, or (at your option) any later version",
    "lgpl-text": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-text": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0-text": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


class Template(NamedTuple):
    name: str
    shingles: tuple[str, ...]
    block: int
    blocks: int
    bands: int


def words_in(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def plan(name: str, text: str) -> Template:
    every = shingles_of(words_in(text))
    distinct, length = tuple(dict.fromkeys(every)), len(every)
    if not every:
        raise ValueError(f"{name}: a template needs {SHINGLE} words")
    block = max(b for b in (1, 4, 16, 64) if b == 1 or b <= length // 4)
    blocks = math.ceil((length - 1) / block) + 1 if block > 1 else length
    needed, window = math.ceil(CONTAINED * len(distinct)), block * blocks
    j = needed / (window + len(distinct) - needed)
    return Template(name, distinct, block, blocks, 1 if j >= 1 else math.ceil(math.log(MISSED) / -math.log(1 - j)))


def seed(band: int) -> int:
    """Turns the one hash of a shingle into a band's own: by exclusive or, since the hashes are uniform."""
    x = xxhash.xxh64_intdigest(f"band {band}".encode(), 42) if band else 0
    return x - (1 << 64) if x >> 63 else x


def hash_of(shingle: str) -> int:
    """As the column function: chained XXH64 over the words, seed 42."""
    h = 42
    for w in shingle.split(" "):
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def key_of(template: Template, band: int) -> int:
    return min(hash_of(s) ^ seed(band) for s in template.shingles)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of `docs`) and found: array of struct(name, at, share), the best window of each template found, by name; at: its first word."""
    plans = [plan(n, t) for n, t in (templates or TEMPLATES).items()]
    words = F.regexp_extract_all(F.lower(whole(field(text_col))), F.lit(_WORD), F.lit(0))
    out = boxed(docs).withColumn("words", words)
    w = F.col("words")
    later = F.slice(w, SHINGLE, F.greatest(F.size(w) - SHINGLE + 1, F.lit(0)))
    out = out.withColumn("sh", F.transform(later, lambda x, i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE - 1)], x)))
    # A band can only agree where the very shingle occurs that gives a template its value. Rows
    # without any such shingle need no band: their arrays become empty.
    telling = F.array(*[F.lit(x) for x in sorted({key_of(t, k) ^ seed(k) for t in plans for k in range(t.bands)})])
    out = out.withColumn("may", F.coalesce(F.arrays_overlap("sh", telling), F.lit(False)))
    out = out.withColumns({c: F.when(F.col("may"), F.col(c)).otherwise(F.slice(c, 1, 0)) for c in ("words", "sh")})
    sh, names = F.col("sh"), ["words", "sh", "may"]
    groups = defaultdict(list)
    for t in plans:
        groups[t.block, t.blocks].append(t)
    blocked: dict[tuple[int, int], str] = {}
    for block, band in sorted({(t.block, k) for t in plans for k in range(t.bands)}):
        own = _mixed(sh, band) if band else sh
        if block > 1:
            mixed = f"x{band}"
            if mixed not in names:
                out = out.withColumn(mixed, own)
                names.append(mixed)
            starts = F.sequence(F.lit(1), F.greatest(F.size(sh), F.lit(1)), F.lit(block))
            own = let(F.col(mixed), _block_minima(starts, block))
        blocked[block, band] = f"b{block}_{band}"
        out = out.withColumn(blocked[block, band], own)
        names.append(blocked[block, band])
    verified = []
    for (block, blocks), members in groups.items():
        hits = []
        for band in range(max(t.bands for t in members)):
            keys = [key_of(t, band) for t in members if band < t.bands]
            hits.append(let(F.col(blocked[block, band]), _agreeing(keys, blocks)))
        candidates = f"c{block}_{blocks}"
        out = out.withColumn(candidates, F.array_distinct(F.concat(*hits)))
        names.append(candidates)
        for t in members:
            verified.append(_verified(t, F.col(candidates), w))
    found = F.array_sort(F.array_compact(F.array(*verified)))
    return out.withColumn("found", held(F.when(F.size(sh) > 0, found).otherwise(F.slice(found, 1, 0)))).drop(*names)


def _mixed(shingles: Column, band: int) -> Column:
    return F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(seed(band))))


def _block_minima(starts: Column, block: int) -> Callable[[Column], Column]:
    return lambda values: F.transform(starts, lambda p: F.array_min(F.slice(values, p, F.lit(block))))


def _agreeing(keys: list[int], blocks: int) -> Callable[[Column], Column]:
    """Numbers of the windows of so many blocks whose least value is one of `keys`."""

    def find(mins: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(mins) - blocks, F.lit(0)))
        near = (lambda p: F.array_min(F.slice(mins, p + 1, F.lit(blocks)))) if blocks > 1 else (lambda p: F.get(mins, p))
        return F.filter(starts, lambda p: F.coalesce(near(p).isin(keys), F.lit(False)))

    return find


def _verified(t: Template, candidates: Column, words: Column) -> Column:
    """struct(name, at, share) of the first best candidate window that holds enough of the template, or null."""
    own = F.array(*[F.lit(s) for s in t.shingles])

    def share(p: Column, words: Column) -> Column:
        spell = lambda piece: F.transform(F.sequence(F.lit(1), F.greatest(F.size(piece) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(piece, i, F.lit(SHINGLE)), " "))
        spelled = let(F.slice(words, p * t.block + 1, F.lit(t.block * t.blocks + SHINGLE - 1)), spell)
        return F.size(F.array_intersect(own, spelled)) / F.lit(float(len(t.shingles)))

    each = let(words, lambda w: F.transform(candidates, lambda p: F.struct(share(p, w).alias("share"), (-p).alias("back"))))
    told = lambda best: F.when(best["share"] >= CONTAINED, F.struct(F.lit(t.name).alias("name"), (-best["back"] * t.block).alias("at"), best["share"].alias("share")))
    return let(F.array_max(each), told)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(documents(spark, sf_dir).select("doc_id", "text"))
    found = F.col("found")
    return out.select(
        field("doc_id").alias("doc_id"),
        F.size(found).cast("long").alias("n_licenses"),
        F.array_join(F.transform(found, lambda f: f["name"]), ",").alias("licenses"),
        F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["name"], f["at"].cast("string"))), ",").alias("places"),
    )
