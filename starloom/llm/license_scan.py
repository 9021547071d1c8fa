"""License scans: winnowed fingerprints find templates, banded alignment measures them.

Texts are compared in a normal form (ASCII lower case, every run of other than
letters, digits and non-ASCII bytes one space). A fingerprint is the hash of
``K`` bytes; of each ``W`` neighbouring ones the smallest is kept, so any common
stretch of ``K + W - 1`` bytes shares one. The templates' fingerprints form an
inverted index, whose size depends on the templates only. A document that posts
under a template is aligned to it word by word, in a band around the diagonal of
the hit. Of a long template a share of the words must match. A notice, of at most
``BAND`` words, must also have all words that name the license, in order and with
no other word before or between them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import ship, slices

K, W, BAND = 10, 6, 24
#: Share of a template's words that an alignment must match.
COVERAGE = 0.8

#: Wordings of public licenses and notices (fixed values).
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MIT-notice": "Released under the MIT License",
    "MIT-notice-2": "Licensed under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "licensed under the GNU General Public License, version 2",
    "LGPL-notice": "licensed under the GNU Lesser General Public License",
    "AGPL-3.0-notice": "licensed under the GNU Affero General Public License, version 3",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-notice": "Licensed under the BSD License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words of notices that do not tell licenses apart, and those of them that may stand anywhere in a notice.
FILLERS = frozenset("a an and in into is of only or terms that the this to".split())
PLAIN = FILLERS | frozenset("conditions distributed free international license licensed licence released software under version".split())

_GAPS = re.compile(rb"[^a-z0-9\x80-\xff]+")
_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def normal(text: str) -> bytes:
    return _GAPS.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip()


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``K``-byte grams, and whether winnowing keeps each."""
    n = len(data) - K + 1
    if n <= 0:
        return np.array([], np.uint32), np.array([], bool)
    x = data.astype(np.uint32) + np.uint32(1)
    h2 = x[:-1] * np.uint32(0x01000193) + x[1:]
    h4 = h2[:-2] * np.uint32(0x8DA6B343) + h2[2:]
    h8 = h4[:-4] * np.uint32(0xD8163841) + h4[4:]
    h = h8[:n] * np.uint32(0xCB1AB31F) + h2[8 : 8 + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    if n < W:
        return h, h == h.min()
    low = h[: n - W + 1].copy()
    for k in range(1, W):
        np.minimum(low, h[k : n - W + 1 + k], out=low)
    kept = np.zeros(n, bool)
    for k in range(W):
        kept[k : n - W + 1 + k] |= low == h[k : n - W + 1 + k]
    return h, kept


class Index:
    """Inverted index of the templates: fingerprint to (template, word position)."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: normal(v).decode().split(" ") for k, v in templates.items()}
        self.post: dict[int, list[tuple[str, int]]] = {}
        for k, v in templates.items():
            data = normal(v)
            h, kept = fingerprints(np.frombuffer(data, np.uint8))
            for i in np.flatnonzero(kept).tolist():
                self.post.setdefault(int(h[i]), []).append((k, data.count(b" ", 0, i)))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[[x >> 16 for x in self.post]] = True
        self.known = np.array(sorted(self.post), np.uint32)

    def hits(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Document to (fingerprint, byte offset in its normal form)."""
        joined = b"\n".join(texts)
        h, kept = fingerprints(np.frombuffer(joined, np.uint8))
        at = np.flatnonzero(kept & self.bits[h >> np.uint32(16)]) if len(h) and len(self.known) else np.array([], int)
        at = at[np.isin(h[at], self.known)]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        out: dict[int, list[tuple[int, int]]] = {}
        for i, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
            out.setdefault(d, []).append((int(h[i]), i - int(starts[d])))
        return out


def align(template: list[str], words: list[str], offset: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first word, last word + 1) of the best alignment of ``template`` in ``words`` near diagonal ``offset``.

    Longest common subsequence in a band: cell (i, j) counts template words up
    to i and document words up to j, j - i within ``band`` of ``offset``; of
    equal counts the narrowest span wins.
    """
    n = len(template)
    a, z = max(0, offset), min(len(words), offset + n)
    if offset >= 0 and words[a:z] == template:
        return n, a, z
    best = (0, 0, 0)
    row: dict[int, tuple[int, int]] = {}  # j -> (matches, -start); start of the first match
    for i in range(n):
        new: dict[int, tuple[int, int]] = {}
        lo, hi = max(0, offset + i - band), min(len(words), offset + i + band + 1)
        left = (0, 0)
        for j in range(lo, hi):
            got = max(row.get(j, (0, 0)), left)
            if words[j] == template[i]:
                m, s = row.get(j - 1, (0, 0))
                got = max(got, (m + 1, s if m else j + 1))
            new[j] = left = got
            if got[0] > best[0] or got[0] == best[0] and got[0] and j + 1 - (got[1] - 1) < best[2] - best[1]:
                best = (got[0], got[1] - 1, j + 1)
        row = new
    return best


def named(template: list[str], words: list[str]) -> int:
    """Number of words up to the end of the license's name in ``words``, 0 if it isn't there: all words of ``template`` that aren't plain (all of them, if it has no others) in order, with nothing but fillers and the template's own words between, and a plain word or none before."""
    must = [i for i, w in enumerate(template) if w not in PLAIN] or list(range(len(template)))
    core = template[must[0] : must[-1] + 1]
    needed = [i - must[0] for i in must]
    for p, w in enumerate(words):
        if w != core[0] or p and words[p - 1] not in PLAIN:
            continue
        i, j = 1, p + 1  # words of the name and of the document that are read
        while i < len(core) and j < len(words):
            k = next((k for k in range(i, len(core)) if core[k] == words[j]), None)
            if k is not None and not any(i <= n < k for n in needed):
                i = k + 1
            elif words[j] not in FILLERS:
                break
            j += 1
        if i == len(core):
            return j
    return 0


def scan(index: Index, text: str, hits: list[tuple[int, int]], coverage: float) -> list[dict]:
    """Matched templates of one text with character spans; overlapping weaker matches are dropped."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:z].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for a, z in spans]
    # word number of each byte offset in the normal form
    firsts = np.cumsum([0, *(len(w.encode("utf-8", "surrogatepass")) + 1 for w in words)])
    tries = set()
    for h, at in hits:
        j = int(np.searchsorted(firsts, at, "right")) - 1
        for name, i in index.post[h]:
            tries.add((name, (j - i) // (BAND // 2) * (BAND // 2) if len(index.words[name]) > BAND else j - i))
    found = []
    for name, offset in sorted(tries):
        t = index.words[name]
        m, a, z = align(t, words, offset, BAND if len(t) > BAND else 3)
        if m < coverage * len(t) or z <= a:
            continue
        if len(t) > BAND or words[a:z] == t:
            good = True
        else:  # "MIT-0" and "MIT-like" are other names than "MIT"
            end = a + named(t, words[a:z])
            good = end > a and (text[spans[end - 1][1] : spans[end][0]] != "-" or words[end] in PLAIN if end < len(words) else True)
        if good:
            found.append({"template": name, "coverage": round(m / len(t), 6), "start": spans[a][0], "end": spans[z - 1][1], "matched": m})
    found.sort(key=lambda f: (-f["matched"], -f["coverage"], f["start"], f["end"], f["template"]))
    out = []
    for f in found:
        if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in out):
            out.append(f)
    return sorted(out, key=lambda f: (f["start"], f["template"]))


@lru_cache(maxsize=2)
def _index(items: tuple) -> Index:
    return Index(dict(items))


_SCHEMA = "doc_id long, n_matches long, matches array<struct<template:string,coverage:double,start:int,end:int,matched:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the templates found in its whole text, with coverage and character spans.

    Null and empty texts match nothing; repeated rows and null ids stay; other
    columns are not read. No shuffle, so equal texts and hot sources cost the
    same as others.
    """
    ship(docs.sparkSession)
    items = tuple((templates if templates is not None else TEMPLATES).items())

    def run(batches):
        index = _index(items)
        kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32())]))
        for whole in batches:
            for b in slices(whole):
                texts = [t or "" for t in b.column(1).to_pylist()]
                hits = index.hits([normal(t) for t in texts])
                got = [scan(index, t, hits[d], coverage) if d in hits else [] for d, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array(got, kind)], names=["doc_id", "n_matches", "matches"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_matches", F.array_join(F.array_sort(F.array_distinct(F.col("matches.template"))), ",").alias("licenses"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), F.to_json("matches").alias("matches"))
